"""Line dedup by the spread over sites, with HyperLogLog sketches.

Every line with a word, without blanks at its ends, has a hash; sketches of the sites it stands
on are merged by aggregation. Lines whose estimate is clearly over or under the threshold are
decided by it; for those near the threshold the sites are counted exactly. Boilerplate lines
are removed wherever they stand; other lines and their order stay.

A null site is a site of its own. A null text stays null, with no lines. Lines without a word
are kept and count as lines. Repeated rows are each cleaned. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import kept, slices, span_hashes, text_bytes, word_spans

#: Sites from which a line is boilerplate.
SITES = 10
#: Registers are 2^LOG; the standard error is 1.04 / sqrt(2^LOG), and near is within three of them.
LOG = 9
NEAR = 3 * 1.04 / 2 ** (LOG / 2)
#: Parts that the sites of one line are dealt into before their sketches are merged.
SALTS = 64
#: Boilerplate lines whose hashes are broadcast (8 bytes each); beyond that they are joined.
BROADCAST = 1_000_000


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number in the row, and hash of every line with a word."""
    starts, ends, _ = word_spans(data, offsets)
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[rows])
    if not len(starts):
        return rows, number, np.zeros(0, dtype=np.uint64)
    change = np.flatnonzero((np.diff(rows) != 0) | (np.diff(number) != 0)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change - 1, [len(starts) - 1]))
    return rows[first], number[first], span_hashes(data, starts[first], ends[last])


def _sited(docs: DataFrame, site: str) -> DataFrame:
    """(line, site) once per slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = batch.column("site").to_numpy()
            for lo, _, data, offsets in slices(batch.column("text")):
                rows, _, keys = lines(data, offsets)
                pairs = np.unique(np.column_stack((keys.view(np.int64), sites[lo + rows])), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["line", "site"])

    text, named = F.col("text"), F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")))
    return docs.select(named.alias("site"), text.alias("text")).mapInArrow(run, "line long, site long")


def boilerplate(docs: DataFrame, site: str = "source", least: int = SITES) -> DataFrame:
    """(line, sites) of the lines that stand on ``least`` sites or more."""
    # Distinct pairs from here on: a line that stands on every page of a site is one row.
    pairs = kept(_sited(docs, site).distinct(), "line_sites")
    if least <= 1:
        return pairs.groupBy("line").agg(F.count("*").alias("sites"))
    # A line on one site only needs no sketch; most lines are such. The sites of a hot line lie in
    # many parts, each with a sketch of its own.
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("site"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("line", "salt").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    spread = parts.groupBy("line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("line")
    busy = parts.join(spread, "line").select("line", "salt")
    merged = salted.join(busy, ["line", "salt"]).groupBy("line", "salt").agg(F.hll_sketch_agg("site", LOG).alias("sketch"))
    merged = merged.groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    sketched = kept(merged, "sketches")
    near = sketched.where((F.col("sites") >= least * (1 - NEAR)) & (F.col("sites") <= least * (1 + NEAR))).select("line")
    exact = pairs.join(near, "line").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= least)
    return sketched.where(F.col("sites") > least * (1 + NEAR)).unionByName(exact)


def _clean(text: str | None, drop: set[int]) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    parts = text.split("\n")
    rest = [p for i, p in enumerate(parts) if i not in drop] if drop else parts
    return "\n".join(rest), len(parts), len(parts) - len(rest)


_KIND = "doc_id long, n_lines long, n_removed long, text string"


def _batch(ids: pa.Array, rows: list[tuple[str | None, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[0], pa.string())],
        names=["doc_id", "n_lines", "n_removed", "text"],
    )


def _by_broadcast(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts are cleaned where they are read."""
    known = np.sort(found.select("line").toPandas()["line"].to_numpy(dtype=np.int64)).view(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            drop: list[set[int]] = [set() for _ in texts]
            for lo, _, data, offsets in slices(batch.column("text")):
                rows, number, keys = lines(data, offsets)
                for i in np.flatnonzero(np.isin(keys.view(np.int64), shared.value)).tolist():
                    drop[lo + int(rows[i])].add(int(number[i]))
            yield _batch(batch.column("doc_id"), [_clean(t, d) for t, d in zip(texts, drop)])

    return docs.select("doc_id", "text").mapInArrow(run, _KIND)


def _by_join(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Line places are joined with the boilerplate, then with the texts."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in slices(batch.column("text")):
                rows, number, keys = lines(data, offsets)
                at = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("tie").take(at), pa.array(number), pa.array(keys.view(np.int64))],
                    names=["doc_id", "tie", "number", "line"],
                )

    keyed = docs.select("doc_id", F.xxhash64(text_bytes(F.col("text"))).alias("tie"), "text")
    places = keyed.mapInArrow(place, "doc_id long, tie long, number long, line long").join(found.select("line"), "line")
    drops = places.groupBy("doc_id", "tie").agg(F.collect_set("number").alias("drop"))
    on = keyed["doc_id"].eqNullSafe(drops["doc_id"]) & (keyed["tie"] == drops["tie"])
    joined = keyed.join(drops, on, "left").select(keyed["doc_id"], keyed["text"], drops["drop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist())
            yield _batch(batch.column("doc_id"), [_clean(t, set(d or ())) for t, d in pairs])

    return joined.mapInArrow(run, _KIND)


def clean(docs: DataFrame, site: str = "source", least: int = SITES, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row, without boilerplate lines."""
    found = kept(boilerplate(docs, site, least), "boilerplate")
    return _by_broadcast(docs, found) if found.count() <= broadcast else _by_join(docs, found)
