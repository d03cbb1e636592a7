"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one node. Every node has a MinHash signature over its five-word shingles; nodes
that agree in a band of signature values meet in a bucket. Inside a bucket pairs are compared a
few values at a time: with m matches in k values the similarity has a Beta posterior, and a
pair is dropped once the probability that it reaches the threshold is below ``TOLERANCE``.
The pairs that are left are verified exactly on their shingles.

Buckets with the same members are worked through once. A pair that meets in several buckets
belongs to the first band in which its values agree, so each link is counted once, in one
task, and no pairs are written: a bucket gives one row per member, with the number of its links
there and the smallest node that they connect it with, from which classes follow as connected
components. A large
bucket is cut into blocks, and each pair of blocks is a task of its own.

A text of fewer than five words has one shingle of all its words. Nulls and texts without words
have no links; those with equal text are copies of each other, nulls too. Repeated rows are
copies. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.common import kept, mix, shingles, slices, span_hashes, text_bytes, word_spans

SHINGLE, LEAST = 5, 0.8
#: Bands of values; 25 bands of 5 miss a pair of similarity 0.8 once in 20,000.
BANDS, ROWS = 25, 5
#: Values compared at a time, and the posterior probability under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-5
#: Members of a bucket in one block, and pairs compared in one go.
BLOCK, PAIRS = 512, 1 << 16

_KEYS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def node(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    raw = text_bytes(text)
    return [F.xxhash64(raw).alias("a"), F.xxhash64(F.lit(1), raw).alias("b")]


def least_matches(threshold: float = LEAST, tolerance: float = TOLERANCE) -> list[int]:
    """For k = STEP, 2 STEP, ... values, the fewest matches with which a pair stays.

    With a uniform prior, the chance that similarity is ``threshold`` or more is the upper tail
    of Beta(m + 1, k - m + 1), which is a binomial sum.
    """
    out = []
    for k in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(k + 2):
            # P(Beta(m+1, k-m+1) >= t) = P(Binomial(k+1, t) <= m)
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values of one set of shingles."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(_KEYS), dtype=np.uint32)
    for lo in range(0, len(_KEYS), 25):  # small blocks stay in the cache
        y = x[None, :] * _KEYS[lo : lo + 25, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[lo : lo + 25] = y.min(axis=1)
    return out


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    hashes, begin = shingles(span_hashes(data, starts, ends), first, size)
    return [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(offsets) - 1)]


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, a, b, values, bands) of every row; the last two are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bands = [], []
            for _, _, data, offsets in slices(batch.column("text")):
                for own in _shingle_sets(data, offsets, size):
                    if not len(own):
                        values.append(None), bands.append(None)
                        continue
                    s = signature(own)
                    keys = s.reshape(BANDS, ROWS).astype(np.uint64)
                    h = np.zeros(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        h = h * np.uint64(0x9E3779B97F4A7C15) + keys[:, r]
                    values.append(s.astype("<u4").tobytes()), bands.append(mix(h).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(values, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "a", "b", "values", "bands"],
            )

    rows = docs.select("doc_id", *node(F.col("text")), "text")
    return rows.mapInArrow(run, "doc_id long, a long, b long, values binary, bands array<long>")


def _compare(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, band: int, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions that are similar enough and belong to ``band``."""
    values = np.stack([np.frombuffer(v, dtype="<u4") for v in rows["values"]])
    keys = values.reshape(len(values), BANDS, ROWS)
    codes, sets = np.unique(np.concatenate([np.frombuffer(s, dtype="<u8") for s in rows["shingles"]]), return_inverse=True)
    sizes = np.array([len(s) // 8 for s in rows["shingles"]])
    ends = np.cumsum(sizes)
    a_out, b_out = [], []
    marks = np.zeros(len(codes), dtype=bool)
    for lo in range(0, len(left), PAIRS):
        a, b = left[lo : lo + PAIRS], right[lo : lo + PAIRS]
        # Pairs that agree in an earlier band are counted there.
        if band:
            earlier = (keys[a, :band] == keys[b, :band]).all(axis=2).any(axis=1)
            a, b = a[~earlier], b[~earlier]
        matches = np.zeros(len(a), dtype=np.int64)
        for k, enough in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (values[a, part] == values[b, part]).sum(axis=1)
            stay = matches >= enough
            a, b, matches = a[stay], b[stay], matches[stay]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        # Exact: mark one side's shingles, count the other's that are marked.
        for i in np.unique(a):
            own = sets[ends[i] - sizes[i] : ends[i]]
            marks[own] = True
            for j in b[a == i]:
                both = int(marks[sets[ends[j] - sizes[j] : ends[j]]].sum())
                if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                    a_out.append(i), b_out.append(j)
            marks[own] = False
    return np.array(a_out, dtype=np.int64), np.array(b_out, dtype=np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that the pairs (a, b) connect each of ``n`` positions with."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, threshold: float = LEAST) -> DataFrame:
    """(id, links, root): per bucket and member the links that belong there, and the smallest
    node that they connect it with. ``nodes`` has id, text_id, a, b, values, bands."""
    least = least_matches(threshold)
    banded = nodes.where(F.col("bands").isNotNull()).select("id", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "id")).alias("s2")
    ).where("n > 1")
    # Buckets with the same members: the first band stands for all.
    first = Window.partitionBy("n", "s1", "s2").orderBy("band")
    chosen = sizes.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("band", "key", "n")
    members = kept(banded.join(chosen, ["band", "key"]), "members")
    # Texts and signatures of the nodes in buckets, once each.
    busy = members.select("id").distinct()
    wanted = kept(nodes.join(busy, "id").select("id", "text_id", "a", "b", "values"), "wanted")
    texts = docs.select("doc_id", *[c.alias(f"own_{n}") for c, n in zip(node(F.col("text")), "ab")], "text")
    same = (texts["own_a"] == wanted["a"]) & (texts["own_b"] == wanted["b"]) & texts["doc_id"].eqNullSafe(wanted["text_id"])
    texts = texts.join(wanted, same)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, data, offsets in slices(batch.column("text")) for s in _shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("values"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                names=["id", "values", "shingles"],
            )

    payload = texts.select("id", "values", "text").mapInArrow(shingled, "id long, values binary, shingles binary")
    # Equal rows of one id stand for one node.
    payload = payload.dropDuplicates(["id"])

    # Blocks of a bucket, and the pairs of blocks: member of block i goes to (i, j) and (j, i).
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "id", "band", "key", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
    )

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, _, i, j = key
        rows = rows.sort_values("id", ignore_index=True)
        here, there = np.flatnonzero(rows["own"] == i), np.flatnonzero(rows["own"] == j)
        ids, total, pairs = rows["id"].to_numpy(), np.zeros(len(rows), dtype=np.int64), []
        step = max(1, PAIRS // max(len(there), 1))
        for lo in range(0, len(here), step):
            left = np.repeat(here[lo : lo + step], len(there))
            right = np.tile(there, len(here[lo : lo + step]))
            if i == j:
                left, right = left[left < right], right[left < right]
            if not len(left):
                continue
            a, b = _compare(rows, left, right, band, least, threshold)
            total += np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
            pairs.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        some = total > 0
        return pd.DataFrame({"id": ids[some], "links": total[some], "root": ids[_labels(len(ids), a, b)][some]})

    joined = dealt.join(payload, "id")
    return joined.groupBy("band", "key", "i", "j").applyInPandas(verify, "id long, links long, root long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest node of each connected component, by label spreading with
    shortcuts. Every round is written to the shared folder; only a count comes back."""
    both = kept(edges.select("id", "root").union(edges.select("root", "id")).where("id != root").distinct(), "edges")
    labels = kept(both.groupBy("id").agg(F.least(F.col("id"), F.min("root")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("root"), F.col("root").alias("far")), "root")
        least = near.groupBy("id").agg(F.min("far").alias("far"))
        spread = labels.join(least, "id").select("id", "root", F.least("root", "far").alias("now"))
        # Shortcut: the label's own label.
        up = labels.select(F.col("id").alias("now"), F.col("root").alias("up"))
        grown = kept(
            spread.join(up, "now", "left").select("id", F.least("now", F.coalesce("up", "now")).alias("root"), F.col("root").alias("was")), "labels"
        )
        labels = grown.select("id", "root")
        if not grown.where("root != was").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, size: int = SHINGLE, threshold: float = LEAST) -> DataFrame:
    """(doc_id, class_id, text_id, n_copies, n_links, a, b, keeper) of every row.

    ``text_id`` is the least id with an equal text, ``n_copies`` their number; ``n_links`` the
    number of other texts that are similar enough; ``class_id`` the least id of all texts that
    links connect; ``keeper`` marks the row (or equal rows) that stands for its class.
    """
    rows = kept(signatures(docs, size), "signatures")
    nodes = kept(
        rows.groupBy("a", "b").agg(
            F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("values").alias("values"), F.first("bands").alias("bands")
        ).withColumn("id", F.monotonically_increasing_id()),  # written, so numbers stay
        "nodes",
    )
    found = kept(links(docs, nodes, size, threshold), "links")
    per_node = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    texts = nodes.select("id", "a", "b", "text_id", "n_copies").join(per_node, "id", "left")
    texts = texts.join(components(found), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # The least of each class: nulls last, equal ids by text.
    best = F.struct(F.col("text_id").isNull().alias("none"), "text_id", "a", "b")
    heads = texts.groupBy("root").agg(F.min(best).alias("head"))
    texts = texts.join(heads, "root").select(
        "a", "b", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("head.text_id").alias("class_id"),
        ((F.col("head.a") == F.col("a")) & (F.col("head.b") == F.col("b"))).alias("first"),
    )
    return rows.select("doc_id", "a", "b").join(texts, ["a", "b"]).select(
        "doc_id", "class_id", "text_id", "n_copies", "n_links", "a", "b",
        (F.col("first") & F.col("doc_id").eqNullSafe(F.col("text_id"))).alias("keeper"),
    )


def distinct_documents(docs: DataFrame, size: int = SHINGLE, threshold: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class; equal rows once."""
    keep = join(docs, size, threshold).where("keeper").select("doc_id", "a", "b").distinct()
    # A whole row is one column, so that no name of its own can clash.
    own = [c.alias(f"own_{n}") for c, n in zip(node(F.col("text")), "ab")]
    keyed = docs.select(F.col("doc_id").alias("own_id"), *own, F.struct("*").alias("row"))
    same = (F.col("own_a") == F.col("a")) & (F.col("own_b") == F.col("b")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    return keyed.join(keep, same).dropDuplicates(["own_a", "own_b", "own_id"]).select("row.*")
