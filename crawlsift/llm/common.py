"""Shared helpers: the work folder, labelled rows, and word arrays over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.session import checkpoint_dir

# ASCII blanks that end a word: space and \t \n \v \f \r.
BLANKS = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, where it is not installed there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(made))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, where: Column, bound: int) -> DataFrame:
    """(text, y) of at most about ``bound`` labelled rows, chosen by a hash of the id.

    Labels are reduced to one per id (the largest) and thinned before they meet the texts, so
    that the ids are few enough to broadcast, whatever the input.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .where(where)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = ids.count()
    if n > bound:
        limit = int(bound / n * (1 << 32))
        ids = ids.where((F.xxhash64(F.lit("labelled"), "doc_id").bitwiseAND((1 << 32) - 1)) < limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", "y")


# ---- arrays -------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers), 256), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a text column; null is empty, rows stay whole."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~_IS_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:-1]
    end = full.copy()
    end[:-1] &= ~full[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    inside = at - np.repeat(starts, lengths)
    values = _CODES[data[at]] * powers(int(lengths.max()) + 1)[inside]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of all rows, and the index of each row's first one.

    A row with fewer words has one shingle of all its words; a row without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(counts)))
    total = int(begin[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(total)
    short = np.repeat(np.where(n < size, n, size), counts)
    out = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(size, dtype=np.uint64)))
    for j in range(size):
        out *= _BASE
        word = padded[at + j]
        word[short <= j] = np.uint64(0)
        out += word
    return mix(out + short.astype(np.uint64)), begin
