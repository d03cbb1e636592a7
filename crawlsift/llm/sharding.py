"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Law: ``rows``. Rows get gapless numbers 0..N-1 from counts per hash bucket of id and text; a keyed
permutation of those numbers gives each row a position, from which shard and slot follow by
arithmetic. Shard sizes differ by one row at most, and the place of row number r can be
computed without any table.

Nulls: a null text counts as empty, a null id is a value like any other. Repeated rows get
places of their own. An empty table gives an empty result. Only the columns named here are
read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.common import text_bytes

#: Hash buckets that are numbered one by one: a table of offsets of about a megabyte.
BUCKETS = 1 << 16
ROUNDS = 6
# A prime under 2^31, so that squares fit in a long.
PRIME = 2147483647
WALKS = 8


def _round(half: Column, key: Column) -> Column:
    """Keyed round function: two modular squarings."""
    x = (half + key) % PRIME
    x = (x * x + key * 3 + 1) % PRIME
    return (x * x + half) % PRIME


def _permute(value: Column, rows: Column, columns: Column, seed: int) -> Column:
    """One pass of an alternating additive Feistel network over rows x columns cells."""

    def step(state: Column, r: Column) -> Column:
        key = (r * 7919 + seed * 104729 + 12345) % PRIME
        left = (state["l"] + _round(state["r"], key)) % rows
        right = (state["r"] + _round(state["l"], key)) % columns
        even = r % 2 == 0
        return F.struct(
            F.when(even, left).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(right).alias("r"),
        )

    start = F.struct(F.floor(value / columns).cast("long").alias("l"), (value % columns).alias("r"))
    rounds = F.array(*[F.lit(i).cast("long") for i in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * columns + s["r"])


def permuted(number: Column, total: Column, seed: int) -> Column:
    """The image of ``number`` in 0..total-1 under a keyed permutation of that range.

    The network permutes a grid of rows x columns >= total cells; an image beyond the range
    is permuted again until it falls inside. Cells outside are fewer than the grid's rows, so
    a walk that outlasts ``WALKS`` steps still has a bound, used in the last branch.
    """
    rows = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    columns = F.ceil(total / rows).cast("long")

    def walk(steps: Column, start: Column) -> Column:
        return F.aggregate(
            steps, start, lambda v, _: F.when(v < total, v).otherwise(_permute(v, rows, columns, seed))
        )

    few = F.array(*[F.lit(i) for i in range(WALKS)])
    # The first pass is always made: start from the image, then walk while outside.
    value = walk(few, _permute(number, rows, columns, seed))
    return F.transform(
        F.array(value),
        lambda v: F.when(v < total, v).otherwise(walk(F.sequence(F.lit(0).cast("long"), rows), v)),
    )[0]


def numbered(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add ``number`` (0-based, gapless, the same at every run) and ``total``.

    Rows are numbered inside hash buckets of the order columns, so that rows of one id are
    spread as well; the buckets' counts, at most ``buckets`` rows, give the offsets and are
    small enough to broadcast whatever the input.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy(*order)
    ranked = bucketed.withColumn("rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(offsets), "bucket").withColumn(
        "number", F.col("before") + F.col("rank") - 1
    )


def shard(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, number) for every row."""
    text = text_bytes(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    placed = numbered(rows, ["doc_id", "text_crc32", "size"]).withColumn(
        "place", permuted(F.col("number"), F.col("total"), seed)
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("number").cast("long").alias("number"),
    )
