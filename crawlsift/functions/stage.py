"""Stages of a long expression pipeline.

Catalyst moves a filter below the projections under it by writing their expressions into
the predicate. After many dependent projections that predicate grows without bound and is
evaluated again. ``pin`` puts the columns behind a one-element generator, which filters
on those columns stay above.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: dict[str, Column], drop: str | None = None) -> DataFrame:
    """Add or replace ``columns``; columns whose name starts with ``drop`` are left out."""
    kept = [
        F.col(f"`{n}`")
        for n in df.columns
        if n not in columns and not (drop and n.startswith(drop))
    ]
    fields = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*kept, F.inline(F.array(fields)))


def ranked_globally(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank`` (1-based position in the whole order) and ``total``, without one big task.

    Rows are range-partitioned and checkpointed, so that the partition sizes counted first
    belong to the same rows that are ranked afterwards, even if an executor is lost.
    """
    from crawlsift.session import checkpoint_dir

    folder = checkpoint_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    parts = (
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    )
    # One row per partition from here: as many as there are shuffle partitions.
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        parts.join(F.broadcast(offsets), "__part")
        .withColumn("rank", F.col("__before") + F.row_number().over(inside))
        .drop("__part", "__before")
    )


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Add ``name``: the 0-based place of each row in its group, for groups of any size.

    Rows are cut into ranges of (groups, order) and written, so a large group lies in many
    ranges and no task holds it whole. Places count from the start of the range; what lies
    in earlier ranges is added for the first and the last group of a range, as only these
    can go on in another one. Equal rows of a group get places of their own in any order.
    """
    parts = settle(
        df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id()), "numbered"
    )
    group = F.struct(*groups)
    ends = parts.groupBy("__part").agg(F.min(group).alias("__first"), F.max(group).alias("__last"))
    at_end = group.eqNullSafe(F.col("__first")) | group.eqNullSafe(F.col("__last"))
    # One row per range, then at most two: as many as there are shuffle partitions.
    edges = parts.join(F.broadcast(ends), "__part").filter(at_end)
    keys = ["__part", *groups]
    edges = edges.groupBy(*keys).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before")
    edges = edges.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(keys)], before)
    same = [F.col(c).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(keys)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = parts.withColumn("__place", place).join(F.broadcast(edges), same, "left")
    return placed.select(*df.columns, (F.col("__place") + F.coalesce("__before", F.lit(0))).alias(name))


def paged(
    values: DataFrame, keys: list[str], names: list[str], size: int, limits: dict[str, int | None] | None = None
) -> DataFrame:
    """(keys, page, one array per name): lists in pages of at most ``size`` values each.

    ``values(keys, field, v, at)`` are the distinct values ``v`` of the lists called ``field``, in
    the order of ``at``. Page p holds the values from p * size on of every list of a key.
    ``limits`` cuts a list to its first values.
    """
    placed = numbered(values.select(*keys, "field", "v", "at"), [*keys, "field"], ["at", "v"])
    given = {name: n for name, n in (limits or {}).items() if n is not None}
    for name, n in given.items():
        placed = placed.filter((F.col("field") != name) | (F.col("n") < n))

    def gathered(name):
        mine = F.collect_list(F.when(F.col("field") == name, F.struct("n", "v")))
        return F.transform(F.sort_array(mine), lambda s: s.v).alias(name)

    page = F.floor(F.col("n") / size).alias("page")
    return placed.groupBy(*keys, page).agg(*[gathered(name) for name in names])


def with_pages(main: DataFrame, pages: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``main`` once for each of its pages, with the arrays of the page; without lists, an empty page 0."""
    empty = F.array().cast("array<string>")
    return main.join(pages, keys, "left").withColumns({
        "page": F.coalesce("page", F.lit(0).cast("bigint")), **{n: F.coalesce(F.col(n), empty) for n in names},
    })


_here = threading.local()
#: Spark removes the shuffle files of a query that ran with this at its end, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``settle`` writes inside, in this thread, are removed at the end.

    For a step whose results are written elsewhere, or handed on as tables: the function that comes
    with the block leaves a table to what is around it.
    """
    outer, mine = getattr(_here, "tables", None), []
    _here.tables = mine

    def keep(df: DataFrame) -> DataFrame:
        table = next(t for t in mine if t[1] is df)
        mine.remove(table)
        if outer is not None:
            outer.append(table)
        return df

    try:
        yield keep
    finally:
        _here.tables = outer
        for path, _ in mine:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; nothing reads them once it is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Findings are narrow and feed several aggregates; written once, pages are not scanned
    again for each of them, and a lost executor costs no rescan.
    """
    from crawlsift.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if getattr(_here, "tables", None) is not None:
        _here.tables.append((path, table))
    return table


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than there are cores.

    A large table has far more splits than cores and is left as it is: its text is never
    shuffled. Only for plain scans, as counting the splits plans the query.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all tasks of a shuffle by ``by``, however few bytes they have.

    For short rows with much work each: by their size alone they would be put together in few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)
