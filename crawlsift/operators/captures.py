"""Archive captures: status filter, collapse per URL, filtered and sorted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import fixed
from crawlsift.functions.stage import numbered
from crawlsift.functions.text import rmatch
from crawlsift.functions.urls import host_of

SLOTS = 64
# --- fixed values: sort choices, as column and direction ----------------------
SORTS = {
    "first-newest": ("timestamp", "desc"),
    "first-oldest": ("timestamp", "asc"),
    "last-newest": ("endtimestamp", "desc"),
    "last-oldest": ("endtimestamp", "asc"),
    "url-az": ("original", "asc"),
    "url-za": ("original", "desc"),
    "most": ("groupcount", "desc"),
    "fewest": ("groupcount", "asc"),
}


def capture_collapse(raw: DataFrame) -> DataFrame:
    """One row per URL key: first capture, first and last time, captures, distinct captures.

    Captures with a client or server error are left out. With a limit each host keeps its
    first URL keys; a large host is cut in slots before it meets in one task.
    """
    ok = raw.filter(~rmatch(F.coalesce(F.col("statuscode"), F.lit("")), r"^[45]..\z"))
    first = F.struct("timestamp", "source_pos")
    # Distinct captures are counted in a second step, so a hot key is spread by digest.
    part = ok.groupBy("urlkey", "digest").agg(
        F.min(F.struct(first.alias("at"), "original", "mimetype")).alias("first"),
        F.min("timestamp").alias("timestamp"),
        F.max("timestamp").alias("endtimestamp"),
        F.count("*").alias("n"),
    )
    df = part.groupBy("urlkey").agg(
        F.min("first").alias("first"),
        F.min("timestamp").alias("timestamp"),
        F.max("endtimestamp").alias("endtimestamp"),
        F.sum("n").alias("groupcount"),
        F.count("digest").alias("uniqcount"),
    )
    df = df.select(
        "urlkey", F.col("first.original").alias("original"),
        F.col("first.mimetype").alias("mimetype"),
        "timestamp", "endtimestamp", "groupcount", "uniqcount",
    ).withColumn("host", host_of(F.col("original")))
    if fixed.CAPTURE_ROWS is None:
        return df
    slot = F.pmod(F.xxhash64("urlkey"), F.lit(SLOTS))
    inner = Window.partitionBy("host", "__slot").orderBy("urlkey")
    outer = Window.partitionBy("host").orderBy("urlkey")
    df = df.withColumn("__slot", slot)
    df = df.withColumn("__n", F.row_number().over(inner)).filter(F.col("__n") <= fixed.CAPTURE_ROWS)
    df = df.withColumn("__n", F.row_number().over(outer)).filter(F.col("__n") <= fixed.CAPTURE_ROWS)
    return df.drop("__slot", "__n")


def capture_filter(captures: DataFrame, mime: str = "", search: str = "") -> DataFrame:
    """Exact MIME type, and a substring of URL or MIME type in any case."""
    df = captures
    if mime:
        df = df.filter(F.col("mimetype") == mime)
    wanted = search.strip().lower()
    if wanted:
        df = df.filter(
            F.contains(F.lower("original"), F.lit(wanted))
            | F.contains(F.lower("mimetype"), F.lit(wanted))
        )
    return df


def archive_day(ts: Column) -> Column:
    """yyyyMMdd... as yyyy-MM-dd; shorter strings stay as they are."""
    day = F.concat_ws("-", F.substring(ts, 1, 4), F.substring(ts, 5, 2), F.substring(ts, 7, 2))
    return F.when(F.length(ts) >= 8, day).when(
        F.coalesce(ts, F.lit("")) != "", ts
    ).otherwise(F.lit("—"))


def capture_view(
    captures: DataFrame, mime: str = "", search: str = "", sort: str = "first-newest"
) -> DataFrame:
    """The capture table as shown, in one of the eight orders of ``SORTS``."""
    column, way = SORTS[sort]
    key = F.collate(column, "UNICODE") if column == "original" else F.col(column)
    order = key.desc() if way == "desc" else key.asc()
    return (
        capture_filter(captures, mime, search)
        .orderBy(order, "urlkey")
        .select(
            "host", "urlkey", "original", "mimetype",
            archive_day(F.col("timestamp")).alias("first_day"),
            archive_day(F.col("endtimestamp")).alias("last_day"),
            "groupcount",
        )
    )


def capture_ranks(captures: DataFrame, mime: str = "", search: str = "") -> DataFrame:
    """(sort, rank, host, urlkey): the place of every row of the view in each order, from 1.

    URLs are in the order of their characters. No order is worked out in one task.
    """
    shown = capture_filter(captures, mime, search)

    def number(c: str, way: str) -> Column:
        value = F.rpad(c, 14, "0").cast("double") if c.endswith("timestamp") else F.col(c).cast("double")
        return value if way == "asc" else F.coalesce(-value, F.lit(float("inf")))

    forward = {name: by for name, by in SORTS.items() if by != ("original", "desc")}
    rows = [
        F.struct(
            F.lit(name).alias("sort"),
            (F.lit(0.0) if c == "original" else number(c, way)).alias("number"),
            (F.col(c) if c == "original" else F.lit("")).alias("text"),
        )
        for name, (c, way) in forward.items()
    ]
    placed = numbered(shown.select("host", "urlkey", F.inline(F.array(*rows))), ["sort"], ["number", "text", "urlkey"], "n")
    total = F.broadcast(shown.agg(F.count("*").alias("total")))  # one row
    # No two rows share a URL, so one of its orders is the other one read backwards.
    back = F.array(
        F.struct("sort", (F.col("n") + 1).alias("rank")),
        F.struct(F.when(F.col("sort") == "url-az", F.lit("url-za")).alias("sort"), (F.col("total") - F.col("n")).alias("rank")),
    )
    every = placed.crossJoin(total).select("host", "urlkey", F.inline(back))
    return every.filter("sort IS NOT NULL").select("sort", "rank", "host", "urlkey")


def capture_count(captures: DataFrame, mime: str = "", search: str = "") -> DataFrame:
    """Rows per host that the view shows, of all."""
    every = captures.groupBy("host").agg(F.count("*").alias("total"))
    shown = capture_filter(captures, mime, search).groupBy("host").agg(F.count("*").alias("visible"))
    return every.join(shown, "host", "left").select("host", F.coalesce("visible", F.lit(0)).alias("visible"), "total")


def capture_mimes(captures: DataFrame) -> DataFrame:
    """Distinct MIME types, text/html first, then by name."""
    return (
        captures.filter(F.coalesce("mimetype", F.lit("")) != "")
        .select("mimetype").distinct()
        .orderBy(F.col("mimetype") != "text/html", "mimetype")
    )


def capture_urls(captures: DataFrame, mime: str = "", search: str = "") -> DataFrame:
    """URLs for the text export, in index order rather than in the order shown."""
    return (
        capture_filter(captures, mime, search)
        .filter(F.coalesce("original", F.lit("")) != "")
        .orderBy("host", "urlkey")
        .select("host", "urlkey", "original")
    )
