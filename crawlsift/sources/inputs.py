"""Scan inputs derived from the given tables by plain expressions.

The given pages hold only links and one trivial script each, so they are enriched with
forms, frames, scripts and script calls; network entries, captures and navigation come
from the events, each joined to a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.functions.stage import spread
from crawlsift.operators.endpoints import with_base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain texts: (doc_id, source, text)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


SCAN_PAGES_SQL = """
SELECT page_id, url, host, scheme, concat(html,
 '<form action="/api/v', page_id % 3, '/login?next=home" method="post"></form><form action=""></form>',
 '<iframe src="//', host, '/embed/', page_id % 7, '"></iframe><link href="/static/app.css">',
 '<img src="/img/', page_id % 5, '.png"><script src="/js/app.js?v=', page_id % 4, '"></script>',
 '<a href="../up/./x/', page_id % 6, '?b=2&amp;a=1#frag">u</a><a href="mailto:x@example.com">m</a>',
 '<a href="https://other.invalid/out">o</a>',
 '<script>fetch("/api/v1/users?id=', page_id % 11, '");axios.post("api/v2/items",{{params:{{limit:1,offset:2}}}});',
 'xhr.open("DELETE","/api/v1/items/', page_id % 9, '");var baseUrl = "https://', host, '/rest/q";',
 'var chunk="/chunks/', page_id % 8, '.js";var token = "', md5(cast(page_id % 50 as string)), '";',
 'var k="Ab3', substr(md5(cast(page_id % 20 as string)), 1, 24), 'Z";var n="your_token_placeholder_here";</script>') AS html
FROM (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
             regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM {pages}) p
"""

BODIES_SQL = """
SELECT DISTINCT concat(scheme, '://', host, '/js/app.js?v=', v) AS url,
 CASE WHEN v = 3 THEN 404 ELSE 200 END AS status,
 CASE WHEN v = 2 THEN 'image/png' ELSE 'application/javascript' END AS content_type,
 concat('router.get("/api/v1/orders/', v, '");$.ajax("/api/v3/cart?x=', v, '");var s="', md5(host), '";') AS body
FROM (SELECT scheme, host, page_id % 4 AS v FROM {scan_pages}) q
"""


def scan_pages(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """(scan_id, page_url, html, scan_time): one scan per page, a second apart."""
    pages = spread(table(spark, sf_dir, "pages")) if pages is None else pages
    df = pages.sparkSession.sql(SCAN_PAGES_SQL, pages=pages)
    return df.select(
        F.col("page_id").alias("scan_id"),
        F.col("url").alias("page_url"),
        "html",
        scan_time("page_id").alias("scan_time"),
    )


def scan_time(page_id: str) -> Column:
    """Start of the scan of a page: a second after that of the page before."""
    return F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {page_id})")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.lit(""))
    scanned = spark.sql(SCAN_PAGES_SQL, pages=pages)
    return spark.sql(BODIES_SQL, scan_pages=scanned)


def event_pages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, parsed: bool = False) -> DataFrame:
    """Every event with the page it falls on: (event columns, pid, page_url, page_host).

    With ``parsed`` the page's URL is taken apart before the join, once per page.
    """
    events = spread(table(spark, sf_dir, "events")) if events is None else events
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pid"),
        F.col("url").alias("page_url"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("page_host"),
    )
    numbered = events.withColumn("pid", F.col("event_id") % F.lit(table(spark, sf_dir, "pages").count()))
    return numbered.join(with_base(pages) if parsed else pages, "pid")


def network_entries(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Network entries, with the parts of their page's URL: one scan per page."""
    return _entries(spark, sf_dir, events, F.col("pid").alias("scan_id"))


def tab_entries(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Network entries as scans of tabs: one scan per event; errors close the tab."""
    return _entries(
        spark, sf_dir, events, F.col("event_id").alias("scan_id"), (F.col("event_type") == "error").alias("tombstone")
    )


def _entries(spark: SparkSession, sf_dir: str, events: DataFrame | None, *more: Column) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.concat(F.lit("/api/v1/click?id="), F.expr("event_id % 13")))
        .when(kind == "view", F.lit("/img/a.png"))
        .when(kind == "signup", F.concat(F.lit("https://api."), "page_host", F.lit("/signup/")))
        .when(kind == "purchase", F.lit("https://tracker.invalid/p"))
        .otherwise(F.lit("/rest/errors"))
    )
    initiator = (
        F.when(kind == "click", F.lit("fetch")).when(kind == "view", F.lit("img"))
        .when(kind == "signup", F.lit("xmlhttprequest")).when(kind == "purchase", F.lit("beacon"))
        .otherwise(F.lit(""))
    )
    found = event_pages(spark, sf_dir, events, parsed=True)
    return found.select(
        F.col("event_id").alias("entry_id"), *more, F.col("user_id").alias("tab_id"), "page_url", "ts",
        name.alias("name"), initiator.alias("initiator_type"), *[c for c in found.columns if c.startswith("base_")],
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return event_pages(spark, sf_dir).select(
        n.alias("source_pos"),
        F.col("page_url").alias("original"),
        F.expr("regexp_replace(regexp_replace(page_url, '^https?://', ''), '#.*$', '')").alias("urlkey"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/css' ELSE '' END").alias("mimetype"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN '404' WHEN event_id % 17 = 0 THEN '503' ELSE '200' END").alias("statuscode"),
        F.expr("cast(event_id % 3 as string)").alias("digest"),
    )


def navigation(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return event_pages(spark, sf_dir, events).select(
        F.col("user_id").alias("tab_id"), F.col("event_id").alias("nav_id"), "ts",
        F.col("page_url").alias("url"), "event_type",
    )
