"""The log of findings per host: facts, roll-ups, statistics and retention.

A log is kept as facts: per host, finding and field each distinct value with its first and
last sighting. Facts merge by minimum and maximum alone, so parts may overlap: a batch that
is replayed, or a scan that arrives in pieces, changes nothing that is there already. How often
a finding was seen is the number of its distinct sightings, which are facts too. The roll-up
is a view of the facts. Its lists hold distinct values in first-seen order, in pages of
bounded size: a key on a million pages is many rows, none of them large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import fixed
from crawlsift.functions.filters import severity_rank
from crawlsift.functions.text import trim
from crawlsift.functions.stage import paged, ranked_globally, with_pages
from crawlsift.functions.urls import host_of, root_domain, without_fragment
from crawlsift.operators.endpoints import identity

SLOTS = 64
SEEN = ["scan_time", "scan_id", "phase", "source_idx", "pattern_idx", "pos"]
KEYS = ["host", "key"]
#: The field whose values are the sightings of a finding, one for each scan and source.
SIGHTING = "sighting"

_AT = "struct<scan_time: timestamp_ntz, scan_id: bigint, phase: int, source_idx: int, pattern_idx: int, pos: bigint, nth: int>"
#: Columns of facts, as a stored log holds them.
FACTS = f"host string, key string, field string, value string, first_at {_AT}, last_at {_AT}, text string"


def _seen(*more: Column) -> Column:
    return F.struct(*[F.col(c) for c in SEEN], *more)


def _sighting(*parts: str) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def _facts(found: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(host, key, field, value, first_at, last_at, text) of findings with ``host`` and ``key``.

    Contexts differ from finding to finding, so only the first one that is not empty is kept,
    as the text of a field of its own.
    """
    none = F.lit(None).cast("string")
    parts = [
        F.transform(values, lambda v, i: F.struct(
            F.lit(name).alias("field"), v.alias("value"), none.alias("text"), _seen(i.alias("nth")).alias("at")))
        for name, values in fields.items()
    ]
    given = F.filter(F.array("context"), lambda c: c != "")
    parts.append(F.transform(given, lambda c, i: F.struct(
        F.lit("context").alias("field"), F.lit("").alias("value"), c.alias("text"), _seen(i.alias("nth")).alias("at"))))
    rows = found.select(*KEYS, F.inline(F.flatten(F.array(*parts))))
    return rows.groupBy(*KEYS, "field", "value").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("text", "at").alias("text"),
    )


def merge_facts(stored: DataFrame, *more: DataFrame) -> DataFrame:
    """The facts of all parts together; parts may overlap."""
    for part in more:
        stored = stored.unionByName(part)
    return stored.groupBy(*KEYS, "field", "value").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("text", "first_at").alias("text"),
    )


def _lists(facts: DataFrame, limits: dict[str, int | None], size: int) -> DataFrame:
    """First distinct values per host and key for several fields, as pages of ordered arrays."""
    value = trim(F.col("value"))
    firsts = (
        facts.filter(F.col("field").isin(*limits) & (value != ""))
        .groupBy(*KEYS, "field", value.alias("v")).agg(F.min("first_at").alias("at"))
    )
    return paged(firsts, KEYS, list(limits), size, limits)


def _of(field: str, value: Column, given: bool = False) -> Column:
    """``value`` on the facts of one field, null on others; ``given`` leaves out empty values."""
    here = F.col("field") == field
    return F.when(here & (F.col("value") != "") if given else here, value)


def _main(facts: DataFrame, *more: Column) -> DataFrame:
    """One row per host and key."""
    return facts.groupBy(*KEYS).agg(
        *more,
        F.min_by("text", _of("context", F.col("first_at"))).alias("context"),
        F.min(_of(SIGHTING, F.col("first_at.scan_time"))).alias("first_seen"),
        F.max(_of(SIGHTING, F.col("last_at.scan_time"))).alias("last_seen"),
        F.count(_of(SIGHTING, F.lit(1))).alias("occurrences"),
    )


def _top_per_host(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """First n rows per host; a large host is cut in slots before it meets in one task."""
    if n is None:
        return df
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))
    part = Window.partitionBy("host", "__slot").orderBy(*order)
    whole = Window.partitionBy("host").orderBy(*order)
    df = df.withColumn("__slot", slot)
    df = df.withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= n)
    df = df.withColumn("__n", F.row_number().over(whole)).filter(F.col("__n") <= n)
    return df.drop("__slot", "__n")


def secret_facts(found: DataFrame) -> DataFrame:
    """Facts of secrets per host and value."""
    df = found.filter((F.col("host") != "") & (trim(F.col("value")) != ""))
    df = df.withColumns({"key": trim(F.col("value")), "host": F.lower("host")})
    columns = {"ids": "id", "names": "name", "sources": "source", "page_urls": "page_url", "severity": "severity"}
    fields = {field: F.array(c) for field, c in columns.items()}
    return _facts(df, {**fields, SIGHTING: F.array(_sighting("scan_id", "id", "value", "source"))})


def secret_log(facts: DataFrame, size: int = fixed.LIST_PAGE) -> DataFrame:
    """The host log of secrets, from their facts: a row per host, value and page of its lists."""
    best = F.struct(severity_rank(F.col("value")).alias("rank"), F.col("value").alias("severity"))
    main = _main(
        facts,
        F.max_by("value", _of("names", F.col("last_at"), given=True)).alias("name"),
        F.min(_of("severity", best)).alias("best"),
    )
    main = main.select(
        *KEYS, F.col("key").alias("value"), F.coalesce("name", F.lit("Unknown Secret")).alias("name"),
        F.col("best.severity").alias("severity"), _one(F.col("context")).alias("contexts"),
        "first_seen", "last_seen", "occurrences",
    )
    order = [severity_rank(F.col("severity")), F.col("last_seen").desc(), F.col("key")]
    main = _top_per_host(main, order, fixed.LOG_SECRETS)
    limits = {
        "ids": fixed.LOG_RULES, "names": fixed.LOG_RULES,
        "sources": fixed.LOG_SOURCES, "page_urls": fixed.LOG_PAGES,
    }
    return with_pages(main, _lists(facts, limits, size), KEYS, list(limits)).select(
        *KEYS, "page", "value", "name", "severity", *limits, "contexts", "first_seen", "last_seen", "occurrences",
    )


def host_secrets(found: DataFrame, size: int = fixed.LIST_PAGE) -> DataFrame:
    """Secrets per host and value over all scans."""
    return secret_log(secret_facts(found), size)


def endpoint_facts(found: DataFrame) -> DataFrame:
    """Facts of endpoints per host and method with URL; fragments do not count."""
    df = found.filter((F.col("host") != "") & ((F.col("url") != "") | (F.col("path") != "")))
    df = df.withColumn("__identity", identity())
    df = df.withColumns({
        "host": F.lower("host"), "method": F.upper("method"), "url": without_fragment(F.col("href")),
    })
    df = df.withColumn("key", F.concat(
        "method", F.lit(":"), F.coalesce(F.nullif("url", F.lit("")), F.col("path"))))
    columns = {
        "query_samples": "query", "kinds": "kind", "sources": "source", "page_urls": "page_url",
        "method": "method", "url": "url", "path": "path",
    }
    fields = {field: F.array(c) for field, c in columns.items()}
    return _facts(df, {
        **fields, "params": F.col("params"), SIGHTING: F.array(_sighting("scan_id", "__identity", "source")),
    })


def endpoint_log(facts: DataFrame, size: int = fixed.LIST_PAGE) -> DataFrame:
    """The host log of endpoints, from their facts: a row per host, key and page of its lists."""
    main = _main(
        facts,
        F.min_by("value", _of("method", F.col("first_at"))).alias("method"),
        F.min_by("value", _of("url", F.col("first_at"))).alias("url"),
        F.max_by("value", _of("path", F.col("last_at"), given=True)).alias("path"),
    )
    main = main.select(
        *KEYS, "method", "url", F.coalesce("path", F.lit("/")).alias("path"), host_of(F.col("url")).alias("url_host"),
        _one(F.col("context")).alias("contexts"), "first_seen", "last_seen", "occurrences",
    )
    main = _top_per_host(main, [F.col("last_seen").desc(), F.col("key")], fixed.LOG_ENDPOINTS)
    limits = {
        "query_samples": fixed.LOG_QUERIES, "params": fixed.LOG_PARAMS, "kinds": fixed.LOG_KINDS,
        "sources": fixed.LOG_SOURCES, "page_urls": fixed.LOG_PAGES,
    }
    return with_pages(main, _lists(facts, limits, size), KEYS, list(limits)).select(
        *KEYS, "page", "method", "url", "path", "url_host", *limits, "contexts", "first_seen", "last_seen", "occurrences",
    )


def host_endpoints(found: DataFrame, size: int = fixed.LIST_PAGE) -> DataFrame:
    """Endpoints per host and method with URL over all scans."""
    return endpoint_log(endpoint_facts(found), size)


def _one(context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.array(context)).otherwise(
        F.array().cast("array<string>")
    )


def host_stats(secrets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Secrets, endpoints and distinct pages per host, from the facts of both.

    Counts come from distinct keys and pages, which are spread by key and by page; only
    their numbers meet per host.
    """

    def marked(facts, kind):
        return facts.select("host", "key", F.lit(kind).alias("kind"), "field", "value", F.col("last_at.scan_time").alias("at"))

    both = marked(secrets, "s").unionByName(marked(endpoints, "e"))
    keys = both.filter(F.col("field") == SIGHTING).groupBy("host", "key", "kind").agg(F.max("at").alias("at"))
    counts = keys.groupBy("host").agg(
        F.count(F.when(F.col("kind") == "s", 1)).alias("unique_secrets"),
        F.count(F.when(F.col("kind") == "e", 1)).alias("unique_endpoints"),
        F.max("at").alias("updated_at"),
    )
    pages = both.filter(F.col("field") == "page_urls").select("host", trim(F.col("value")).alias("page"))
    pages = pages.filter("page <> ''").distinct().groupBy("host").agg(F.count("*").alias("page_count"))
    return counts.join(pages, "host", "left").select(
        "host", "unique_secrets", "unique_endpoints",
        F.coalesce("page_count", F.lit(0)).cast("bigint").alias("page_count"), "updated_at",
    )


def retention_prune(stats: DataFrame, keep_host: str | None = None) -> DataFrame:
    """Hosts to remove: the oldest half of the logs, at least one, never ``keep_host``."""
    others = stats.select("host", "updated_at")
    if keep_host:
        others = others.filter(F.col("host") != keep_host)
    ranked = ranked_globally(others, [F.col("updated_at").asc_nulls_first(), F.col("host")])
    quota = F.greatest(F.lit(1), F.floor(F.col("total") / 2))
    return ranked.filter(F.col("rank") <= quota).select("host", "updated_at")


def count_label(n: Column) -> Column:
    """Badge text: nothing for zero, 99+ above 99."""
    return F.when(n > 99, F.lit("99+")).when(n > 0, n.cast("string")).otherwise(F.lit(""))


def host_report(stats: DataFrame) -> DataFrame:
    """Statistics, badge text and lookup links, one row per host."""
    part = {"host": F.col("host"), "root": root_domain(F.col("host"))}
    return stats.select(
        "host", "unique_secrets", "unique_endpoints", "page_count", "updated_at",
        count_label(F.col("unique_secrets")).alias("badge"),
        *[
            F.concat(F.lit(head), part[which], F.lit(rest)).alias(f"{tab}_link")
            for tab, head, which, rest in fixed.LOOKUPS
        ],
    )
