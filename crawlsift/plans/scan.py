"""The whole scan: markup, inline scripts, page text and script bodies.

``pages(scan_id, page_url, html, scan_time)`` and ``bodies(url, status, content_type,
body)`` go in; endpoint and secret findings come out. Markup and bodies are read once:
``page_table`` and ``body_table`` write every raw match with a short window around it, and
all detectors work on these narrow tables, whatever the number of pages that load a body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.operators import endpoints as ep
from crawlsift.operators import secrets as sec
from crawlsift.operators.candidates import page_candidates, text_candidates
from crawlsift.operators.scripts import sources_of, spread_join, usable_bodies
from crawlsift.functions.stage import pin, settle
from crawlsift.functions.urls import origin, same_site
from crawlsift.sources.rules import Rule

SECRET_COLUMNS = [
    "scan_id", "page_url", "host", "id", "name", "severity", "value", "context", "source",
    "scan_time", *sec.ORDER,
]


def page_table(pages: DataFrame, rules: list[Rule] | None) -> DataFrame:
    """Raw matches of all detectors in pages, as a written table: the one pass over the markup.

    Without rules there are matches for endpoints and script URLs only.
    """
    return settle(page_candidates(ep.with_base(pages), rules=rules, sources=True), "page-matches")


def body_table(bodies: DataFrame, rules: list[Rule] | None) -> DataFrame:
    """Raw matches of all detectors in script bodies, as a written table: the one pass over the bodies."""
    return settle(text_candidates(_texts(bodies), rules=rules), "body-matches")


def page_endpoints(pages: DataFrame, dom=True, inline=True, text=True) -> DataFrame:
    """Endpoint findings of the pages themselves, by the detectors asked for."""
    cands = page_candidates(ep.with_base(pages), dom=dom, inline=inline, endpoints=text)
    return ep.page_endpoints(cands, dom=dom)


def secrets_of(cands: DataFrame, rules: list[Rule]) -> DataFrame:
    """Secret findings of page texts, from the raw matches of pages."""
    df = sec.raw_secrets(cands, rules)
    df = sec.capped_secrets(df, ["scan_id", "page_url"])
    return df.select(
        "scan_id", "page_url", F.col("base_host").alias("host"), "id", "name", "severity",
        "value", "context", F.col("page_url").alias("source"), "scan_time",
        F.lit(ep.PAGE_TEXT).alias("phase"), F.lit(0).alias("source_idx"), "pattern_idx", "pos",
    )


def text_secrets(texts: DataFrame, rules: list[Rule], scope: list[str]) -> DataFrame:
    """Secret findings of plain texts; ``scope`` names the columns of one source."""
    cands = text_candidates(texts, endpoints=False, rules=rules)
    return sec.capped_secrets(sec.raw_secrets(cands, rules), scope)


def page_sources(matches: DataFrame) -> DataFrame:
    """Script URLs per page with what findings need of the page, as a written table.

    ``matches`` is a ``page_table``. The list is what bodies are fetched by, and both body
    detectors join to it.
    """
    return settle(sources_of(matches).withColumnRenamed("url", "source"), "sources")


def _texts(bodies: DataFrame) -> DataFrame:
    return usable_bodies(bodies).select(F.col("url").alias("source"), F.col("body").alias("text"))


_HOST = ep.ANY_PAGE.removeprefix("https://")
_ANY_BASE = {"href": ep.ANY_PAGE + "/", "scheme": "https", "authority": _HOST, "host": _HOST, "path": "/", "search": ""}


def endpoint_table(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Endpoints in the raw matches of pages and bodies together, as a written table.

    Those of pages are on the page's host or site. Rows of bodies have a ``source``; their URLs are on a stand-in page until they are joined to
    the pages that load them.
    """
    both = pages.withColumn("source", F.lit(None).cast("string")).unionByName(bodies, allowMissingColumns=True)
    of_body = F.col("source").isNotNull()
    both = both.withColumns({
        f"base_{part}": F.when(of_body, F.lit(value)).otherwise(F.col(f"base_{part}")) for part, value in _ANY_BASE.items()
    })
    columns = ["scan_id", "page_url", "scan_time", "source", "base_host", *RAW, "url", "phase", "source_idx"]
    return settle(ep.raw_endpoints(both, page=F.col("source").isNull()).select(*columns), "raw-endpoints")


#: What body findings take over from raw endpoints.
RAW = [
    "unit", "kind", "path", "query", "method", "params", "context", "raw_match", "absolute", "res_host", "href", "pattern_idx", "pos",
]


def page_findings(raw: DataFrame) -> DataFrame:
    """Endpoint findings of the pages themselves, from an ``endpoint_table``."""
    return ep.page_findings(raw.filter(F.col("source").isNull()))


def body_findings(sources: DataFrame, raw: DataFrame) -> DataFrame:
    """Endpoint findings of loaded scripts, from an ``endpoint_table``, joined to the pages that load them."""
    found = raw.filter(F.col("source").isNotNull()).select("source", *RAW, F.col("url").alias("found_url"))
    df = spread_join(sources, found, "source", "scan_id")
    df = df.filter(~F.col("absolute") | same_site(F.col("res_host"), F.col("base_host")))
    own = F.startswith(F.col("found_url"), F.lit(ep.ANY_PAGE + "/"))
    foreign = F.startswith(F.col("raw_match"), F.lit("//"))
    df = pin(df, {
        # Relative paths belong to the site of the page that loads the script.
        "url": F.when(F.col("absolute"), F.col("found_url"))
        .when(foreign, F.concat(F.col("base_scheme"), F.regexp_replace("found_url", "^https", "")))
        .when(own, F.concat(origin("base"), F.expr(f"substring(found_url, {len(ep.ANY_PAGE) + 1})")))
        .otherwise(F.col("found_url")),
        "host": F.col("base_host"),
        "phase": F.lit(ep.BODY),
    })
    df = df.withColumn("href", F.when(F.col("absolute"), F.col("href")).otherwise(F.col("url")))
    return ep.first_per_source(df)


def body_secrets(sources: DataFrame, matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """Secret findings of loaded scripts, from a ``body_table``, joined to the pages that load them."""
    found = sec.capped_secrets(sec.raw_secrets(matches, rules), ["source"]).select(
        "source", "id", "name", "severity", "value", "context", "pattern_idx", "pos"
    )
    df = spread_join(sources, found, "source", "scan_id")
    return df.withColumns({"host": F.col("base_host"), "phase": F.lit(ep.BODY)}).select(
        *SECRET_COLUMNS
    )


def all_endpoints(
    pages: DataFrame, bodies: DataFrame, sources: DataFrame, network: DataFrame | None = None
) -> DataFrame:
    """Endpoint findings of every detector, before the scan-wide dedupe.

    ``pages`` and ``bodies`` are the tables of raw matches. ``network`` are findings of
    ``network_endpoints`` with scan_id and order columns; they come first, as they are on record
    when a scan starts.
    """
    raw = endpoint_table(pages, bodies)
    found = page_findings(raw).unionByName(body_findings(sources, raw))
    return network.select(*ep.COLUMNS).unionByName(found) if network is not None else found


def all_secrets(
    pages: DataFrame, bodies: DataFrame, sources: DataFrame, rules: list[Rule]
) -> DataFrame:
    """Secret findings of every detector, before the scan-wide dedupe, from the tables of raw matches."""
    return secrets_of(pages, rules).unionByName(body_secrets(sources, bodies, rules))


def first_endpoints(found: DataFrame) -> DataFrame:
    """First finding of each endpoint in a scan, over all detectors."""
    first = Window.partitionBy("scan_id", ep.identity()).orderBy(*ep.ORDER)
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def first_secrets(found: DataFrame) -> DataFrame:
    """First finding of each (id, value, source) in a scan."""
    first = Window.partitionBy("scan_id", "id", "value", "source").orderBy(*sec.ORDER)
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def logged_endpoints(found: DataFrame) -> DataFrame:
    """What a scan hands to the host log: each (endpoint, source) once."""
    first = Window.partitionBy("scan_id", ep.identity(), "source").orderBy(*ep.ORDER)
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
