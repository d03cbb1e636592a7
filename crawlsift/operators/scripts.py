"""Script discovery in pages, and the bodies that go with the discovered URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import fixed, markup
from crawlsift.functions.regex import jvm
from crawlsift.functions.text import rmatch
from crawlsift.functions.urls import resolve, same_site
from crawlsift.operators.candidates import CHUNK_IDX, page_candidates
from crawlsift.operators.endpoints import with_base

SPREAD = 64


def inline_scripts(pages: DataFrame) -> DataFrame:
    """One row per non-blank script block without a source: (..., block_idx, text)."""
    keys = [c for c in pages.columns if c != "html"]
    toks = pages.select(*keys, markup.tokens(F.col("html")).alias("__tok"))
    return toks.select(
        *keys, F.posexplode(markup.script_bodies(F.col("__tok"))).alias("block_idx", "text")
    )


def script_sources(pages: DataFrame) -> DataFrame:
    """Distinct script and JSON URLs of each page, in order of discovery.

    ``pages(scan_id, page_url, html)`` -> (scan_id, page_url, base_*, url, source_idx).
    """
    return sources_of(page_candidates(with_base(pages), dom=False, inline=False, endpoints=False, sources=True))


def sources_of(cands: DataFrame) -> DataFrame:
    """``script_sources`` from the candidates of pages, found with ``sources``."""
    added = {"unit", "unit_idx", "idx", "pos", "match", "value", "before", "after"}
    keys = [c for c in cands.columns if c not in added]
    tag = F.col("__tag")
    df = cands.filter((F.col("unit") == "dom") | ((F.col("unit") == "inline") & (F.col("idx") == CHUNK_IDX)))
    df = df.select(*keys, "unit", "unit_idx", "pos", "value", markup.start_tag(F.col("match")).alias("__tag"))

    def found(way, ref):
        return F.struct(F.lit(way).alias("way"), ref.alias("ref"))

    is_script = rmatch(tag, r"(?i)^<script[\t\n\f\r />]")
    script = F.when(is_script, F.nullif(markup.attribute(tag, "src"), F.lit("")))
    href = F.when(F.contains(F.lower(tag), F.lit("href")), markup.attribute(tag, "href"))
    # Sources come first, then links to scripts, then names in script text.
    refs = F.when(F.col("unit") == "inline", F.array(found(2, F.col("value")))).otherwise(F.array(found(0, script), found(1, href)))
    df = df.select(*keys, "unit_idx", "pos", F.inline(refs))
    df = df.filter(F.col("ref").isNotNull() & ((F.col("way") != 1) | rmatch(F.col("ref"), jvm(fixed.SCRIPT_HREF))))
    df = resolve(df, "ref", "base", "src")
    df = df.filter(same_site(F.col("src_host"), F.col("base_host")))
    nth = ["way", "unit_idx", "pos"]
    by_page = Window.partitionBy("scan_id", "src_href").orderBy(*nth)
    df = df.withColumn("__n", F.row_number().over(by_page)).filter("__n = 1")
    order = Window.partitionBy("scan_id").orderBy(*nth)
    return df.select(
        *keys,
        F.col("src_href").alias("url"),
        F.row_number().over(order).alias("source_idx"),
    )


def usable_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies with an OK status and a textual or unstated content type, cut to the limit if there is one."""
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    usable = bodies.filter(
        F.col("status").between(200, 299)
        & ((kind == "") | rmatch(kind, jvm(fixed.TEXT_CONTENT_TYPE)))
        & (F.col("body") != "")
    )
    if fixed.BODY_CHARS is None:
        return usable
    return usable.withColumn("body", F.substring("body", 1, fixed.BODY_CHARS))


def spread_join(many: DataFrame, per_key: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join that splits a hot ``key`` of ``many`` over several tasks.

    ``many`` gets a slot from ``spread_by``; ``per_key`` is copied only to the slots in
    which its key occurs, so the copies never outnumber the result.
    """
    slot = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")
    many = many.withColumn("__slot", slot)
    slots = many.select(key, "__slot").distinct()
    return many.join(per_key.join(slots, key), [key, "__slot"]).drop("__slot")


def script_bodies(sources: DataFrame, bodies: DataFrame) -> DataFrame:
    """Discovered scripts with their usable body."""
    return spread_join(sources, usable_bodies(bodies), "url", "scan_id")
