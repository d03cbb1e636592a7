"""From raw matches to endpoint findings: resolve, filter, dedupe, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import fixed, markup
from crawlsift.functions.filters import endpoint_noise
from crawlsift.functions.params import around, guessed_method, nearby_names, query_names
from crawlsift.functions.stage import dealt, pin
from crawlsift.functions.text import first_values, rmatch, snippet, tail, trim
from crawlsift.functions.urls import resolve, same_site
from crawlsift.operators.candidates import CHUNK_IDX, DOM_GROUPS

# Scan phases in the order in which their findings are recorded.
NETWORK, DOM, INLINE, PAGE_TEXT, BODY = range(5)

# ``href`` is the normalised form of ``url``; the host log is keyed by it.
ORDER = ["phase", "source_idx", "pattern_idx", "pos"]
COLUMNS = [
    "scan_id", "page_url", "host", "path", "query", "method", "params", "kind", "source",
    "context", "raw_match", "url", "href", "scan_time", *ORDER,
]
# Stand-in origin for script bodies, which are read once for all pages that load them.
ANY_PAGE = "https://page.invalid"


def with_base(pages: DataFrame, url: str = "page_url") -> DataFrame:
    """Parse the page URL into ``base_*`` columns; pages without a web URL are dropped."""
    return resolve(pages, url, None, "base").filter(F.col("base_host").isNotNull())


def _between_quotes(match: Column) -> Column:
    return F.regexp_extract(match, r"""['"`]([^'"`]*)['"`]\z""", 1)


def _around(margin: int) -> Column:
    return snippet(
        F.concat(
            tail(F.col("before"), margin), F.col("match"), F.substring(F.col("after"), 1, margin)
        )
    )


def _dom_columns(df: DataFrame) -> DataFrame:
    df = df.withColumn("__tag", markup.start_tag(F.col("match")))
    df = df.withColumns({"__name": markup.tag_name(F.col("__tag")), "__pairs": markup.attribute_pairs(F.col("__tag"))})
    wanted, group = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (names, attribute) in enumerate(DOM_GROUPS):
        wanted = F.when(F.col("__name").isin(names), F.lit(attribute)).otherwise(wanted)
        group = F.when(F.col("__name").isin(names), F.lit(i)).otherwise(group)
    attr = markup.decode_entities(markup.pair_value(F.col("__pairs"), wanted))
    form = F.col("__name") == "form"
    method = markup.decode_entities(markup.pair_value(F.col("__pairs"), F.lit("method")))
    verb = F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))
    open_elements = F.col("__name").isin(*markup.OPEN)
    closing = F.lit(None).cast("string")
    whole = F.concat(F.col("match"), F.col("after"))
    for name in markup.OPEN:
        part = F.regexp_extract(whole, markup.closing(name), 0)
        closing = F.when(F.col("__name") == name, part).otherwise(closing)
    element = F.when(~open_elements, F.col("match")).when(
        closing != "", closing
    ).otherwise(whole)
    return df.withColumns({
        "__attr": F.when(form & (attr == ""), F.col("base_path")).otherwise(attr),
        "__group": group,
        "__verb": F.when(form, verb).otherwise(F.lit("GET")),
        "__element": F.substring(snippet(element), 1, fixed.DOM_CONTEXT),
    })


def raw_endpoints(cands: DataFrame, dom: bool = True, page: Column | None = None) -> DataFrame:
    """Candidate rows with ``base_*`` columns -> endpoint rows.

    Adds ``res_host`` (host of the resolved URL) and ``absolute`` for host checks. Rows of a ``page``, all
    without that condition, are checked here, before their contexts are cut.
    """
    unit = F.col("unit")
    is_dom, is_inline, is_text = unit == "dom", unit == "inline", unit == "text"
    df = cands.filter(is_dom | (F.col("idx") < CHUNK_IDX))
    if dom:
        df = _dom_columns(df)
    dom_or = lambda name, other: F.when(is_dom, F.col(name)).otherwise(other) if dom else other
    quoted = _between_quotes(F.col("match"))
    kinds = F.array(*[F.lit(k) for k, _ in fixed.TEXT_PATTERNS])
    xhr = [k for k, _ in fixed.TEXT_PATTERNS].index("xhr")
    stated = F.regexp_extract(F.col("match"), r"""['"`]([A-Z]+)['"`]""", 1)
    df = pin(df, {
        "raw": dom_or("__attr", F.when(
            is_inline & (F.col("idx") == 0), F.col("match")).otherwise(quoted)),
        "kind": F.when(is_text, F.get(kinds, F.col("idx"))).otherwise(unit),
        "phase": F.when(is_dom, F.lit(DOM)).when(is_inline, F.lit(INLINE)).otherwise(F.lit(PAGE_TEXT)),
        "source_idx": F.col("unit_idx"),
        "pattern_idx": dom_or("__group", F.col("idx")),
    })
    df = pin(df, {"raw": F.when(is_text, F.col("raw")).otherwise(trim(F.col("raw")))})
    wanted = is_text | (
        F.when(is_dom, ~rmatch(F.col("raw"), fixed.DOM_SKIP)).otherwise(
            ~rmatch(F.col("raw"), fixed.INLINE_SKIP)
            & (F.col("raw") != "/")
            & ~rmatch(F.col("raw"), fixed.BARE_WORD)
        )
    )
    df = df.filter(F.col("raw").isNotNull() & (F.col("raw") != "") & wanted)

    absolute = is_text & F.startswith(F.col("raw"), F.lit("http"))
    cut = F.regexp_extract(F.col("raw"), r"^[^?]*", 0)
    df = df.withColumns({
        "absolute": absolute,
        "__path": _bare(cut),
        "__query": F.expr("substring(raw, length(regexp_extract(raw, '^[^?]*', 0)) + 2)"),
    })
    plain = F.when(F.col("__query") != "", F.concat_ws("?", "__path", "__query")).otherwise(F.col("__path"))
    df = df.withColumns({
        "__ref": F.when(is_text & ~F.col("absolute"), plain).otherwise(F.col("raw")),
        # Paths in script text are taken from the site root, others from the page.
        "base_path": F.when(is_text, F.lit("/")).otherwise(F.col("base_path")),
        "base_search": F.when(is_text, F.lit("")).otherwise(F.col("base_search")),
    })
    df = resolve(df, "__ref", "base", "res")
    relative = is_text & ~F.col("absolute")
    df = df.filter(relative | F.col("res_href").isNotNull())
    df = pin(df, {
        "path": F.when(relative, F.col("__path")).otherwise(_bare(F.col("res_path"))),
        "query": F.when(relative, F.col("__query")).otherwise(F.expr("substring(res_search, 2)")),
    })
    own = _on_own_host() if page is None else ~page | _on_own_host()
    df = df.filter(own & ~endpoint_noise(F.col("path"), F.col("kind")))
    parts = (F.col("before"), F.col("match"), F.col("after"))
    df = df.withColumns({
        "__names": query_names(F.col("query")),
        "__win": F.when(is_text, around(*parts, fixed.PARAM_BEFORE, fixed.PARAM_AFTER)),
        "__near": F.when(
            is_text, F.upper(around(*parts, fixed.METHOD_BEFORE, fixed.METHOD_AFTER))
        ),
    })
    names = F.col("__names")
    both = first_values(
        F.array_distinct(F.concat(names, nearby_names(F.col("__win")))), fixed.PARAMS_PER_ENDPOINT
    )
    return pin(df, {
        "method": dom_or("__verb", F.when(is_inline, F.lit("GET"))
                         .when(F.col("idx") == xhr, stated)
                         .otherwise(guessed_method(F.col("__near")))),
        "url": F.when(F.col("absolute"), F.col("raw")).otherwise(F.coalesce("res_href", "__ref")),
        "href": F.coalesce("res_href", "__ref"),
        "params": F.when(is_text, both).otherwise(names),
        "context": dom_or("__element", F.when(is_inline, _around(fixed.INLINE_MARGIN))
                          .otherwise(_around(fixed.TEXT_MARGIN))),
        "raw_match": F.col("raw"),
    })


def _bare(path: Column) -> Column:
    stripped = F.regexp_replace(path, r"/+\z", "")
    return F.when(stripped == "", F.lit("/")).otherwise(stripped)


def _on_own_host() -> Column:
    exact = F.col("res_host") == F.col("base_host")
    return (
        F.when(F.col("unit") != "text", exact)
        .when(F.col("absolute"), same_site(F.col("res_host"), F.col("base_host")))
        .otherwise(F.lit(True))
    )


def on_own_host(df: DataFrame) -> DataFrame:
    """DOM and inline findings must be on the page's host, absolute URLs on its site."""
    return df.filter(_on_own_host())


def identity() -> Column:
    return F.concat(F.col("method"), F.lit(":"), F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("path")))


def first_per_source(df: DataFrame) -> DataFrame:
    """First finding per detector, source and identity: one shuffle, one window, no cap."""
    df = df.select(*COLUMNS, "unit", identity().alias("__id"))
    first = Window.partitionBy("scan_id", "source", "unit", "__id").orderBy(*ORDER)
    return df.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*COLUMNS)


def page_endpoints(cands: DataFrame, dom: bool = True) -> DataFrame:
    """Endpoint findings of pages from their candidates, deduplicated per detector."""
    return page_findings(raw_endpoints(cands, dom=dom))


def page_findings(raw: DataFrame) -> DataFrame:
    """Raw endpoints of pages that are on the page's host or site, each once per detector."""
    df = on_own_host(raw).withColumns({"source": F.col("page_url"), "host": F.col("base_host")})
    return first_per_source(df)


def first_entries(entries: DataFrame) -> DataFrame:
    """Each name once per scan, page and initiator, with its first entry and time.

    Entries that differ in nothing else make the same finding, of which a scan keeps the first, so
    their URLs are taken apart once. The rest is dealt over all tasks: entries are short, and would
    come together in few of them.
    """
    keys = [c for c in entries.columns if c not in ("entry_id", "tab_id", "ts")]
    first = entries.groupBy(*keys).agg(F.min("entry_id").alias("entry_id"), F.min_by("ts", "entry_id").alias("ts"))
    return dealt(first, "scan_id", "name")


def network_endpoints(entries: DataFrame) -> DataFrame:
    """Network entries (page_url, name, initiator_type, ts, ...) -> endpoints, row by row.

    Other columns of the entries are kept. Works on a stream as on a batch.
    """
    extra = [c for c in entries.columns if c not in ("page_url", "name", "initiator_type", "ts")]
    initiator = F.lower(trim(F.coalesce(F.nullif(F.col("initiator_type"), F.lit("")), F.lit("resource"))))
    df = entries.filter(F.col("name") != "")
    # Entries whose page is parsed already, before they were joined to it, bring its columns.
    df = df if "base_host" in df.columns else with_base(df)
    extra = [c for c in extra if not c.startswith("base_")]
    df = resolve(df, "name", "base", "res").filter(
        same_site(F.col("res_host"), F.col("base_host"))
    )
    df = pin(df, {
        "path": _bare(F.col("res_path")),
        "query": F.expr("substring(res_search, 2)"),
        "initiator": initiator,
    }).filter(~endpoint_noise(F.col("path"), F.lit("network")))
    return df.select(
        *extra,
        "page_url",
        F.col("base_host").alias("host"),
        "path",
        "query",
        F.lit("GET").alias("method"),
        query_names(F.col("query")).alias("params"),
        F.when(F.col("initiator") == "", F.lit("network"))
        .otherwise(F.concat(F.lit("network-"), F.col("initiator"))).alias("kind"),
        F.col("page_url").alias("source"),
        F.concat(
            F.lit("Observed in network history via "),
            F.when(F.col("initiator") == "", F.lit("resource")).otherwise(F.col("initiator")),
            F.lit(" timing entry"),
        ).alias("context"),
        F.col("res_href").alias("raw_match"),
        F.col("res_href").alias("url"),
        F.col("res_href").alias("href"),
        F.col("ts").alias("scan_time"),
    )
