"""The registered queries: each reads the given tables and returns one DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlsift.functions.stage import scratch, settle
from crawlsift.operators import captures as cap
from crawlsift.operators import endpoints as ep
from crawlsift.operators import hostlog, review, scripts, sessions
from crawlsift.plans import export, scan
from crawlsift.session import checkpoint_dir
from crawlsift.sources import inputs, store
from crawlsift.sources.readers import PAGES, read_captures, read_stream, write_captures
from crawlsift.sources.rules import DEFAULT_RULES, read_rules, usable_rules, write_rules
from crawlsift.streaming import jobs

GAP = "2 hours"
#: Values of a list per row: few, so that the checks see lists of several pages.
LIST_PAGE = 5
#: Buckets of the log that ``host_log_merge`` keeps.
BUCKETS = 16
AS_OF = "timestamp_ntz '2024-01-01 01:30:00'"


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: arrays joined, times as text, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _endpoints(df: DataFrame) -> DataFrame:
    return flat(df.drop("href", "scan_time"))


def _pages(spark, sf):
    return inputs.scan_pages(spark, sf)


def _network(spark, sf):
    return ep.network_endpoints(ep.first_entries(inputs.network_entries(spark, sf))).withColumns({
        "scan_time": inputs.scan_time("scan_id"),
        "phase": F.lit(ep.NETWORK), "source_idx": F.lit(0), "pattern_idx": F.lit(0),
        "pos": F.col("entry_id"),
    })


class _Scan:
    """The tables that the findings of all scans come from: markup and bodies are read once."""

    def __init__(self, spark, sf, secrets=True, network=True):
        self.rules = usable_rules(spark) if secrets else None
        self.pages = scan.page_table(_pages(spark, sf), self.rules)
        self.bodies = scan.body_table(inputs.bodies(spark, sf), self.rules)
        self.sources = scan.page_sources(self.pages)
        self.network = _network(spark, sf) if network else None

    def endpoints(self) -> DataFrame:
        """Endpoint findings of every detector, those of the network first."""
        return scan.all_endpoints(self.pages, self.bodies, self.sources, self.network)

    def secrets(self) -> DataFrame:
        """Secret findings, each once per scan."""
        return scan.first_secrets(scan.all_secrets(self.pages, self.bodies, self.sources, self.rules))

    def facts(self) -> tuple[DataFrame, DataFrame]:
        """Facts of secrets and of endpoints for the host log, as written tables."""
        return (
            settle(hostlog.secret_facts(self.secrets()), "secret-facts"),
            settle(hostlog.endpoint_facts(scan.logged_endpoints(self.endpoints())), "endpoint-facts"),
        )


def _newest(spark, sf):
    """The newest scan of each host, as a written table: its size tells how to join it."""
    scans = ep.with_base(_pages(spark, sf).drop("html")).select(F.col("base_host").alias("host"), "scan_time", "scan_id")
    return settle(sessions.newest_scans(scans), "newest-scans")


def _live_endpoints(found, newest):
    return settle(sessions.live_findings(found, newest, scan.first_endpoints), "live-endpoints")


def _live_secrets(found, newest):
    return settle(sessions.live_findings(found, newest), "live-secrets")


def _secret_sides(spark, sf, size=LIST_PAGE):
    """The log of all scans and each host's newest scan, of secrets."""
    with scratch(spark) as keep:
        found = settle(_Scan(spark, sf, network=False).secrets(), "secrets")
        facts = settle(hostlog.secret_facts(found), "secret-facts")
        log = keep(settle(hostlog.secret_log(facts, size), "secret-log"))
        return log, keep(_live_secrets(found, _newest(spark, sf)))


def _endpoint_sides(spark, sf, size=LIST_PAGE):
    """The log of all scans and each host's newest scan, of endpoints."""
    with scratch(spark) as keep:
        found = settle(_Scan(spark, sf, secrets=False).endpoints(), "endpoints")
        facts = settle(hostlog.endpoint_facts(scan.logged_endpoints(found)), "endpoint-facts")
        log = keep(settle(hostlog.endpoint_log(facts, size), "endpoint-log"))
        return log, keep(_live_endpoints(found, _newest(spark, sf)))


def _found(spark, sf):
    """Secrets and endpoints of all scans, as written tables; the raw matches are removed."""
    with scratch(spark) as keep:
        scanned = _Scan(spark, sf)
        return keep(settle(scanned.secrets(), "secrets")), keep(settle(scanned.endpoints(), "endpoints"))


def _sides(spark, sf):
    """Live findings and host log, by kind, from one scan."""
    with scratch(spark) as keep:
        secrets, endpoints = _found(spark, sf)
        facts = {
            "secrets": keep(settle(hostlog.secret_facts(secrets), "secret-facts")),
            "endpoints": keep(settle(hostlog.endpoint_facts(scan.logged_endpoints(endpoints)), "endpoint-facts")),
        }
        newest = _newest(spark, sf)
        live = {"secrets": keep(_live_secrets(secrets, newest)), "endpoints": keep(_live_endpoints(endpoints, newest))}
    return live, facts


def _merged_secrets(spark, sf):
    return review.merged_secrets(*_secret_sides(spark, sf), LIST_PAGE)


def _merged_endpoints(spark, sf):
    return review.merged_endpoints(*_endpoint_sides(spark, sf), LIST_PAGE)


def _context(df: DataFrame) -> DataFrame:
    return df.withColumn("context", F.coalesce(F.get("contexts", F.lit(0)), F.lit(""))).drop("contexts")


def inline_scripts(spark, sf):
    return flat(scripts.inline_scripts(_pages(spark, sf)).drop("scan_time"))


def script_sources(spark, sf):
    return flat(scripts.script_sources(_pages(spark, sf)).select("scan_id", "page_url", "url", "source_idx"))


def script_bodies(spark, sf):
    sources = settle(scripts.script_sources(_pages(spark, sf)), "sources")
    found = scripts.script_bodies(sources, inputs.bodies(spark, sf))
    return flat(found.select("scan_id", "page_url", "url", "source_idx", "body"))


def dom_endpoints(spark, sf):
    return _endpoints(scan.page_endpoints(_pages(spark, sf), inline=False, text=False))


def inline_endpoints(spark, sf):
    return _endpoints(scan.page_endpoints(_pages(spark, sf), dom=False, text=False))


def text_endpoints(spark, sf):
    scanned = _Scan(spark, sf, secrets=False, network=False)
    raw = scan.endpoint_table(scanned.pages.filter("unit = 'text'"), scanned.bodies)
    return _endpoints(scan.page_findings(raw).unionByName(scan.body_findings(scanned.sources, raw)))


def network_endpoints(spark, sf):
    found = ep.network_endpoints(inputs.network_entries(spark, sf))
    return flat(found.drop("href", "scan_time", "tab_id"))


def _text_secrets(spark, sf, rules):
    """Secrets of documents and of page texts."""
    docs = inputs.texts(spark, sf).selectExpr("'document' AS kind", "doc_id AS text_id", "text")
    pages = _pages(spark, sf).selectExpr("'page' AS kind", "scan_id AS text_id", "html AS text")
    found = scan.text_secrets(docs.unionByName(pages), rules, ["kind", "text_id"])
    return found.select("kind", "text_id", "id", "name", "severity", "value", "context", "pattern_idx", "pos")


def rule_secrets(spark, sf):
    """Rules come from a table: the default ones, written as two files and read back."""
    path, half = f"{_stream_folder(spark)}/rules", len(DEFAULT_RULES) // 2
    for some in (DEFAULT_RULES[:half], DEFAULT_RULES[half:]):
        write_rules(spark, some, path)
    rules = usable_rules(spark, read_rules(spark, path))
    return flat(_text_secrets(spark, sf, rules).filter("id <> 'high-entropy'"))


def entropy_secrets(spark, sf):
    return flat(_text_secrets(spark, sf, usable_rules(spark)).filter("id = 'high-entropy'").drop("pattern_idx"))


def page_findings(spark, sf):
    rules = usable_rules(spark)
    matches = scan.page_table(_pages(spark, sf), rules).filter("unit = 'text'")
    secrets, endpoints = scan.secrets_of(matches, rules), ep.page_endpoints(matches, dom=False)
    rows = secrets.select(
        "scan_id", "source", F.lit("secret").alias("finding"), F.col("id").alias("kind"), "value",
        "severity", "context", "pattern_idx", "pos",
    ).unionByName(endpoints.select(
        "scan_id", "source", F.lit("endpoint").alias("finding"), "kind", F.col("url").alias("value"),
        F.lit("").alias("severity"), "context", "pattern_idx", "pos",
    ))
    return flat(rows)


def scan_endpoints(spark, sf):
    return _endpoints(scan.first_endpoints(_Scan(spark, sf, secrets=False).endpoints()))


def scan_secrets(spark, sf):
    return flat(_Scan(spark, sf, network=False).secrets().drop("scan_time"))


def host_secrets(spark, sf):
    facts = settle(hostlog.secret_facts(_Scan(spark, sf, network=False).secrets()), "secret-facts")
    return flat(_context(hostlog.secret_log(facts, LIST_PAGE)))


def host_endpoints(spark, sf):
    found = scan.logged_endpoints(_Scan(spark, sf, secrets=False).endpoints())
    return flat(_context(hostlog.endpoint_log(settle(hostlog.endpoint_facts(found), "endpoint-facts"), LIST_PAGE)))


def host_log_merge(spark, sf):
    """The stored log takes up batches: secrets of pages, then those of script bodies, then both again.

    The log is a table in buckets of hosts; the last batch repeats what is there, and the first
    batches are compacted.
    """
    scanned, path = _Scan(spark, sf, network=False), f"{_stream_folder(spark)}/log"
    of_pages = scan.first_secrets(scan.secrets_of(scanned.pages, scanned.rules))
    of_bodies = scan.first_secrets(scan.body_secrets(scanned.sources, scanned.bodies, scanned.rules))
    for batch, found in enumerate((of_pages, of_bodies, of_pages.unionByName(of_bodies))):
        facts = store.typed(hostlog.secret_facts(found), hostlog.FACTS)
        store.append(facts, path, batch, ["host"], BUCKETS)
    store.compact(spark, path, hostlog.FACTS, hostlog.merge_facts, ["host"], keep=1, buckets=BUCKETS)
    facts = settle(hostlog.merge_facts(store.read(spark, path, hostlog.FACTS)), "secret-facts")
    return flat(_context(hostlog.secret_log(facts, LIST_PAGE)))


def host_stats(spark, sf):
    return flat(hostlog.host_stats(*_Scan(spark, sf).facts()))


def host_report(spark, sf):
    return flat(hostlog.host_report(hostlog.host_stats(*_Scan(spark, sf).facts())))


def finding_counts(spark, sf):
    live, facts = _sides(spark, sf)
    return review.finding_counts(facts, live)


def merged_secrets(spark, sf):
    return flat(_merged_secrets(spark, sf))


def merged_endpoints(spark, sf):
    return flat(_merged_endpoints(spark, sf))


def review_endpoints(spark, sf):
    merged = _merged_endpoints(spark, sf)
    return flat(review.review_endpoints(merged, F.expr(AS_OF), method="GET", search="/api/"))


def review_secrets(spark, sf):
    merged = _merged_secrets(spark, sf)
    return flat(review.review_secrets(merged, F.expr(AS_OF), severity="medium", search="example.com"))


def _views(spark, sf):
    """Live findings, host log and merged view, by kind, from one scan."""
    with scratch(spark) as keep:
        live, facts = _sides(spark, sf)
        live = {kind: keep(df) for kind, df in live.items()}
        # The log feeds the export and the merged view, so it is written once.
        log = {
            "secrets": keep(settle(hostlog.secret_log(facts["secrets"], LIST_PAGE), "secret-log")),
            "endpoints": keep(settle(hostlog.endpoint_log(facts["endpoints"], LIST_PAGE), "endpoint-log")),
        }
    merged = {
        "secrets": review.merged_secrets(log["secrets"], live["secrets"], LIST_PAGE),
        "endpoints": review.merged_endpoints(log["endpoints"], live["endpoints"], LIST_PAGE),
    }
    return live, log, merged


def export_json(spark, sf):
    """The export as it is read back from its files."""
    path = f"{_stream_folder(spark)}/export"
    with scratch(spark):
        live, log, merged = _views(spark, sf)
        export.write_json(export.export_rows(live, log, merged, F.expr(AS_OF)), path)
    return flat(export.read_json(spark, path))


def export_lines(spark, sf):
    """The text export as it is read back from its files."""
    path = f"{_stream_folder(spark)}/lines"
    with scratch(spark):
        _, _, merged = _views(spark, sf)
        export.write_lines(review.export_lines(merged["endpoints"], merged["secrets"]), path, ["section", "line"])
    return export.read_lines(spark, path).select("host", "line")


def _captures(spark, sf):
    return cap.capture_collapse(inputs.captures(spark, sf))


def capture_collapse(spark, sf):
    return flat(_captures(spark, sf))


def capture_view(spark, sf):
    return flat(cap.capture_view(_captures(spark, sf), mime="text/html", search="/en"))


def capture_count(spark, sf):
    return cap.capture_count(_captures(spark, sf), mime="text/html", search="/en")


def capture_orders(spark, sf):
    """The place of every HTML capture in each of the eight orders."""
    return flat(cap.capture_ranks(_captures(spark, sf), mime="text/html"))


def capture_index(spark, sf):
    """Captures as they are read back from the files of an index."""
    path = f"{_stream_folder(spark)}/index"
    write_captures(_captures(spark, sf), path)
    return read_captures(spark, path)


def capture_mimes(spark, sf):
    return cap.capture_mimes(_captures(spark, sf))


def capture_urls(spark, sf):
    return cap.capture_urls(_captures(spark, sf), search="example.org")


def nav_sessions(spark, sf):
    return flat(sessions.nav_sessions(inputs.navigation(spark, sf), GAP))


def rescan_triggers(spark, sf):
    return flat(sessions.rescan_triggers(sessions.nav_sessions(inputs.navigation(spark, sf), GAP)))


def _latest(spark, sf):
    nav = inputs.navigation(spark, sf)
    return sessions.latest_scan(nav.select(
        "tab_id", F.col("nav_id").alias("scan_id"), F.col("ts").alias("started_at"),
        F.col("url").alias("page_url"), (F.col("event_type") == "error").alias("tombstone"),
    ))


def latest_scan(spark, sf):
    return flat(_latest(spark, sf))


def fresh_findings(spark, sf):
    found = ep.network_endpoints(inputs.network_entries(spark, sf))
    found = found.withColumn("scan_id", F.col("entry_id"))
    fresh = sessions.fresh_findings(found, _latest(spark, sf))
    return flat(fresh.select("tab_id", "scan_id", "page_url", "kind", "method", "url"))


def retention_prune(spark, sf):
    stats = settle(hostlog.host_stats(*_Scan(spark, sf).facts()), "stats")
    keep = stats.agg(F.min("host")).first()[0]
    return flat(hostlog.retention_prune(stats, keep))


def _stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed_pages(spark, sf):
    return inputs.scan_pages(spark, sf, read_stream(spark, f"{sf}/pages.parquet", PAGES))


def _streamed_events(spark, sf):
    schema = inputs.table(spark, sf, "events").schema
    return read_stream(spark, f"{sf}/events.parquet", schema)


def _run(query) -> None:
    query.awaitTermination()


def _scan_stream(spark, sf, out):
    network = settle(_network(spark, sf), "network")
    pages, bodies = _streamed_pages(spark, sf), inputs.bodies(spark, sf)
    return jobs.stream_scan(pages, bodies, usable_rules(spark), out, network=network)


def stream_scan(spark, sf):
    out = _stream_folder(spark)
    _run(_scan_stream(spark, sf, out))
    return _endpoints(jobs.findings(spark, out, "endpoints"))


def stream_network(spark, sf):
    out = _stream_folder(spark)
    _run(jobs.stream_network(inputs.network_entries(spark, sf, _streamed_events(spark, sf)), out))
    return flat(jobs.network(spark, out))


def stream_tabs(spark, sf):
    out = _stream_folder(spark)
    _run(jobs.stream_tabs(inputs.tab_entries(spark, sf, _streamed_events(spark, sf)), out))
    return flat(jobs.current_findings(spark, out))


def stream_sessions(spark, sf):
    out = _stream_folder(spark)
    nav = inputs.navigation(spark, sf, _streamed_events(spark, sf))
    _run(jobs.stream_rescans(nav, out, GAP, "1 day"))
    return flat(jobs.bursts(spark, out, inputs.navigation(spark, sf), GAP))


def stream_host_log(spark, sf):
    out = _stream_folder(spark)
    _run(_scan_stream(spark, sf, out))
    return flat(jobs.host_logs(spark, out)[2])


_QUERIES = [
    inline_scripts, script_sources, script_bodies, dom_endpoints, inline_endpoints, text_endpoints,
    network_endpoints, rule_secrets, entropy_secrets, page_findings, scan_endpoints, scan_secrets,
    host_secrets, host_endpoints, host_log_merge, host_stats, host_report, finding_counts, merged_secrets,
    merged_endpoints, review_endpoints, review_secrets, export_json, export_lines,
    capture_collapse, capture_view, capture_count, capture_orders, capture_index, capture_mimes, capture_urls, nav_sessions, rescan_triggers,
    latest_scan, fresh_findings, retention_prune, stream_scan, stream_network, stream_tabs, stream_sessions,
    stream_host_log,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}
