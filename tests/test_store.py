"""Stored logs in buckets, paged lists, and streams of several files with late, split and replayed rows."""

import datetime as dt
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crawlsift.functions.stage import numbered, paged, scratch, settle
from crawlsift.operators import hostlog, review, sessions
from crawlsift.plans import catalog, export, scan
from crawlsift.sources import store
from crawlsift.sources.readers import PAGES, read_stream
from crawlsift.sources.rules import usable_rules
from crawlsift.streaming import jobs
from tests.test_jobs import SECRET, T0, secrets


@pytest.fixture()
def many_ranges(spark):
    """More ranges than the small data would get by itself, so that groups lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_in_groups_of_any_size(many_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", "c", None]), rng.randint(0, 300), i) for i in range(3000)]
    rows += [("hot", 7, 5000)] * 3
    df = many_ranges.createDataFrame(rows, "g string, x int, i int")
    got = numbered(df, ["g"], ["x", "i"]).collect()
    want = {}
    for g, x, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want.setdefault(g, []).append((x, i))
    for g, values in want.items():
        mine = sorted((r.n, r.x, r.i) for r in got if r.g == g)
        assert [r[0] for r in mine] == list(range(len(values))) and [r[1:] for r in mine] == values
    assert numbered(df.where("false"), ["g"], ["x", "i"]).count() == 0


def test_pages_of_a_key_with_many_values(many_ranges):
    values = many_ranges.range(100_000).selectExpr("'h' AS host", "'k' AS key", "'page_urls' AS field", "concat('p', id) AS v", "99999 - id AS at")
    values = values.unionByName(many_ranges.createDataFrame([("h", "k", "ids", "x", 0), ("h", "l", "ids", "y", 0)], values.schema))
    pages = paged(values, ["host", "key"], ["page_urls", "ids"], 1000).collect()
    assert sorted((r.key, r.page) for r in pages) == [("k", i) for i in range(100)] + [("l", 0)]
    assert all(len(r.page_urls) == 1000 for r in pages if r.key == "k")
    assert [v for r in sorted(pages, key=lambda r: r.page) for v in r.page_urls] == [f"p{99_999 - i}" for i in range(100_000)]
    assert [r.ids for r in pages if r.page == 0] in ([["x"], ["y"]], [["y"], ["x"]])
    cut = paged(values, ["host", "key"], ["page_urls", "ids"], 1000, {"page_urls": 1500, "ids": None}).collect()
    assert sum(len(r.page_urls) for r in cut) == 1500


def test_log_rows_hold_one_page_each(spark):
    rows = [(s, "a", "A", "low", "v1", 0) for s in range(60)] + [(3, "c", "C", "odd", "v2", 0)]
    found = secrets(spark, rows)
    log = hostlog.host_secrets(found, 25).orderBy("page").collect()
    one = [r for r in log if r.value == "v1"]
    assert [len(r.page_urls) for r in one] == [25, 25, 10] and [r.ids for r in one] == [["a"], [], []]
    assert [u for r in one for u in r.page_urls] == [f"https://h/{s}" for s in range(60)]
    assert {r.occurrences for r in one} == {60} and [r.page for r in log if r.value == "v2"] == [0]
    whole = review.merged_secrets(hostlog.host_secrets(found), found.where("scan_id < 30")).where("value = 'v1'").collect()
    pages = review.merged_secrets(hostlog.host_secrets(found, 25), found.where("scan_id < 30"), 7).where("value = 'v1'").orderBy("page").collect()
    assert len(whole) == 1 and all(len(r.sources) <= 7 for r in pages)
    for c in ("sources", "page_urls", "contexts", "names"):
        assert [v for r in pages for v in r[c]] == whole[0][c]
    assert {(r.source_count, r.page_count) for r in pages} == {(120, 60)} == {(whole[0].source_count, whole[0].page_count)}


# ---- the bucketed store -------------------------------------------------------------------


def log_rows(spark, path, host=None):
    rows = store.read(spark, path, hostlog.FACTS, (host,) if host else None)
    rows = rows.where(F.col("host") == host) if host else rows
    return sorted(map(str, hostlog.secret_log(hostlog.merge_facts(rows)).collect()))


def hosts_of(spark, n):
    rows = [(s, "abc"[s % 3], ["A", "", "B"][s % 3], ["low", "critical"][s % 2], f"v{s % 4}", s % 2) for s in range(n)]
    return secrets(spark, rows).withColumn("host", F.concat(F.lit("h"), F.col("scan_id") % 11))


def test_log_in_buckets_for_any_split_and_replay(spark, tmp_path):
    found, path = hosts_of(spark, 120).cache(), str(tmp_path / "log")
    whole = sorted(map(str, hostlog.host_secrets(found).collect()))
    one = sorted(map(str, hostlog.host_secrets(found.where("host = 'h3'")).collect()))
    rng = random.Random(1)
    for batch in range(7):
        part = found.where(f"scan_id % 7 = {batch} OR scan_id = {rng.randrange(120)}")
        for _ in range(2 if batch % 3 == 0 else 1):  # some batches come twice
            store.append(store.typed(hostlog.secret_facts(part), hostlog.FACTS), path, batch, ["host"], 8)
    reads = lambda: store.read(spark, path, hostlog.FACTS, ("h3",), buckets=8)
    opened = {f.split("bucket=")[1].split("/")[0] for (f,) in reads().select(F.input_file_name()).distinct().collect()}
    assert len(opened) == 1 and "PartitionFilters: [isnotnull(bucket" in reads()._jdf.queryExecution().toString()
    everything = store.read(spark, path, hostlog.FACTS)
    assert sorted(map(str, hostlog.secret_log(hostlog.merge_facts(everything)).collect())) == whole
    assert sorted(map(str, hostlog.secret_log(hostlog.merge_facts(reads().where("host = 'h3'"))).collect())) == one
    before = len(store.batches(spark, path))
    assert store.last_batch(spark, path) == 6
    removed = store.compact(spark, path, hostlog.FACTS, hostlog.merge_facts, ["host"], keep=2, buckets=8)
    left = store.batches(spark, path)
    assert removed > 10 and len(left) < before and max(sum(b == x for x, _ in left) for b, _ in left) <= 3
    assert sorted(map(str, hostlog.secret_log(hostlog.merge_facts(store.read(spark, path, hostlog.FACTS))).collect())) == whole
    # A batch that is replayed after it was compacted changes nothing; nor does a second compaction.
    store.append(store.typed(hostlog.secret_facts(found.where("scan_id % 7 = 1")), hostlog.FACTS), path, 1, ["host"], 8)
    store.compact(spark, path, hostlog.FACTS, hostlog.merge_facts, ["host"], keep=0, buckets=8)
    assert {sum(b == x for x, _ in store.batches(spark, path)) for b, _ in store.batches(spark, path)} == {1}
    assert sorted(map(str, hostlog.secret_log(hostlog.merge_facts(store.read(spark, path, hostlog.FACTS))).collect())) == whole


def test_store_without_rows(spark, tmp_path):
    none = store.typed(hostlog.secret_facts(spark.createDataFrame([], SECRET)), hostlog.FACTS)
    store.append(none, str(tmp_path / "log"), 0, ["host"])
    assert store.read(spark, str(tmp_path / "log"), hostlog.FACTS).count() == 0
    assert store.compact(spark, str(tmp_path / "log"), hostlog.FACTS, hostlog.merge_facts, ["host"]) == 0


# ---- streams ------------------------------------------------------------------------------

HTML = '<script src="/a.js"></script><a href="/x/{0}">l</a><script>fetch("/api/v1/u{0}?id=1");var token = "{1}";</script>'


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"https://h{i % 3}.example.com/p{i}", HTML.format(i, f"{i:032x}".replace("0", "b7"))) for i in rows], PAGES)


def as_scans(pages):
    return pages.selectExpr("page_id AS scan_id", "url AS page_url", "html", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id) AS scan_time")


def bodies_of(spark):
    return spark.createDataFrame(
        [(f"https://h{i}.example.com/a.js", 200, "", 'fetch("/v9/body");var s="Ab3cfcd208495d565ef66e7dff9Z"') for i in range(3)],
        "url string, status int, content_type string, body string")


def batch_facts(spark, pages):
    rules = usable_rules(spark)
    matches, bodies = scan.page_table(as_scans(pages), rules), scan.body_table(bodies_of(spark), rules)
    sources = scan.page_sources(matches)
    endpoints = scan.logged_endpoints(scan.all_endpoints(matches, bodies, sources))
    return hostlog.secret_facts(scan.first_secrets(scan.all_secrets(matches, bodies, sources, rules))), hostlog.endpoint_facts(endpoints)


def test_streamed_log_of_a_folder_of_files(spark, tmp_path, monkeypatch):
    """One file a batch, one page in two files, and a batch that runs again after its writes were made."""
    source, out = str(tmp_path / "pages.parquet"), str(tmp_path / "out")
    for part in ([0, 1], [1, 2], [3]):
        pages_of(spark, part).coalesce(1).write.mode("append").parquet(source)
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    monkeypatch.setattr(store, "KEEP", 1)
    real, failed = store.append, []

    def fails_once(rows, path, batch, by, *more):
        real(rows, path, batch, by, *more)
        if batch == 1 and "secrets" in path and not failed:
            failed.append(path)
            raise RuntimeError("the driver is lost here")

    monkeypatch.setattr(jobs.store, "append", fails_once)
    run = lambda: jobs.stream_scan(as_scans(read_stream(spark, source, PAGES, files=1)), bodies_of(spark), usable_rules(spark), out)
    with pytest.raises(Exception, match="the driver is lost here"):
        run().awaitTermination()
    run().awaitTermination()  # starts with the batch that failed
    assert failed
    secret_facts, endpoint_facts = batch_facts(spark, pages_of(spark, range(4)))
    got_s, got_e, got_stats = jobs.host_logs(spark, out)
    assert sorted(map(str, got_s.collect())) == sorted(map(str, hostlog.secret_log(secret_facts).collect()))
    assert sorted(map(str, got_e.collect())) == sorted(map(str, hostlog.endpoint_log(endpoint_facts).collect()))
    want = sorted(map(str, hostlog.host_stats(secret_facts, endpoint_facts).collect()))
    assert sorted(map(str, got_stats.collect())) == want and len(want) == 3
    one = jobs.host_logs(spark, out, "h1.example.com")[2].collect()
    assert list(map(str, one)) == [w for w in want if "h1.example.com" in w]
    assert jobs.findings(spark, out, "secrets").groupBy("scan_id", "id", "value", "source").count().where("count > 1").count() == 0


def test_refresh_gives_changed_hosts_only(spark, tmp_path):
    """A running trigger, stopped and started again; a reader with a cursor sees what is new."""
    source, out = str(tmp_path / "pages.parquet"), str(tmp_path / "out")
    start = lambda: jobs.stream_scan(
        as_scans(read_stream(spark, source, PAGES, files=1)), bodies_of(spark), usable_rules(spark), out, once=False)
    pages_of(spark, [0, 1]).coalesce(1).write.mode("append").parquet(source)
    query = start()
    query.processAllAvailable()
    stats, cursor = jobs.changed_stats(spark, out)
    assert {r.host for r in stats.collect()} == {"h0.example.com", "h1.example.com"} and cursor == 0
    assert jobs.changed_stats(spark, out, cursor)[0].count() == 0
    query.stop()
    pages_of(spark, [4]).coalesce(1).write.mode("append").parquet(source)
    query = start()
    query.processAllAvailable()
    query.stop()
    stats, later = jobs.changed_stats(spark, out, cursor)
    rows = stats.collect()
    assert [r.host for r in rows] == ["h1.example.com"] and later > cursor
    assert rows[0].page_count == 2  # the page of the first batch counts, too


ENTRY = "entry_id bigint, scan_id bigint, tab_id bigint, page_url string, ts timestamp_ntz, name string, initiator_type string, tombstone boolean"


def entry_files(spark, source, files):
    for rows in files:
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(source)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_first_sightings_with_late_entries(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "entries"), str(tmp_path / "out")
    entry = lambda i, minute, name, p=1: (i, i, 1, f"https://e.example.com/{p}", at(minute), name, "fetch", False)
    files = [
        [entry(1, 100, "/api/a"), entry(2, 101, "/api/b"), entry(3, 102, "/api/a")],
        [entry(4, 1000, "/api/c"), entry(5, 1001, "/api/a", 2)],
        [entry(6, 5, "/api/a"), entry(7, 5000, "/api/d")],  # late by hours, and first
        [entry(8, 200, "/api/c"), entry(9, 6, "/api/a")],  # late, for an endpoint of another batch
        [entry(10, 9000, "/api/b"), entry(11, 9001, "https://other.invalid/x")],
    ]
    entry_files(spark, source, files)
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)
    jobs.stream_network(read_stream(spark, source, ENTRY, files=1), out).awaitTermination()
    got = {(r.page_url[-1], r.url[-1]): (r.ts, r.entry_id) for r in jobs.network(spark, out).collect()}
    assert got == {
        ("1", "a"): (at(5), 6), ("1", "b"): (at(101), 2), ("1", "c"): (at(200), 8), ("1", "d"): (at(5000), 7), ("2", "a"): (at(1001), 5),
    }


def test_later_scan_supersedes_in_the_stream(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "entries"), str(tmp_path / "out")
    entry = lambda i, scan_id, tab, minute, name, gone=False: (
        i, scan_id, tab, f"https://e.example.com/{scan_id}", at(minute), name, "fetch", gone)
    files = [
        [entry(1, 1, 1, 0, "/api/a"), entry(2, 1, 1, 0, "/api/b"), entry(3, 2, 2, 0, "/api/a"), entry(4, 3, 3, 0, "/api/a")],
        [entry(5, 4, 1, 10, "/api/c")],  # tab 1 goes on to a new scan
        [entry(6, 5, 1, 5, "/api/late"), entry(7, 2, 2, 0, "/api/more")],  # a late scan; the rest of a scan
        [entry(8, 6, 3, 20, "/api/x", True)],  # tab 3 is closed
        [entry(9, 7, 4, 1, "/api/y"), entry(10, 8, 4, 2, "/api/z")],
    ]
    entry_files(spark, source, files)
    seen = []
    for every in (100, 2):
        monkeypatch.setattr(jobs, "COMPACT_EVERY", every)
        monkeypatch.setattr(store, "KEEP", 0)
        jobs.stream_tabs(read_stream(spark, source, ENTRY, files=1), f"{out}{every}").awaitTermination()
        seen.append({(r.tab_id, r.scan_id, r.url.rsplit("/", 1)[1]) for r in jobs.current_findings(spark, f"{out}{every}").collect()})
    assert seen[0] == seen[1] == {(1, 4, "c"), (2, 2, "a"), (2, 2, "more"), (4, 8, "z")}


def test_bursts_with_late_events(spark, tmp_path):
    schema = "tab_id bigint, nav_id bigint, ts timestamp_ntz, url string"
    files = [
        [(1, 1, 0), (1, 2, 30), (2, 3, 10)], [(1, 4, 600), (2, 5, 620)], [(1, 6, 3000), (2, 7, 3000)],
        [(1, 8, 100), (1, 9, 6000)],  # event 8 comes after its time was closed
        [(2, 10, 9000)],
    ]
    source, out = str(tmp_path / "nav"), str(tmp_path / "out")
    for rows in files:
        made = [(t, i, at(m), f"u{i}") for t, i, m in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
    jobs.stream_rescans(read_stream(spark, source, schema, files=1), out, "2 hours", "1 hour").awaitTermination()
    stored = spark.read.schema(schema).parquet(source)
    got = jobs.bursts(spark, out, stored, "2 hours")
    want = sessions.nav_sessions(stored, "2 hours").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# ---- exports ------------------------------------------------------------------------------


def test_export_files(spark, tmp_path):
    rows = [(s, "a", "A", "low", f"v{s:03d}", 0) for s in range(50)]
    found = secrets(spark, rows).withColumn("host", F.concat(F.lit("h%/"), F.col("scan_id") % 2))
    log = hostlog.host_secrets(found)
    merged = review.merged_secrets(log, found.where("scan_id < 0"))
    urls = [("h1.example.com", 0, f"https://h1.example.com/x/{i}", f"/x/{i}", "") for i in range(5)]
    endpoints = spark.createDataFrame(urls, "host string, page bigint, url string, path string, query string")
    path = str(tmp_path / "lines")
    export.write_lines(review.export_lines(endpoints, merged), path, ["section", "line"])
    lines = export.read_lines(spark, path)
    assert {r.host for r in lines.collect()} == {"h%/0", "h%/1", "h1.example.com"}
    mine = [r.line for r in sorted(lines.where("host = 'h%/1'").collect(), key=lambda r: (r.file, r.line))]
    assert mine == [f"v{s:03d}" for s in range(1, 50, 2)]
    files = sorted((tmp_path / "lines" / "host=h1.example.com").glob("part-*"))
    assert [x for f in files for x in f.read_text().splitlines()] == sorted(r.line for r in lines.where("host = 'h1.example.com'").collect())
    none = endpoints.where("false")
    docs = export.export_rows({"secrets": found, "endpoints": none}, {"secrets": log, "endpoints": none}, {"secrets": merged, "endpoints": none}, F.lit(T0))
    export.write_json(docs, str(tmp_path / "json"))
    back = export.read_json(spark, str(tmp_path / "json")).collect()
    assert len(back) == 150 and {r.hostname == r.host for r in back} == {True}
    assert {(r.part, r.kind) for r in back} == {(p, "secrets") for p in ("currentScan", "hostLog", "mergedFindings")}


def test_written_tables_leave_no_shuffle_and_go_with_their_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("crawlsift.session.checkpoint_dir", lambda spark: str(tmp_path))
    files = lambda: {p for d in Path(spark.conf.get("spark.local.dir", "/tmp")).glob("blockmgr-*") for p in d.rglob("shuffle_*.data")}
    before = files()
    with scratch(spark):
        with scratch(spark) as keep:
            settle(spark.range(10), "gone")
            kept = keep(settle(spark.range(1000).repartition(3, "id"), "kept"))
        until = time.time() + 20
        while files() - before and time.time() < until:
            time.sleep(0.1)
        assert files() <= before
        assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"] and kept.count() == 1000
    assert list(tmp_path.iterdir()) == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", ["export_json", "export_lines"])
def test_exports_scan_once_and_leave_their_files_only(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr("crawlsift.session.checkpoint_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(catalog, "checkpoint_dir", lambda spark: str(tmp_path))
    scans = []
    monkeypatch.setattr(scan, "page_table", lambda *args, run=scan.page_table: scans.append(args) or run(*args))
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001").count()
    left = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert rows > 0 and len(scans) == 1 and left == ["stream"]
