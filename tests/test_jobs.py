"""Jobs on small frames: caps, roll-ups, joins, sessions and ranking against brute force."""

import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from crawlsift.functions.stage import ranked_globally
from crawlsift.operators import captures, endpoints, hostlog, review, scripts, sessions
from crawlsift.operators.candidates import page_candidates
from crawlsift.plans import scan
from crawlsift.sources.readers import read_captures
from crawlsift.sources.rules import Rule, read_rules, usable_rules

T0 = dt.datetime(2024, 1, 1)
SECRET = (
    "scan_id bigint, page_url string, host string, id string, name string, severity string, value string, "
    "context string, source string, scan_time timestamp_ntz, phase int, source_idx int, pattern_idx int, pos int"
)


def page(spark, html, url="https://www.example.com/p/", scan_id=1):
    return spark.createDataFrame(
        [(scan_id, url, html, T0)], "scan_id bigint, page_url string, html string, scan_time timestamp_ntz"
    )


def test_rules_and_entropy(spark):
    rules = [
        Rule("tok", "Token", "high", r"tok_([0-9a-f]{8,40})"),
        Rule("broken", "Broken", "low", r"([a-z"),
        Rule("any", "Any Case", "low", r"(?i)KEY=[0-9a-f]{10}"),
    ]
    usable = usable_rules(spark, rules)
    assert [r.id for r in usable] == ["tok", "any"]
    named = "Ab3cfcd208495d565ef66e7dff9Z"
    text = 'tok_deadbeef12 key=0123456789 "%s" tok_xxxxxxxx "%s"' % (named, "cfcd208495d565ef66e7dff9f98764da")
    text += " " + " ".join(f"tok_{i:010x}" for i in range(40))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = scan.text_secrets(docs, usable, ["doc_id"]).orderBy("pattern_idx", "pos").collect()
    toks = [r for r in rows if r.id == "tok"]
    # The placeholder among 42 matches is filtered out, no match is cut.
    assert len(toks) == 41 and toks[0].value == "deadbeef12"
    assert [r.value for r in rows if r.id == "any"] == ["key=0123456789"]
    assert {r.value for r in rows if r.id == "high-entropy"} == {named, "cfcd208495d565ef66e7dff9f98764da"}
    assert all(text[r.pos:].startswith(("tok_", "key=", '"')) for r in rows)


def test_many_rules_are_one_table(spark):
    """5,000 rules: planned in seconds, and the same values as each rule by itself."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rules = []
    for i in range(5000):
        kind = i % 5
        name = word(rng.randint(2, 6))
        rules.append(Rule(f"r{i}", f"R{i}", "low", [
            rf"{name}_([0-9a-f]{{16,20}})", rf"(?i){name}key=[0-9a-f]{{16}}", rf"(?:{name}|{word(4)})-[0-9]{{12}}z", rf"\b{name[:2]}[0-9]{{17}}\b", rf"^{name}:([0-9A-F]{{18}})$",
        ][kind]))
    pieces, hexa = [], "0123456789abcdef"
    for r in rng.sample(rules, 300):
        name = r.regex.removeprefix("(?i)")
        token = "".join(rng.choice(hexa) for _ in range(18))
        digits = "".join(rng.choice("123456789") for _ in range(17))
        stem = name.strip("^").split("_(")[0].split("key=")[0].split(":(")[0].split("|")[0].replace("(?:", "").replace(r"\b", "").split("[")[0]
        pieces += [f"{stem}_{token}", f"{stem.upper()}KEY={token[:16]}", f"{stem}-{digits[:12]}z", f"{stem}{digits}", f"\n{stem}:{token.upper()}\n"]
    rng.shuffle(pieces)
    texts = [" ".join(pieces[i::10]) for i in range(10)] + ["", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = time.time()
    df = scan.text_secrets(docs, rules, ["doc_id"])
    df._jdf.queryExecution().executedPlan()
    assert time.time() - start < 5
    got = {(r.doc_id, r.id, r.value) for r in df.collect() if r.id != "high-entropy"}
    want = set()
    for i, text in enumerate(texts):
        for r in rules:
            for m in re.finditer(r.regex, text, re.M):
                want.add((i, r.id, m.group(1) if m.re.groups else m.group(0)))
    assert len(want) > 300 and got == want


def test_rules_work_line_by_line(spark):
    text = "k=abcdef1234XY\nnext\r\nk=zbcdef1234XY\rj=1 k=ybcdef1234XY"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rules = usable_rules(spark, [Rule("k", "K", "low", r"^k=([0-9a-zA-Z]+)$")])
    found = scan.text_secrets(docs, rules, ["doc_id"]).collect()
    assert sorted((r.value, r.pos) for r in found) == [("abcdef1234XY", 0), ("zbcdef1234XY", 21)]


def test_rule_table_of_two_files(spark, tmp_path):
    rule = {"name": "N", "severity": "low"}
    (tmp_path / "1.json").write_text(json.dumps([{"id": "b", "regex": "x", **rule}, {"id": "a", "regex": "(", **rule}]))
    (tmp_path / "2.json").write_text(json.dumps([{"id": "c", "regex": "y", **rule}]))
    table = read_rules(spark, str(tmp_path))
    assert [(r.rule_idx, r.id) for r in table.orderBy("rule_idx").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    assert [r.id for r in usable_rules(spark, table)] == ["b", "c"]


def test_live_scan_without_findings(spark):
    found = secrets(spark, [(1, "a", "A", "low", "v1", 0)])
    host = found.first().host
    scans = spark.createDataFrame([(host, T0, 1), (host, T0 + dt.timedelta(seconds=9), 2)], "host string, scan_time timestamp_ntz, scan_id long")
    assert sessions.live_scans(found, scans).count() == 0
    assert sessions.live_scans(found, scans.filter("scan_id = 1")).count() == 1


def test_rule_value_hides_entropy(spark):
    value = "cfcd208495d565ef66e7dff9f98764da"
    docs = spark.createDataFrame([(1, f'token = "{value}"')], "doc_id int, text string")
    rows = scan.text_secrets(docs, usable_rules(spark), ["doc_id"]).collect()
    assert [(r.id, r.value) for r in rows] == [("generic-token", value)]


def test_no_cap_per_pattern(spark):
    html = " ".join(f'fetch("/api/item/{i}")' for i in range(2000))
    rows = scan.page_endpoints(page(spark, html), dom=False, inline=False).collect()
    assert {(r.kind, r.path) for r in rows} == {("fetch", f"/api/item/{i}") for i in range(2000)} and len(rows) == 2000


def test_long_element_context(spark):
    html = "<a href='/far'>" + " \n" * 3000 + "x" * 50 + "</a><form action=''>" + "y" * 3000 + "</form>"
    rows = {r.path: r for r in scan.page_endpoints(page(spark, html), inline=False, text=False).collect()}
    assert rows["/far"].context == "<a href='/far'>\n\n\n" + "x" * 50 + "</a>"
    assert rows["/p"].context == ("<form action=''>" + "y" * 3000)[:900]


def test_elements_come_with_no_more_than_their_end_tag(spark):
    """The window of a link is not filled up with the page after it."""
    far = "<A href='/far'>" + "z" * 300 + "</A\n>"
    html = "<a href='/near' title='</a>'>t</a>" + "x" * 3000 + far + "y" * 3000 + "<a href='/open'>" + "w" * 3000
    found = page_candidates(endpoints.with_base(page(spark, html)), inline=False, endpoints=False).orderBy("pos").collect()
    assert [r.after for r in found] == ["t</a>", "z" * 300 + "</A\n>", "w" * 1800]
    rows = {r.path: r for r in scan.page_endpoints(page(spark, html), inline=False, text=False).collect()}
    assert rows["/near"].context == "<a href='/near' title='</a>" and rows["/far"].context == far
    assert rows["/open"].context == ("<a href='/open'>" + "w" * 3000)[:900]


def test_findings_of_other_hosts_get_no_context(spark):
    html = '<a href="https://other.invalid/out">o</a><a href="/in/here">i</a><script>var u="https://elsewhere.org/api";</script>'
    matches = scan.page_table(page(spark, html), None)
    raw = scan.endpoint_table(matches, scan.body_table(spark.createDataFrame([], "url string, status int, content_type string, body string"), None))
    assert {r.res_host for r in raw.collect()} == {"www.example.com"}


def test_live_step_gets_newest_scans_only(spark):
    found = spark.range(40).selectExpr("id % 4 AS scan_id", "concat('h', id % 8) AS host", "id AS n")
    newest = sessions.newest_scans(spark.createDataFrame(
        [("h1", T0, 1), ("h1", T0 + dt.timedelta(seconds=9), 0), ("h5", T0, 1), ("h2", T0, 2), ("h6", T0, 3)],
        "host string, scan_time timestamp_ntz, scan_id long"))
    given = []
    live = sessions.live_findings(found, newest, lambda df: given.append(df) or df)
    # Whole scans go in, those of other hosts too; a host's findings in an older scan do not come out.
    assert {(r.scan_id, r.host) for r in given[0].collect()} == {(s, f"h{h}") for s in range(4) for h in (s, s + 4)}
    assert {(r.scan_id, r.host) for r in live.collect()} == {(1, "h5"), (2, "h2")}


def test_body_on_many_pages(spark):
    pages = page(spark, '<script src="/a.js"></script>', "https://www.example.com/1", 1).unionByName(
        page(spark, '<script src="https://www.example.com/a.js"></script>', "http://api.example.com/2", 2)
    )
    body = 'fetch("/v1/x");var u="https://example.com/abs";axios.get("api/rel");fetch("//cdn.other.org/y")'
    bodies = spark.createDataFrame(
        [("https://www.example.com/a.js", 200, "text/javascript", body)],
        "url string, status int, content_type string, body string",
    )
    matches = scan.page_table(pages, None)
    raw = scan.endpoint_table(matches, scan.body_table(bodies, None))
    rows = scan.body_findings(scan.page_sources(matches), raw).collect()
    got = {(r.scan_id, r.url) for r in rows}
    assert got == {
        (1, "https://www.example.com/v1/x"), (1, "https://example.com/abs"),
        (1, "https://www.example.com/api/rel"), (1, "https://cdn.other.org/y"),
        (2, "http://api.example.com/v1/x"), (2, "https://example.com/abs"),
        (2, "http://api.example.com/api/rel"), (2, "http://cdn.other.org/y"),
    }


def test_spread_join_hot_key(spark):
    many = spark.range(500).selectExpr("id AS scan_id", "CASE WHEN id < 400 THEN 'hot' ELSE concat('k', id) END AS k")
    per = spark.createDataFrame([("hot", 1), ("hot", 2), ("k450", 3), ("none", 4)], "k string, n int")
    assert scripts.spread_join(many, per, "k", "scan_id").count() == 801


def secrets(spark, rows):
    full = [
        (s, f"https://h/{s}", "h", i, n, sev, v, f"c{s}", f"src{s}", T0 + dt.timedelta(seconds=s), 3, 0, 0, p)
        for s, i, n, sev, v, p in rows
    ]
    return spark.createDataFrame(full, SECRET)


def test_host_log_lists_and_split(spark):
    rows = [(s, "a", "A", "low", "v1", 0) for s in range(60)] + [(70, "b", "B", "critical", "v1", 0), (3, "c", "C", "odd", "v2", 0)]
    found = secrets(spark, rows)
    log = {r.value: r for r in hostlog.host_secrets(found).collect()}
    one = log["v1"]
    assert one.occurrences == 61 and one.severity == "critical" and one.name == "B"
    assert one.ids == ["a", "b"] and one.page_urls == [f"https://h/{s}" for s in [*range(60), 70]]
    assert len(one.sources) == 61 and one.contexts == ["c0"]
    assert one.first_seen == T0 and one.last_seen == T0 + dt.timedelta(seconds=70)
    assert log["v2"].severity == "odd"
    stats = hostlog.host_stats(hostlog.secret_facts(found), hostlog.endpoint_facts(_no_endpoints(spark))).first()
    assert (stats.unique_secrets, stats.unique_endpoints, stats.page_count) == (2, 0, 61)


def test_facts_merge_for_any_split(spark):
    rows = [(s, "abc"[s % 3], ["A", "", "B"][s % 3], ["low", "critical"][s % 2], f"v{s % 4}", s % 2) for s in range(40)]
    found = secrets(spark, rows)
    whole = sorted(hostlog.host_secrets(found).collect())
    for rule in ("scan_id < 7", "scan_id % 5 = 2", "scan_id < 0"):
        parts = [hostlog.secret_facts(found.where(rule)), hostlog.secret_facts(found.where(f"NOT {rule}"))]
        for a, b in (parts, parts[::-1]):
            assert sorted(hostlog.secret_log(hostlog.merge_facts(a, b)).collect()) == whole


def _no_endpoints(spark):
    return scan.page_endpoints(page(spark, ""))


def test_merged_keeps_both_sides(spark):
    log = hostlog.host_secrets(secrets(spark, [(1, "a", "A", "low", "both", 0), (1, "a", "A", "high", "old", 1)]))
    live = secrets(spark, [(2, "b", "B", "medium", "both", 0), (2, "b", "B", "low", "new", 1)])
    rows = {r.value: r for r in review.merged_secrets(log, live).collect()}
    assert set(rows) == {"both", "old", "new"}
    both = rows["both"]
    assert (both.id, both.severity, both.occurrences) == ("b", "medium", 1)
    assert both.names == ["A", "B"] and both.sources == ["src1", "https://h/1", "src2"]
    assert rows["old"].id == "a" and rows["new"].id == "b"


@pytest.mark.parametrize("n", [1, 2, 7, 101])
def test_retention(spark, n):
    rng = random.Random(n)
    rows = [(f"h{i}", None if i % 10 == 9 else T0 + dt.timedelta(hours=rng.randrange(5))) for i in range(n)]
    df = spark.createDataFrame(rows, "host string, updated_at timestamp_ntz")
    got = {r.host for r in hostlog.retention_prune(df, "h0").collect()}
    others = sorted((r for r in rows if r[0] != "h0"), key=lambda r: (r[1] is not None, r[1] or T0, r[0]))
    quota = max(1, len(others) // 2)
    assert got == {h for h, _ in others[:quota]}


def test_ranked_globally(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    rows = ranked_globally(df, [F.col("g"), F.col("id")]).collect()
    want = sorted(range(1000), key=lambda i: (i % 3, i))
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == want and rows[0].total == 1000


def test_debounce_edges(spark):
    ms = lambda *xs: [(1, i, T0 + dt.timedelta(milliseconds=x), f"u{i}") for i, x in enumerate(xs)]
    schema = "tab_id int, nav_id int, ts timestamp_ntz, url string"
    for gaps, want in [((0, 119), 1), ((0, 120), 1), ((0, 121), 2)]:
        assert sessions.nav_sessions(spark.createDataFrame(ms(*gaps), schema)).count() == want


def test_sessions_across_hours(spark):
    rng, rows, t = random.Random(5), [], 0
    for i in range(300):
        t += rng.choice([1, 20, 50, 70, 200]) * 60
        rows.append((i % 2, i, T0 + dt.timedelta(seconds=t), f"u{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, "tab_id int, nav_id int, ts timestamp_ntz, url string")
    found = sessions.nav_sessions(df, "1 hour")
    want = []
    for tab in (0, 1):
        last = None
        for r in [r for r in rows if r[0] == tab]:
            if last is None or r[2] - last > dt.timedelta(hours=1):
                want.append([tab, r[2], r[2], r[1], r[3], 0])
            want[-1][2:5] = [r[2], r[1], r[3]]
            want[-1][5] += 1
            last = r[2]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    triggers = {(r.tab_id, r.started_at) for r in sessions.rescan_triggers(found).collect()}
    expected, before = set(), {}
    for tab, start, _, _, url, _ in sorted(want):
        if before.get(tab) != url:
            expected.add((tab, start))
        before[tab] = url
    assert triggers == expected


def test_capture_index_and_view(spark, tmp_path):
    lines = [
        '[["original","mimetype","timestamp","endtimestamp","groupcount","uniqcount"],',
        '["https://h/b","text/css","20200102000000","20210101000000","3","2"],',
        '["https://h/A","text/html","20210102000000","2021","12","2"]]',
    ]
    (tmp_path / "index.json").write_text("\n".join(lines))
    df = read_captures(spark, str(tmp_path)).selectExpr("*", "'h' AS host", "original AS urlkey")
    assert [r.groupcount for r in captures.capture_view(df, sort="most").collect()] == [12, 3]
    assert [r.original for r in captures.capture_view(df, sort="url-az").collect()] == ["https://h/A", "https://h/b"]
    shown = captures.capture_view(df, mime="text/html").first()
    assert (shown.first_day, shown.last_day) == ("2021-01-02", "2021")
    assert [r[0] for r in captures.capture_mimes(df).collect()] == ["text/html", "text/css"]


def test_time_ago(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(seconds=s),) for s in (4, 59, 60, 3599, 7200)], "t timestamp_ntz")
    as_of = F.lit(T0).cast("timestamp_ntz")
    got = {r[0] for r in df.select(review.time_ago(F.col("t"), as_of)).collect()}
    assert got == {"just now", "59s ago", "1m ago", "59m ago", "2h ago"}
    labels = spark.createDataFrame([(0,), (99,), (100,)], "n int").select(hostlog.count_label(F.col("n"))).collect()
    assert [r[0] for r in labels] == ["", "99", "99+"]


def test_entries_are_resolved_once_and_dealt_out(spark):
    """Repeated requests of a page make the findings of their first ones, on more than one task."""
    rows = [(i, i % 3, f"https://www.example.com/{i % 3}", ["/api/a?x=1", "/api/b", "https://other.invalid/c"][i % 7 % 3], "fetch", T0 + dt.timedelta(seconds=i)) for i in range(300)]
    kind = "entry_id long, scan_id long, page_url string, name string, initiator_type string, ts timestamp_ntz"
    entries = spark.createDataFrame(rows, kind)
    first = endpoints.first_entries(entries)
    assert first.count() == 9 and first.rdd.getNumPartitions() > 1
    key = ["scan_id", "url", "kind", "entry_id", "scan_time"]
    got = {tuple(r) for r in endpoints.network_endpoints(first).select(key).collect()}
    want = {}
    for r in endpoints.network_endpoints(entries).select(key).collect():
        k = (r.scan_id, r.url, r.kind)
        want[k] = min(want.get(k, (r.entry_id, r.scan_time)), (r.entry_id, r.scan_time))
    assert got == {(*k, *v) for k, v in want.items()} and len(got) == 6
