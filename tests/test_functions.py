"""Column helpers against hand-written cases."""

import html
import math
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from crawlsift.functions import filters, markup, params, regex, text, urls

BASE = "https://www.example.com:443/dir/page.html?p=1#top"


def values(spark, items, column, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {type_}")
    return [r[0] for r in df.select("i", column.alias("out")).orderBy("i").select("out").collect()]


@pytest.fixture(scope="module")
def resolved(spark):
    cases = {
        "//h/x": "https://h/x",
        "/a/../b": "https://www.example.com/b",
        "./x": "https://www.example.com/dir/x",
        "../../x": "https://www.example.com/x",
        "x/..": "https://www.example.com/dir/",
        "?q=1": "https://www.example.com/dir/page.html?q=1",
        "#f": "https://www.example.com/dir/page.html?p=1#f",
        "": "https://www.example.com/dir/page.html?p=1",
        "x y": "https://www.example.com/dir/x%20y",
        "/èê": "https://www.example.com/%C3%A8%C3%AA",
        "HTTP://H:80/": "http://h/",
        "http://h:8080": "http://h:8080/",
        "https:next": "https://www.example.com/dir/next",
        "\\\\h\\x": "https://h/x",
        " /t\n/u ": "https://www.example.com/t/u",
        "/a?x='y'": "https://www.example.com/a?x=%27y%27",
        "http://u:p@h/": "http://u:p@h/",
        "mailto:a@b.c": None,
        "http://": None,
        "http://a b/": None,
        "http://h:99999/": None,
        "wss://h/s": "wss://h/s",
        "/%2e%2e/a": "https://www.example.com/a",
    }
    df = spark.createDataFrame([(BASE, r) for r in cases], "page string, ref string")
    df = urls.resolve(urls.resolve(df, "page", None, "base"), "ref", "base", "out")
    return cases, {r["ref"]: r["out_href"] for r in df.collect()}


def test_resolve(resolved):
    want, got = resolved
    assert got == want


def test_hosts(spark):
    got = values(spark, ["https://A.b.C/x", "http://u@h:1/", "nothing", "https://h?q"], urls.host_of(F.col("v")))
    assert got == ["a.b.c", "h", "", "h"]
    got = values(spark, ["a.b.c.d", "b.c", "localhost"], urls.root_domain(F.col("v")))
    assert got == ["c.d", "b.c", "localhost"]
    hosts = ["app.example.com", "example.com", "api.example.com", "badexample.com", "other.org"]
    got = values(spark, hosts, urls.same_site(F.col("v"), F.lit("app.example.com")))
    assert got == [True, True, True, False, False]


# Hosts as written in a URL, and as the URL standard gives them; None where it rejects them.
HOSTS = {
    "bücher.example": "xn--bcher-kva.example", "BÜCHER.Example": "xn--bcher-kva.example", "日本語。jp": "xn--wgv71a119e.jp",
    "faß.de": "xn--fa-hia.de", "\U0001f600.com": "xn--e28h.com", "ｇｏ.com": "go.com", "x\u00ady.com": "xy.com",
    "%65xample.org": "example.org", "b%C3%BCcher.example": "xn--bcher-kva.example", "a%2Eb.com": "a.b.com",
    "%zz.org": None, "%ff.org": None, "a%20b.org": None, "a%3Ab.org": None, "a^b.org": None, "a|b.org": None, "%00.org": None,
    "0x7f.1": "127.0.0.1", "2130706433": "127.0.0.1", "0300.0250.1": "192.168.0.1", "0x": "0.0.0.0", "1.2.3.4.": "1.2.3.4",
    "017700000001": "127.0.0.1", "0xffffffff": "255.255.255.255", "4294967295": "255.255.255.255", "1.65535": "1.0.255.255",
    "4294967296": None, "256.1": None, "1.2.3.4.5": None, "1.2.3.08": None, "foo.1.2": None, "09.1": None, "1.256.1.1": None,
    "999999999999999999999": None, "1.2.3.0x1g": "1.2.3.0x1g", "1e3": "1e3", "a.b.c-": "a.b.c-", "xn--bcher-kva.example": "xn--bcher-kva.example",
    "[::1]": "[::1]", "[2001:DB8::A]": "[2001:db8::a]", "Mixed-CASE_host": "mixed-case_host", "１２７.0.0.1": "127.0.0.1",
}


def test_hosts_of_urls_are_normalised(spark):
    df = spark.createDataFrame([(h, f"http://{h}/x") for h in HOSTS], "host string, ref string")
    got = {r.host: (r.out_host, r.out_href) for r in urls.resolve(df, "ref", None, "out").collect()}
    assert got == {h: (want, want and f"http://{want}/x") for h, want in HOSTS.items()}


def test_labels_are_coded_as_by_the_standard_codec(spark):
    rng = random.Random(4)
    letters = ["a", "b", "-", "1", "ä", "ü", "一", "二", "ж", "\U0001f600", "ɐ", "z", "ﷲ"]
    labels = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(400)]
    labels = sorted({x for x in labels if not x.isascii()})
    df = spark.createDataFrame([(f"http://{x}.org",) for x in labels], "ref string")
    got = [r.out_host for r in urls.resolve(df, "ref", None, "out").collect()]
    assert got == [f"xn--{x.encode('punycode').decode()}.org" for x in labels]


def test_query_names(spark):
    many = "&".join(f"n{i}=1" for i in range(25))
    got = values(spark, ["a=1&b", "?a=1&a=2", "a+b=1", "%zz=1", "=1", "%41=2", "", many], params.query_names(F.col("v")))
    assert got[:7] == [["a", "b"], ["a"], ["a+b"], ["%zz"], [], ["A"], []]
    assert got[7] == [f"n{i}" for i in range(25)]


def test_names_that_are_no_utf8_stay_raw(spark):
    got = values(spark, ["%FF=1&a=2&%EF%BF%BD=3&%FF%EF%BF%BD=4&%C3%A9=5"], params.query_names(F.col("v")))
    assert got == [["%FF", "a", "\ufffd", "%FF%EF%BF%BD", "é"]]


REFERENCES = {
    "&#38;amp;": "&amp;", "&eacute;&#233;&#xE9": "ééé", "a&amp": "a&", "?a=1&amp=2&copy=3&b": "?a=1&amp=2&copy=3&b",
    "&notit;&amp;lt;": "&notit;&lt;", "&#0;&#x110000;&#99999999999;": "\ufffd" * 3, "&#128512;&": "\U0001f600&",
    "&unknown;z": "&unknown;z", "plain": "plain", "&AMP&lt": "&<", "&#x80;": "\u20ac", "": "",
}


def test_character_references(spark):
    got = values(spark, list(REFERENCES), markup.decode_entities(F.col("v")))
    assert got == list(REFERENCES.values())


def test_all_named_references(spark):
    """Every name of the standard, alone, before a letter and before an equals sign."""
    names = sorted(html5)
    assert len(names) == 2231
    got = values(spark, [f"x&{n}" for n in names], markup.decode_entities(F.col("v")))
    assert got == ["x" + html5[n] for n in names] == [html.unescape(f"x&{n}") for n in names]
    bare = [n for n in names if not n.endswith(";")]
    kept = [f"&{n}{after}" for n in bare for after in ("=1", "zZ9 ", "0")]
    assert values(spark, kept, markup.decode_entities(F.col("v"))) == kept
    assert values(spark, [f"&{n}-" for n in bare], markup.decode_entities(F.col("v"))) == [f"{html5[n]}-" for n in bare]


def test_nearby_names(spark):
    items = [
        'f("/x?id=1&no-pe=2&ok=3",{params:{limit:1,"offset":2,if:3}})',
        "new URLSearchParams({ page: 1, 'size': 2 })",
        "data: {a: 1, ab: 2} body:{ab:3, cd :4}",
        "?x%zz=1&good=2",
    ]
    got = values(spark, items, params.nearby_names(F.col("v")))
    assert got == [["id", "ok", "limit", "offset"], ["page", "size"], ["ab", "cd"], ["good"]]


def test_method(spark):
    items = ["AXIOS.POST(", "INPUT", "NOTHING", "DELETE THEN PUT"]
    assert values(spark, items, params.guessed_method(F.col("v"))) == ["POST", "PUT", "GET", "PUT"]


def test_endpoint_noise(spark):
    paths = ["/", "/static/a", "/a.png", "/de", "/index", "/app.min.js", "/imagery", "/IMG/x", "/login", "/a.css?x"]
    kinds = {"path": [1, 1, 1, 1, 1, 1, 0, 1, 0, 1], "dom": [1, 1, 1, 0, 0, 0, 0, 1, 0, 1], "fetch": [1, 1, 1, 0, 0, 1, 0, 1, 0, 1]}
    for kind, want in kinds.items():
        got = values(spark, paths, filters.endpoint_noise(F.col("v"), F.lit(kind)))
        assert [int(x) for x in got] == want, kind


def test_secret_noise(spark):
    bad = ["short", "${token}x", "YOUR_KEY1", "xxxxxx12", "aaaaaaaaaaaa", "my_variable", "<b>text</b>", "A_CONSTANT", "0" * 12 + "ab", "a...bcdef"]
    good = ["Ab3cfcd208495d565ef66e7dff9Z", "cfcd208495d565ef66e7dff9f98764da"]
    assert all(values(spark, bad, filters.secret_noise(F.col("v"))))
    assert not any(values(spark, good, filters.secret_noise(F.col("v"))))


def test_entropy(spark):
    got = values(spark, ["abcd", "aaaa", "aabb"], filters.entropy(F.col("v")))
    assert got == pytest.approx([2.0, 0.0, 1.0])
    items = ["cfcd208495d565ef66e7dff9f98764da", "cfcd208495d565ef66e7dff9", "getUserProfileDetailsFromCache1", "Ab3cfcd208495d565ef66e7dff9Z", "all-lower-case-words-with-1"]
    assert values(spark, items, filters.random_looking(F.col("v"))) == [True, False, False, True, False]
    assert math.isclose(values(spark, ["ab" * 8], filters.entropy(F.col("v")))[0], 1.0)


def test_snippet(spark):
    items = ["  a\r\nb \t\n\n\n\n\nc  ", " x ", "a \f\nb"]
    assert values(spark, items, text.snippet(F.col("v"))) == ["a\nb\n\n\nc".replace("b", "b   ").replace("b   ", "b"), "x", "a\nb"]


def test_windows_and_totals(spark):
    body = "".join(chr(97 + i % 26) for i in range(1500)) + "é" + "z" * 700
    df = spark.createDataFrame([(body,)], "t string").select("t", text.chunks(F.col("t")).alias("p"))
    for a, b in [(0, 10), (-5, 7), (500, 530), (511, 1030), (1490, 1510), (2100, 2500), (9, 9)]:
        got = df.select(F.expr(text.window("p", str(a), str(b)))).first()[0]
        assert got == body[max(a, 0):b], (a, b)
    for n in (0, 1, 511, 512, 513, 1300):
        nums = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(nums,)], "l array<int>").select(F.expr(text.running_totals("l"))).first()[0] if n else []
        assert got == [sum(nums[: i + 1]) for i in range(n)]


def test_text_around_a_match_is_cut_once(spark):
    """The head of the window stands once in the expression, and the window is as wide as before."""
    parts = [F.col(c) for c in ("before", "match", "after")]
    df = spark.createDataFrame([("b" * 9, "mm", "a" * 9), ("b", "mmm", ""), ("", "m" * 8, "aé"), ("bbb", "", "")], "before string, match string, after string")
    got = [r[0] for r in df.select(params.around(*parts, 3, 5)).collect()]
    assert got == [("b" * 3 + "mm" + "a" * 3), "bmmm", "m" * 5, "bbb"]
    assert str(params.around(*parts, 3, 5)).count("CASE") == 1


def test_patterns_behind_their_first_character():
    assert regex.first_chars(r"(?:url|[a-c]x|\d+)y") == r"ua-c\d"
    assert regex.first_chars(r"\bx?(y|z)") == "xyz"
    for unknown in ("(?:a|.)b", "a?", "(?:a|[^b])", "(?:[a-]|b)c", "(?=a)b", "^a", r"(?:\1|a)", "(?:a|)", ""):
        assert regex.first_chars(unknown) is None
    assert regex.guarded(r"(?i)\b(?:tok|Key)=") == r"(?i)(?=[tK])\b(?:tok|Key)="
    assert regex.guarded("ghp_[0-9]") == "ghp_[0-9]"


def test_patterns_match_the_same_behind_it(spark):
    texts = ["x.url = '/a/b' URI:'/c' Tok='1' tOK=2 kétok=3 -tok=4", "\U0001f600url:'/x'", "", "u", "endpoint = `/e`;appURL='/u'"]
    for pattern in (r"(?:url|URI|endpoint)\s*[:=]\s*['`]", r"(?i)\b(tok|KEY)=", r"(?:[a-c]|u)r?l?"):
        found = lambda p: values(spark, texts, F.regexp_extract_all("v", F.lit(regex.jvm(p)), F.lit(0)))
        assert found(regex.guarded(pattern)) == found(pattern) and regex.guarded(pattern) != pattern


def test_long_texts_are_trimmed_alike(spark):
    items = ["", " ", "a", "\ufeff a b\u2028", "\u3000", "x" * 600 + "\t\n", "\n\na\tb \n c", "é\xa0", None]
    assert values(spark, items, text.trim_long(F.col("v"))) == values(spark, items, text.trim(F.col("v")))


def test_regex_forms():
    assert regex.jvm(r"\bfetch\s") == rf"(?<!\w)fetch[{regex.SPACE}]"
    assert regex.re2(r"a\/[^\s]$") == rf"a/[^{regex.SPACE}]\z"
    assert regex.has_group(r"(?:a)(b)") and not regex.has_group(r"(?:a)[(]\(")
    assert regex.required_literals(r"ghp_[0-9]{36}") == {"ghp_"}
    assert regex.required_literals(r"(?:token|secret)x?") == {"token", "secret"}
    assert regex.required_literals(r"ab?[0-9]|cd") == set()
    assert regex.required_literals(r"[a-z]{3}") == set()


def test_markup(spark):
    html = (
        '<!-- <a href="/no"> --><A HREF="/x?a=1&amp;b=2" data-href="/y">t</A><img src=/i.png>'
        "<script>var t=\"</p>\";var u='<a href=\"/in\">'</script><script src='/s.js'></script>"
        '<p title="a > href=\'/z\'" href>q</p><textarea><a href="/ta"></textarea><a href="/end"'
    )
    df = spark.createDataFrame([(html,)], "html string").select(markup.tokens(F.col("html")).alias("t"))
    tags = df.select(F.explode("t").alias("t")).select(
        markup.tag_name(F.col("t")).alias("n"),
        markup.attribute(markup.start_tag(F.col("t")), "href").alias("h"),
        markup.attribute(markup.start_tag(F.col("t")), "src").alias("s"),
    ).collect()
    assert [tuple(r) for r in tags] == [
        ("", None, None), ("a", "/x?a=1&b=2", None), ("img", None, "/i.png"), ("script", None, None),
        ("script", None, "/s.js"), ("p", "", None), ("textarea", None, None),
    ]
    assert df.select(markup.script_bodies(F.col("t"))).first()[0] == ["var t=\"</p>\";var u='<a href=\"/in\">'"]


def test_long_expressions_stand_once(spark):
    """A context or an attribute names its text once in the plan, so that a branch does not work it out again."""
    df = spark.range(1).selectExpr("'a \\nb' AS t", "'<a href=x>' AS tag", "id")
    long = lambda c: F.concat(F.col(c), F.lit("LONG"))
    shown = df.select(F.when(F.col("id") == 0, text.snippet(long("t"))).alias("s"))
    assert shown._jdf.queryExecution().analyzed().toString().count("LONG") == 1
    assert shown.first().s == "a\nbLONG"
    value = df.select(markup.pair_value(F.array(long("tag")), F.lit("href")).alias("v"))
    assert value._jdf.queryExecution().analyzed().toString().count("LONG") == 1


def test_ports_without_failing_casts(spark):
    """No port, the default one, the greatest and one too many; a cast of '' is never tried."""
    refs = ["http://h.example", "http://h.example:", "http://h.example:080/", "http://h.example:65535/", "http://h.example:65536/", "http://h.example:999999/"]
    df = urls.resolve(spark.createDataFrame([(r,) for r in refs], "r string"), "r", None, "u")
    assert [r.u_authority for r in df.select("r", "u_authority").collect()] == ["h.example", "h.example", "h.example", "h.example:65535", None, None]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert re.search(r"__u_port#\d+ = \) OR", plan)
