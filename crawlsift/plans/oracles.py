"""DuckDB SQL for the registered queries, built from named common table expressions."""

from __future__ import annotations

from html.entities import codepoint2name

from crawlsift.functions import fixed, markup, urls
from crawlsift.functions.regex import SPACE, has_group, re2
from crawlsift.operators.candidates import DOM_GROUPS
from crawlsift.operators.captures import SORTS
from crawlsift.sources.rules import DEFAULT_RULES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return lit(re2(pattern))


def trim(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '', 'g')"


def snippet(e: str) -> str:
    e = f"regexp_replace({e}, '\\r\\n?', chr(10), 'g')"
    e = f"replace({e}, chr(9), '  ')"
    e = f"regexp_replace({e}, '[ \\f\\x0B]+(\\n|\\x{{2028}}|\\x{{2029}}|\\z)', '\\1', 'g')"
    e = f"regexp_replace({e}, '\\n{{4,}}', chr(10)||chr(10)||chr(10), 'g')"
    return trim(e)


def uniq(e: str) -> str:
    """First-seen distinct of a list expression."""
    return f"list_filter({e}, lambda v, i: list_position({e}, v) = i)"


def ts(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S.%f')"


def encode(e: str, unsafe: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({e}, ''), lambda ch: CASE WHEN "
        f"regexp_matches(ch, {lit(unsafe)}) THEN regexp_replace(hex(ch), '(..)', '%\\1', 'g') ELSE ch END), '')"
    )


def dots(e: str) -> str:
    dot = f"list_contains(['.', '%2e'], lower(x))"
    two = f"list_contains(['..', '.%2e', '%2e.', '%2e%2e'], lower(x))"
    last = f"lower(string_split({e}, '/')[-1])"
    return (
        f"(list_reduce(string_split({e}, '/')[2:], lambda acc, x: CASE WHEN {two} THEN regexp_replace(acc, '/[^/]*\\z', '') "
        f"WHEN {dot} THEN acc ELSE acc || '/' || x END, '') || CASE WHEN {last} IN ('.', '..', '%2e', '.%2e', '%2e.', '%2e%2e') THEN '/' ELSE '' END)"
    )


def resolve(src: str, ref: str, base: str | None, o: str) -> str:
    """SELECT that adds {o}_href, {o}_host ... for the reference column ``ref``."""
    b = (lambda n: f"{base}_{n}") if base else (lambda n: "CAST(NULL AS VARCHAR)")
    ports = " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in urls.DEFAULT_PORTS.items())
    schemes = ", ".join(f"'{s}'" for s in urls.DEFAULT_PORTS)
    host_rx = r"'^(?:.*@)?(\[[0-9a-fA-F:.]+\]|[^:@]*)(?::[0-9]*)?\z'"
    return f"""SELECT *,
 regexp_replace(regexp_replace({ref}, '^[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g'), '[\\t\\n\\r]', '', 'g') AS {o}_1,
 lower(regexp_extract({o}_1, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS {o}_given,
 CASE WHEN {o}_given = '' THEN {o}_1 ELSE substr({o}_1, length({o}_given) + 2) END AS {o}_rest,
 replace(regexp_extract({o}_rest, '^[^?#]*'), '\\', '/') AS {o}_main,
 regexp_extract({o}_rest, '^[^?#]*(\\?[^#]*)?', 1) AS {o}_q,
 regexp_extract({o}_rest, '(?s)^[^#]*(#.*)?', 1) AS {o}_f,
 CASE WHEN {o}_given = '' THEN {b('scheme')} ELSE {o}_given END AS {o}_scheme0,
 ({o}_given <> '' AND {o}_given IS DISTINCT FROM {b('scheme')}) OR starts_with({o}_main, '//') AS {o}_full,
 regexp_extract({o}_main, '^/*([^/]*)', 1) AS {o}_auth,
 CASE WHEN {o}_full THEN lower(regexp_extract({o}_auth, {host_rx}, 1)) ELSE {b('host')} END AS {o}_host0,
 regexp_replace(regexp_extract({o}_auth, ':([0-9]+)\\z', 1), '^0+([0-9])', '\\1') AS {o}_port0,
 CASE WHEN {o}_port0 = CASE {o}_scheme0 {ports} END THEN '' ELSE {o}_port0 END AS {o}_port,
 regexp_extract({o}_auth, '^(.*@)?', 1) AS {o}_user,
 CASE WHEN {o}_full THEN {o}_user || {o}_host0 || CASE WHEN {o}_port = '' THEN '' ELSE ':' || {o}_port END
      ELSE {b('authority')} END AS {o}_authority,
 CASE WHEN {o}_full THEN regexp_replace({o}_main, '^/*[^/]*', '')
      WHEN starts_with({o}_main, '/') THEN {o}_main
      WHEN {o}_main = '' THEN {b('path')}
      ELSE regexp_extract({b('path')}, '^(.*/)', 1) || {o}_main END AS {o}_p1,
 {encode(f'{o}_p1', urls.PATH_UNSAFE)} AS {o}_p2,
 CASE WHEN {o}_p2 = '' THEN '/' ELSE {dots(f'{o}_p2')} END AS {o}_path,
 CASE WHEN NOT {o}_full AND {o}_main = '' AND {o}_q = '' THEN {b('search')}
      ELSE {o}_q[1:1] || {encode(f'{o}_q[2:]', urls.QUERY_UNSAFE)} END AS {o}_search,
 {o}_f[1:1] || {encode(f'{o}_f[2:]', urls.FRAGMENT_UNSAFE)} AS {o}_hash,
 ({o}_given = '' OR {o}_given IN ({schemes})) AND {o}_host0 IS NOT NULL AND {o}_host0 <> ''
   AND (starts_with({o}_host0, '[') OR NOT regexp_matches({o}_host0, {lit(urls.HOST_FORBIDDEN)}))
   AND coalesce(try_cast({o}_port AS INTEGER), 0) <= 65535 AS {o}_ok,
 CASE WHEN {o}_ok THEN {o}_scheme0 END AS {o}_scheme,
 CASE WHEN {o}_ok THEN {o}_host0 END AS {o}_host,
 CASE WHEN {o}_ok THEN {o}_scheme0 || '://' || {o}_authority || {o}_path || {o}_search || {o}_hash END AS {o}_href
FROM {src}"""


def same_site(host: str, page: str) -> str:
    root = f"array_to_string(string_split({page}, '.')[-2:], '.')"
    return f"({host} = {page} OR {host} = {root} OR ends_with({host}, '.' || {root}))"


def noise(path: str, kind: str) -> str:
    return f"""(length({path}) < 2 OR regexp_matches({path}, {rx(fixed.STATIC_DIR)}) OR regexp_matches({path}, {rx(fixed.STATIC_EXT)})
 OR ({kind} NOT IN ('dom', 'inline') AND regexp_matches({path}, {rx(fixed.SCRIPT_ASSET)}))
 OR ({kind} = 'path' AND (length({path}) < 4 OR regexp_matches({path}, {rx(fixed.PATH_NOISE)}) OR regexp_matches({path}, {rx(fixed.SINGLE_NOISE)}))))"""


def secret_noise(v: str) -> str:
    tests = " OR ".join(f"regexp_matches({v}, {rx(p)})" for p in fixed.SECRET_PLACEHOLDERS)
    return f"(length({v}) < 8 OR {tests} OR (length({v}) > 10 AND length(replace({v}, {v}[1:1], '')) = 0))"


def attribute(tag: str, name: str) -> str:
    pairs = f"regexp_extract_all(regexp_replace({tag}, '^<[a-zA-Z][^\\t\\n\\f\\r />]*', ''), {lit(markup.ATTRIBUTE)})"
    mine = f"list_filter({pairs}, lambda a: regexp_matches(a, '(?i)^{name}(?:{markup.WS}*=|\\z)'))[1]"
    value = f"regexp_replace({mine}, '^[^=]*(?:={markup.WS}*)?', '')"
    value = f"(CASE WHEN regexp_matches({value}, {lit('''^["']''')}) THEN {value}[2:-2] ELSE {value} END)"
    return f"CASE WHEN contains({value}, '&') THEN {references(value)} ELSE {value} END"


def references(e: str) -> str:
    """Character references replaced: every "&" begins a piece that is decoded by itself."""
    latin = {n: chr(i) for i, n in codepoint2name.items() if i < 256}
    entries = [(n + ";", chr(i)) for i, n in codepoint2name.items()] + [("apos;", "'")]
    entries += [*latin.items(), ("AMP", "&"), ("COPY", "\xa9"), ("GT", ">"), ("LT", "<"), ("QUOT", '"'), ("REG", "\xae")]
    names = "MAP {" + ", ".join(f"{lit(n)}: {lit(c)}" for n, c in entries) + "}"
    name = "regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9]*;?')"
    hexed, digits = "regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1)", "regexp_extract(p, '^#([0-9]+)', 1)"
    number = f"coalesce(try_cast(CASE WHEN {hexed} <> '' THEN '0x' || {hexed} ELSE {digits} END AS BIGINT), 0)"
    return (
        f"array_to_string(list_transform(string_split({e}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
        f"WHEN regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])') THEN "
        f"(CASE WHEN {number} BETWEEN 1 AND 1114111 THEN chr({number}::INTEGER) ELSE chr(65533) END) || regexp_replace(p, '^#([xX][0-9a-fA-F]+|[0-9]+);?', '') "
        f"WHEN starts_with(substr(p, length({name}) + 1), '=') AND NOT ends_with({name}, ';') THEN '&' || p "
        f"ELSE coalesce(map_extract({names}, {name})[1] || substr(p, length({name}) + 1), '&' || p) END), '')"
    )


def cut(text: str, start: str, end: str) -> str:
    """Characters [start, end), clamped at 0."""
    return f"substr({text}, greatest({start}, 0) + 1, {end} - greatest({start}, 0))"


def bare(p: str) -> str:
    return f"coalesce(nullif(regexp_replace({p}, '/+\\z', ''), ''), '/')"


def query_names(q: str) -> str:
    raw = f"list_filter(list_transform(string_split(regexp_replace({trim(q)}, '^\\?', ''), '&'), lambda p: string_split(p, '=')[1]), lambda n: n <> '')"
    names = f"list_filter(list_transform({raw}, lambda n: {trim('coalesce(try(url_decode(n)), n)')}), lambda n: n <> '')"
    return uniq(names)


def _keys(bodies: str) -> str:
    return (
        f"flatten(list_transform({bodies}, lambda body: list_transform(regexp_extract_all(body, {rx(fixed.OBJECT_KEY)}), "
        f"lambda k: regexp_extract(k, '[a-zA-Z_][a-zA-Z0-9_]*'))))"
    )


def nearby_names(win: str) -> str:
    qs = f"regexp_extract({win}, {rx(fixed.QUERY_STRING)}, 1)"
    first = (
        f"list_filter(list_transform(string_split({qs}, '&'), lambda p: try(url_decode(string_split(p, '=')[1]))), "
        f"lambda n: n IS NOT NULL AND regexp_matches(n, {rx(fixed.PARAM_NAME)}))"
    )
    words = "[" + ", ".join(lit(w) for w in fixed.JS_KEYWORDS) + "]"
    lits = _keys(f"regexp_extract_all({win}, {rx(fixed.OBJECT_LITERAL)}, 1)")
    lits = f"list_filter({lits}, lambda k: NOT list_contains({words}, k))"
    search = _keys(f"regexp_extract_all({win}, {rx(fixed.SEARCH_PARAMS)}, 1)")
    return f"list_concat({first}, {lits}, {search})"


def severity_rank(e: str, unknown: int) -> str:
    whens = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.SEVERITIES))
    return f"CASE {e} {whens} ELSE {unknown} END"


# --- common table expressions, by name: (needs, text) -------------------------

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], text: str) -> None:
    CTES[name] = (needs, text)


def query(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for n in CTES[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}" if parts else body


cte("scan_src", [], """SELECT page_id, url, host, scheme, concat(html,
 '<form action="/api/v', page_id % 3, '/login?next=home" method="post"></form><form action=""></form>',
 '<iframe src="//', host, '/embed/', page_id % 7, '"></iframe><link href="/static/app.css">',
 '<img src="/img/', page_id % 5, '.png"><script src="/js/app.js?v=', page_id % 4, '"></script>',
 '<a href="../up/./x/', page_id % 6, '?b=2&amp;a=1#frag">u</a><a href="mailto:x@example.com">m</a>',
 '<a href="https://other.invalid/out">o</a>',
 '<script>fetch("/api/v1/users?id=', page_id % 11, '");axios.post("api/v2/items",{params:{limit:1,offset:2}});',
 'xhr.open("DELETE","/api/v1/items/', page_id % 9, '");var baseUrl = "https://', host, '/rest/q";',
 'var chunk="/chunks/', page_id % 8, '.js";var token = "', md5(cast(page_id % 50 as string)), '";',
 'var k="Ab3', substr(md5(cast(page_id % 20 as string)), 1, 24), 'Z";var n="your_token_placeholder_here";</script>') AS html
FROM (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
             regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages) p""")

cte("bodies", ["scan_src"], """SELECT DISTINCT concat(scheme, '://', host, '/js/app.js?v=', v) AS url,
 CASE WHEN v = 3 THEN 404 ELSE 200 END AS status,
 CASE WHEN v = 2 THEN 'image/png' ELSE 'application/javascript' END AS content_type,
 concat('router.get("/api/v1/orders/', v, '");$.ajax("/api/v3/cart?x=', v, '");var s="', md5(host), '";') AS body
FROM (SELECT scheme, host, page_id % 4 AS v FROM scan_src) q""")

cte("event_pages", ["scan_src"], """SELECT e.*, p.url AS page_url, p.host AS page_host
FROM (SELECT e0.*, e0.event_id % c.n AS pid FROM events e0 CROSS JOIN (SELECT count(*) AS n FROM pages) c) e
JOIN scan_src p ON p.page_id = e.pid""")

cte("pg", ["scan_src"], """SELECT page_id AS scan_id, url AS page_url, html,
 TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS scan_time FROM scan_src""")

cte("based", ["pg"], f"SELECT * EXCLUDE (html) FROM ({resolve('(SELECT scan_id, page_url, scan_time, html FROM pg)', 'page_url', None, 'base')}) WHERE base_host IS NOT NULL")

cte("tok", ["pg"], f"""SELECT scan_id, i, match AS token, lower(regexp_extract(match, '^<([a-zA-Z][^\\t\\n\\f\\r />]*)', 1)) AS tag,
 regexp_extract(match, {lit('(?i)^<[a-z][^' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'f' + chr(92) + 'r />]*' + markup.attributes_pattern(False) + '>')}) AS start_tag,
 CAST(sum(length(gap) + length(match)) OVER (PARTITION BY scan_id ORDER BY i) - length(match) AS BIGINT) AS pos
FROM (SELECT scan_id, unnest(regexp_extract_all(html, {lit(markup.token_pattern(False))})) AS match,
 unnest(string_split_regex(html, {lit(markup.token_pattern(False))})) AS gap,
 generate_subscripts(string_split_regex(html, {lit(markup.token_pattern(False))}), 1) AS i FROM pg) WHERE match IS NOT NULL""")

cte("script", ["tok"], f"""SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY pos) - 1 AS block_idx, text FROM (
 SELECT scan_id, pos, regexp_replace(substr(token, length(start_tag) + 1), '(?i)</script[\\t\\n\\f\\r />]?\\z', '') AS text
 FROM tok WHERE tag = 'script' AND {attribute('start_tag', 'src')} IS NULL) WHERE {trim('text')} <> ''""")


def matches(src: str, key: str, patterns) -> str:
    """UNION over patterns: key columns, text, idx, i, match, pos (0-based)."""
    parts = []
    for idx, pattern in patterns:
        parts.append(
            f"SELECT {key}, text, {idx} AS idx, unnest(regexp_extract_all(text, {lit(pattern)})) AS match, "
            f"unnest(string_split_regex(text, {lit(pattern)})) AS gap, "
            f"generate_subscripts(string_split_regex(text, {lit(pattern)}), 1) AS i FROM {src}"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""SELECT * EXCLUDE (gap), CAST(sum(length(gap) + length(match)) OVER (PARTITION BY {key}, idx ORDER BY i) - length(match) AS BIGINT) AS pos
FROM ({union}) WHERE match IS NOT NULL"""


TEXT_RX = [(i, re2(p)) for i, (_, p) in enumerate(fixed.TEXT_PATTERNS)]
KIND_CASE = "CASE idx " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(fixed.TEXT_PATTERNS)) + " END"
LAST_QUOTED = """regexp_extract(match, '[''"`]([^''"`]*)[''"`]\\z', 1)"""


def around(margin: int) -> str:
    return snippet(cut("text", f"pos - {margin}", f"pos + length(match) + {margin}"))


# DOM elements
_group = "CASE " + " ".join(
    f"WHEN tag IN ({', '.join(lit(n) for n in names)}) THEN {i}" for i, (names, _) in enumerate(DOM_GROUPS)
) + " END"
_attr = "CASE " + " ".join(
    f"WHEN tag IN ({', '.join(lit(n) for n in names)}) THEN {attribute('start_tag', a)}" for names, a in DOM_GROUPS
) + " END"
_closed = "CASE tag " + " ".join(
    f"WHEN '{n}' THEN regexp_extract(rest, '(?is)^.*?</{n}[\\t\\n\\f\\r ]*>')" for n in ("a", "form", "video", "audio")
) + " ELSE token END"
_dom_skip = rx(fixed.DOM_SKIP)
cte("dom_ref", ["tok", "based"], f"""SELECT d.*, b.* EXCLUDE (scan_id),
 CASE WHEN tag = 'form' AND attr = '' THEN base_path ELSE attr END AS attr2,
 {trim("CASE WHEN tag = 'form' AND attr = '' THEN base_path ELSE attr END")} AS raw
FROM (SELECT t.scan_id, token, tag, start_tag, pos, {_group} AS grp, {_attr} AS attr,
 CASE WHEN tag = 'form' THEN upper(coalesce(nullif({attribute('start_tag', 'method')}, ''), 'GET')) ELSE 'GET' END AS method,
 substr(p.html, pos + 1) AS rest FROM tok t JOIN pg p USING (scan_id)
 WHERE tag IN ('a', 'form', 'iframe', 'script', 'link', 'img', 'source', 'video', 'audio')) d
JOIN based b USING (scan_id) WHERE attr IS NOT NULL""")
cte("dom_all", ["dom_ref"], f"""SELECT scan_id, page_url, base_host AS host, scan_time, {bare('res_path')} AS path, res_search[2:] AS query,
 method, {query_names('res_search[2:]')} AS params, 'dom' AS kind, page_url AS source,
 ({snippet(f"coalesce(nullif({_closed}, ''), rest)")})[1:{fixed.DOM_CONTEXT}] AS context, raw AS raw_match,
 res_href AS url, res_href AS href, 1 AS phase, 0 AS source_idx, grp AS pattern_idx, pos
FROM ({resolve(f"(SELECT * FROM dom_ref WHERE raw <> '' AND NOT regexp_matches(raw, {_dom_skip}))", 'raw', 'base', 'res')})
WHERE res_host = base_host AND NOT {noise(bare('res_path'), "'dom'")}""")

ENDPOINT_COLS = (
    "scan_id, page_url, host, path, query, method, params, kind, source, context, raw_match, url, href, "
    "scan_time, phase, source_idx, pattern_idx, pos"
)
ORD = "phase, source_idx, pattern_idx, pos"


def firsts(src: str, key: str) -> str:
    return f"SELECT {ENDPOINT_COLS} FROM {src} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {ORD}) = 1"


cte("dom", ["dom_all"], firsts("dom_all", "scan_id, method, url"))

# Inline scripts
cte("inline_m", ["script"], matches("script", "scan_id, block_idx", [(i, re2(p)) for i, p in enumerate(fixed.INLINE_PATTERNS)]))
cte("inline_all", ["inline_m", "based"], f"""SELECT scan_id, page_url, base_host AS host, scan_time, {bare('res_path')} AS path,
 res_search[2:] AS query, 'GET' AS method, {query_names('res_search[2:]')} AS params, 'inline' AS kind, page_url AS source,
 {around(fixed.INLINE_MARGIN)} AS context, raw AS raw_match, res_href AS url, res_href AS href,
 2 AS phase, block_idx AS source_idx, idx AS pattern_idx, pos
FROM ({resolve(f'''(SELECT * FROM (SELECT m.*, b.* EXCLUDE (scan_id), {trim(f"CASE WHEN idx = 0 THEN match ELSE {LAST_QUOTED} END")} AS raw
 FROM inline_m m JOIN based b USING (scan_id)) WHERE raw <> '' AND raw <> '/' AND NOT regexp_matches(raw, {rx(fixed.INLINE_SKIP)})
 AND NOT regexp_matches(raw, {rx(fixed.BARE_WORD)}))''', 'raw', 'base', 'res')})
WHERE res_host = base_host AND NOT {noise(bare('res_path'), "'inline'")}""")
cte("inline_e", ["inline_all"], firsts("inline_all", "scan_id, url"))

# Text patterns over pages and bodies
_method = "CASE " + " ".join(f"WHEN contains(near, '{w}') THEN '{w}'" for w in fixed.METHOD_WORDS) + " ELSE 'GET' END"
_xhr = [k for k, _ in fixed.TEXT_PATTERNS].index("xhr")


def text_endpoints(src: str, phase: int) -> str:
    """From matches joined with their page: the text detector of one page."""
    inner = f"""(SELECT *, {LAST_QUOTED} AS raw, {KIND_CASE} AS kind,
 upper({cut('text', f'pos - {fixed.METHOD_BEFORE}', f'pos + {fixed.METHOD_AFTER}')}) AS near,
 {cut('text', f'pos - {fixed.PARAM_BEFORE}', f'pos + {fixed.PARAM_AFTER}')} AS win,
 starts_with(raw, 'http') AS absolute,
 {bare("regexp_extract(raw, '^[^?]*')")} AS path0,
 substr(raw, length(regexp_extract(raw, '^[^?]*')) + 2) AS query0,
 CASE WHEN absolute THEN raw WHEN query0 <> '' THEN path0 || '?' || query0 ELSE path0 END AS ref,
 '/' AS root_path, '' AS root_search, base_scheme AS root_scheme, base_host AS root_host,
 regexp_replace(base_authority, '^.*@', '') AS root_authority FROM {src})"""
    return f"""SELECT scan_id, page_url, base_host AS host, scan_time, path, query, method, params, kind, source, context,
 raw AS raw_match, url, href, phase, source_idx, pattern_idx, pos FROM (
SELECT *, CASE WHEN absolute THEN {bare('res_path')} ELSE path0 END AS path,
 CASE WHEN absolute THEN res_search[2:] ELSE query0 END AS query,
 CASE WHEN idx = {_xhr} THEN regexp_extract(match, '[''"`]([A-Z]+)[''"`]', 1) ELSE {_method} END AS method,
 list_concat({query_names('query')}, {uniq(nearby_names('win'))}) AS both_names,
 {uniq('both_names')} AS params, {around(fixed.TEXT_MARGIN)} AS context,
 CASE WHEN absolute THEN raw ELSE coalesce(res_href, ref) END AS url, coalesce(res_href, ref) AS href,
 {phase} AS phase, idx AS pattern_idx
FROM ({resolve(inner, 'ref', 'root', 'res')})
WHERE (NOT absolute OR (res_href IS NOT NULL AND {same_site('res_host', 'base_host')}))) WHERE NOT {noise('path', 'kind')}"""


def capped(src: str) -> str:
    return f"""SELECT {ENDPOINT_COLS} FROM {src}
 QUALIFY row_number() OVER (PARTITION BY scan_id, source, method, url ORDER BY {ORD}) = 1"""


cte("pg_text", ["pg"], "SELECT scan_id, html AS text FROM pg")
cte("text_m", ["pg_text"], matches("pg_text", "scan_id", TEXT_RX))
cte("text_all", ["text_m", "based"], text_endpoints(
    "(SELECT m.*, b.* EXCLUDE (scan_id), page_url AS source, 0 AS source_idx FROM text_m m JOIN based b USING (scan_id))", 3))
cte("text_e", ["text_all"], capped("text_all"))

# Script discovery and bodies
_hrefs = f"(SELECT scan_id, pos, {attribute('start_tag', 'href')} AS ref FROM tok WHERE start_tag <> '')"
cte("src_ref", ["tok", "script", "based"], f"""SELECT r.way, r.nth, r.ref, b.* FROM (
 SELECT scan_id, 0 AS way, pos AS nth, {attribute('start_tag', 'src')} AS ref FROM tok WHERE tag = 'script'
 UNION ALL SELECT scan_id, 1, pos, ref FROM {_hrefs} WHERE regexp_matches(ref, {rx(fixed.SCRIPT_HREF)})
 UNION ALL SELECT scan_id, 2, generate_subscripts(l, 1), unnest(l) FROM (
   SELECT scan_id, regexp_extract_all(string_agg(text, chr(10) ORDER BY block_idx), {rx(fixed.CHUNK_PATTERN)}, 1) AS l
   FROM script GROUP BY scan_id)) r JOIN based b USING (scan_id) WHERE ref <> ''""")
cte("src", ["src_ref"], f"""SELECT scan_id, page_url, res_href AS url, row_number() OVER (PARTITION BY scan_id ORDER BY way, nth) AS source_idx FROM (
 SELECT * FROM ({resolve('src_ref', 'ref', 'base', 'res')}) WHERE {same_site('res_host', 'base_host')}
 QUALIFY row_number() OVER (PARTITION BY scan_id, res_href ORDER BY way, nth) = 1)""")
cte("src_body", ["src", "bodies"], f"""SELECT s.*, b.body AS text FROM src s JOIN bodies b USING (url)
 WHERE b.status BETWEEN 200 AND 299 AND (content_type = '' OR regexp_matches(content_type, {rx(fixed.TEXT_CONTENT_TYPE)})) AND body <> ''""")
cte("body_m", ["src_body"], matches("src_body", "scan_id, url, source_idx", TEXT_RX))
cte("body_all", ["body_m", "based"], text_endpoints(
    "(SELECT m.* EXCLUDE (url), m.url AS source, b.* EXCLUDE (scan_id) FROM body_m m JOIN based b USING (scan_id))", 4))
cte("body_e", ["body_all"], capped("body_all"))

# Network entries
cte("net", ["event_pages"], """SELECT event_id AS entry_id, pid AS scan_id, page_url, ts,
 CASE event_type WHEN 'click' THEN concat('/api/v1/click?id=', event_id % 13)
  WHEN 'view' THEN '/img/a.png' WHEN 'signup' THEN concat('https://api.', page_host, '/signup/')
  WHEN 'purchase' THEN 'https://tracker.invalid/p' ELSE '/rest/errors' END AS name,
 CASE event_type WHEN 'click' THEN 'fetch' WHEN 'view' THEN 'img' WHEN 'signup' THEN 'xmlhttprequest'
  WHEN 'purchase' THEN 'beacon' ELSE '' END AS initiator_type, user_id FROM event_pages""")
cte("net_e", ["net", "based"], f"""SELECT entry_id, user_id, scan_id, page_url, base_host AS host, ts, {bare('res_path')} AS path, res_search[2:] AS query,
 'GET' AS method, {query_names('res_search[2:]')} AS params, 'network-' || coalesce(nullif(initiator_type, ''), 'resource') AS kind,
 page_url AS source, 'Observed in network history via ' || coalesce(nullif(initiator_type, ''), 'resource') || ' timing entry' AS context,
 res_href AS raw_match, res_href AS url, res_href AS href, scan_time, 0 AS phase, 0 AS source_idx, 0 AS pattern_idx, entry_id AS pos
FROM ({resolve("(SELECT n.*, b.* EXCLUDE (scan_id, page_url) FROM net n JOIN based b USING (scan_id))", 'name', 'base', 'res')})
WHERE {same_site('res_host', 'base_host')} AND NOT {noise(bare('res_path'), "'network'")}""")

cte("found_e", ["net_e", "dom", "inline_e", "text_e", "body_e"],
    " UNION ALL ".join(f"SELECT {ENDPOINT_COLS} FROM {t}" for t in ("net_e", "dom", "inline_e", "text_e", "body_e")))
cte("scan_e", ["found_e"], firsts("found_e", "scan_id, method, url"))
cte("logged_e", ["found_e"], firsts("found_e", "scan_id, method, url, source"))

# Secrets
_entropy = (
    "-list_sum(list_transform(list_distinct(string_split(value, '')), lambda ch: "
    "((length(value) - length(replace(value, ch, ''))) / length(value)) * log2((length(value) - length(replace(value, ch, ''))) / length(value))))"
)


def rule_rx(rule) -> str:
    return ("(?im)" if rule.regex.startswith("(?i)") else "(?m)") + re2(rule.regex.removeprefix("(?i)"), lines=True)


def secrets(src: str, key: str) -> dict[str, str]:
    """CTE texts for the secrets of texts ``src(key..., text)``."""
    rules = []
    for n, r in enumerate(DEFAULT_RULES):
        p = lit(rule_rx(r))
        group = f"regexp_extract_all(text, {p}, 1)" if has_group(r.regex.removeprefix("(?i)")) else f"regexp_extract_all(text, {p})"
        rules.append(
            f"SELECT {key}, text, {n} AS pattern_idx, {lit(r.id)} AS id, {lit(r.name)} AS name, {lit(r.severity)} AS severity, "
            f"unnest(regexp_extract_all(text, {p})) AS match, unnest({group}) AS grp, unnest(string_split_regex(text, {p})) AS gap, "
            f"generate_subscripts(string_split_regex(text, {p}), 1) AS i FROM {src}"
        )
    located = f"SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY {key}, pattern_idx ORDER BY i) - length(match) AS BIGINT) AS pos FROM"
    quoted = lit(re2(fixed.QUOTED_TOKEN))
    context = around(fixed.SECRET_MARGIN)
    rule_hits = f"""SELECT * FROM (SELECT {key}, id, name, severity, {trim("coalesce(nullif(grp, ''), match)")} AS value, {context} AS context, pattern_idx, pos, i
 FROM ({located} ({chr(10).join(['', ' UNION ALL '.join(rules)])}) WHERE match IS NOT NULL))
 WHERE NOT {secret_noise('value')}"""
    entropy_hits = f"""SELECT * FROM (SELECT {key}, {lit(fixed.ENTROPY_ID)} AS id, {lit(fixed.ENTROPY_NAME)} AS name, {lit(fixed.ENTROPY_SEVERITY)} AS severity,
 match[2:-2] AS value, {context} AS context, 1000 AS pattern_idx, pos, i
 FROM ({located} (SELECT {key}, text, 1000 AS pattern_idx, unnest(regexp_extract_all(text, {quoted})) AS match,
  unnest(string_split_regex(text, {quoted})) AS gap, generate_subscripts(string_split_regex(text, {quoted}), 1) AS i FROM {src}) WHERE match IS NOT NULL)) e
 WHERE NOT {secret_noise('value')} AND NOT starts_with(value, '/')
 AND CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+\\z') THEN length(value) >= {fixed.HEX_LENGTH} AND {_entropy} >= {fixed.HEX_ENTROPY}
  ELSE regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
   AND NOT (len(regexp_extract_all(value, '[a-z][A-Z]')) >= 3 AND length(regexp_replace(value, '[^0-9]', '', 'g')) < 3)
   AND {_entropy} >= {fixed.MIXED_ENTROPY} END"""
    return {"rule": rule_hits, "entropy": entropy_hits}


def secret_ctes(prefix: str, src: str, key: str, needs: list[str]) -> None:
    parts = secrets(src, key)
    on = " AND ".join(f"r.{k.strip()} = e.{k.strip()}" for k in key.split(","))
    cte(f"{prefix}_rule", needs, parts["rule"])
    cte(f"{prefix}_ent_raw", needs, parts["entropy"])
    cte(f"{prefix}_ent", [f"{prefix}_ent_raw", f"{prefix}_rule"], f"""SELECT * FROM {prefix}_ent_raw e
 WHERE NOT EXISTS (SELECT 1 FROM {prefix}_rule r WHERE {on} AND r.value = e.value)""")
    cte(f"{prefix}_sec", [f"{prefix}_rule", f"{prefix}_ent"], f"""SELECT * FROM (SELECT * FROM {prefix}_rule UNION ALL SELECT * FROM {prefix}_ent)
 QUALIFY row_number() OVER (PARTITION BY {key}, id, value ORDER BY pattern_idx, pos) = 1""")


cte("docs", [], "SELECT doc_id, source, text FROM documents")
cte("any_text", ["docs", "pg"], """SELECT 'document' AS kind, doc_id AS text_id, text FROM docs
 UNION ALL SELECT 'page', scan_id, html FROM pg""")
secret_ctes("any", "any_text", "kind, text_id", ["any_text"])
secret_ctes("page", "pg_text", "scan_id", ["pg_text"])
secret_ctes("script_b", "src_body", "scan_id, url, source_idx", ["src_body"])
cte("found_s", ["page_sec", "script_b_sec", "based"], """SELECT scan_id, page_url, base_host AS host, id, name, severity, value, context,
 page_url AS source, scan_time, 3 AS phase, 0 AS source_idx, pattern_idx, pos FROM page_sec JOIN based USING (scan_id)
 UNION ALL SELECT scan_id, page_url, base_host, id, name, severity, value, context, url, scan_time, 4, source_idx, pattern_idx, pos
 FROM script_b_sec JOIN based USING (scan_id)""")
cte("scan_s", ["found_s"], f"SELECT * FROM found_s QUALIFY row_number() OVER (PARTITION BY scan_id, id, value, source ORDER BY {ORD}) = 1")


# Host log
SEEN = "scan_time, scan_id, phase, source_idx, pattern_idx, pos"


def first_list(src: str, key: str, values: str, out: str) -> str:
    return f"""SELECT host, key, list(v ORDER BY n) AS {out} FROM (SELECT host, key, v, row_number() OVER (PARTITION BY host, key ORDER BY {SEEN}, nth, v) AS n
 FROM (SELECT * FROM (SELECT {key}, {SEEN}, {trim('unnest(vs)')} AS v, generate_subscripts(vs, 1) AS nth FROM (SELECT *, {values} AS vs FROM {src}))
  WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY host, key, v ORDER BY {SEEN}, nth) = 1))
 GROUP BY host, key"""


def host_log(name: str, found_s: str, found_e: str) -> None:
    """CTEs {name}_s and {name}_e: the host log of the findings of two CTEs."""
    lists_s = {"ids": "[id]", "names": "[name]", "sources": "[source]", "page_urls": "[page_url]"}
    cte(f"{name}_s0", [found_s], f"SELECT *, {trim('value')} AS key FROM {found_s}")
    for col, e in lists_s.items():
        cte(f"{name}_s_{col}", [f"{name}_s0"], first_list(f"{name}_s0", "host, key", e, col))
    joins = " ".join(f"LEFT JOIN {name}_s_{c} USING (host, key)" for c in lists_s)
    cte(f"{name}_s", [f"{name}_s_{c}" for c in lists_s], f"""SELECT m.*, {', '.join(f'coalesce({c}, []) AS {c}' for c in lists_s)}
 FROM (SELECT host, key, key AS value, last(name ORDER BY {SEEN}) AS name,
  first(severity ORDER BY {severity_rank('severity', 99)}, severity) AS severity,
  coalesce(first(context ORDER BY {SEEN}) FILTER (WHERE context <> ''), '') AS context,
  min(scan_time) AS first_seen, max(scan_time) AS last_seen, count(*) AS occurrences FROM {name}_s0 GROUP BY host, key) m {joins}""")
    lists_e = {"query_samples": "[query]", "params": "params", "kinds": "[kind]", "sources": "[source]", "page_urls": "[page_url]"}
    cte(f"{name}_e0", [found_e], f"SELECT * EXCLUDE (url), regexp_replace(href, '(?s)#.*\\z', '') AS url, method || ':' || regexp_replace(href, '(?s)#.*\\z', '') AS key FROM {found_e}")
    for col, e in lists_e.items():
        cte(f"{name}_e_{col}", [f"{name}_e0"], first_list(f"{name}_e0", "host, key", e, col))
    joins = " ".join(f"LEFT JOIN {name}_e_{c} USING (host, key)" for c in lists_e)
    cte(f"{name}_e", [f"{name}_e_{c}" for c in lists_e], f"""SELECT m.*, {', '.join(f'coalesce({c}, []) AS {c}' for c in lists_e)}
 FROM (SELECT host, key, any_value(method) AS method, any_value(url) AS url, last(path ORDER BY {SEEN}) AS path,
  lower(regexp_extract(any_value(url), '^[a-z]+://([^/:?#]*)', 1)) AS url_host,
  coalesce(first(context ORDER BY {SEEN}) FILTER (WHERE context <> ''), '') AS context,
  min(scan_time) AS first_seen, max(scan_time) AS last_seen, count(*) AS occurrences FROM {name}_e0 GROUP BY host, key) m {joins}""")


host_log("log", "scan_s", "logged_e")
cte("even_s", ["scan_s"], "SELECT * FROM scan_s")
cte("even_e", ["logged_e"], "SELECT * FROM logged_e")
host_log("half", "even_s", "even_e")


def stats(s: str, e: str) -> str:
    return f"""SELECT h.host, coalesce(ns, 0) AS unique_secrets, coalesce(ne, 0) AS unique_endpoints, coalesce(np, 0) AS page_count, updated_at
FROM (SELECT host, max(last_seen) AS updated_at FROM (SELECT host, last_seen FROM {s} UNION ALL SELECT host, last_seen FROM {e}) GROUP BY host) h
LEFT JOIN (SELECT host, count(*) AS ns FROM {s} GROUP BY host) USING (host)
LEFT JOIN (SELECT host, count(*) AS ne FROM {e} GROUP BY host) USING (host)
LEFT JOIN (SELECT host, count(DISTINCT p) AS np FROM (SELECT host, unnest(page_urls) AS p FROM {s} UNION ALL SELECT host, unnest(page_urls) FROM {e}) GROUP BY host) USING (host)"""


cte("stats", ["log_s", "log_e"], stats("log_s", "log_e"))

# Merged view: log of all scans, live findings of each host's newest scan
cte("newest", ["based"], "SELECT base_host AS host, arg_max(scan_id, (scan_time, scan_id)) AS scan_id FROM based GROUP BY base_host")
cte("live_e", ["scan_e", "newest"], "SELECT * FROM scan_e SEMI JOIN newest USING (host, scan_id)")
cte("live_s", ["scan_s", "newest"], "SELECT * FROM scan_s SEMI JOIN newest USING (host, scan_id)")


BLANK = "coalesce(v, '')"


def merge_list(*lists: str) -> str:
    flat = f"list_filter(list_transform(list_concat({', '.join(f'coalesce({e}, [])' for e in lists)}), lambda v: {trim(BLANK)}), lambda v: v <> '')"
    return uniq(flat)


def last_given(c: str) -> str:
    return f"last({c} ORDER BY {ORD}) FILTER (WHERE {c} <> '')"


cte("merged_s", ["half_s", "live_s"], f"""SELECT coalesce(b.host, i.host) AS host, coalesce(b.value, i.value) AS value,
 coalesce(i.id, b.ids[1], 'host-log') AS id, coalesce(i.name, b.name) AS name,
 coalesce(nullif(i.context, ''), b.context, '') AS context, coalesce(i.source, b.sources[1], b.page_urls[1]) AS source,
 CASE WHEN b.severity IS NULL OR {severity_rank('i.severity', 99)} < {severity_rank('b.severity', 99)} THEN i.severity ELSE b.severity END AS severity,
 greatest(b.last_seen, i.scan_time) AS timestamp, greatest(b.occurrences, CASE WHEN i.value IS NOT NULL THEN 1 END) AS occurrences,
 {merge_list('b.sources', 'b.page_urls', 'i.sources')} AS sources, {merge_list('b.page_urls', 'i.page_urls')} AS page_urls,
 {merge_list('[b.context]', 'i.contexts')} AS contexts, {merge_list('[b.name]', 'b.names', 'i.names')} AS names
FROM half_s b FULL OUTER JOIN (SELECT host, value, {last_given('id')} AS id, {last_given('name')} AS name, {last_given('context')} AS context,
 {last_given('source')} AS source, first(severity ORDER BY {severity_rank('severity', 99)}, severity) AS severity, max(scan_time) AS scan_time,
 list(source ORDER BY {ORD}) AS sources, list(page_url ORDER BY {ORD}) AS page_urls, list(context ORDER BY {ORD}) AS contexts,
 list(name ORDER BY {ORD}) AS names FROM live_s GROUP BY host, value) i ON b.host = i.host AND b.value = i.value""")
cte("merged_e", ["half_e", "live_e"], f"""SELECT coalesce(b.host, i.host) AS host, coalesce(b.key, i.key) AS key,
 coalesce(i.method, b.method) AS method, coalesce(i.path, b.path) AS path, coalesce(i.url, b.url) AS url,
 coalesce(nullif(i.query, ''), b.query_samples[1], '') AS query, coalesce(i.kind, b.kinds[1]) AS kind, coalesce(i.source, b.sources[1]) AS source,
 coalesce(nullif(i.context, ''), b.context, '') AS context, coalesce(i.raw_match, b.url) AS raw_match,
 greatest(b.last_seen, i.scan_time) AS timestamp, greatest(b.occurrences, CASE WHEN i.key IS NOT NULL THEN 1 END) AS occurrences,
 CASE WHEN i.key IS NULL THEN b.params ELSE {merge_list('b.params', 'i.params')} END AS params,
 {merge_list('b.sources', 'b.page_urls', '[i.source]')} AS sources, {merge_list('b.page_urls', '[i.page_url]')} AS page_urls,
 {merge_list('b.query_samples', '[i.query]')} AS query_samples, {merge_list('b.kinds', '[i.kind]')} AS kinds
FROM half_e b FULL OUTER JOIN (SELECT *, method || ':' || url AS key FROM live_e) i ON b.host = i.host AND b.key = i.key""")

_host_of = lambda u: f"lower(regexp_extract({u}, '^(?i:https?|wss?|ftp)://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
_display = f"CASE WHEN {_host_of('url')} = host THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) ELSE url END"
AS_OF = "TIMESTAMP '2024-01-01 01:30:00'"
_age = f"(epoch_ms({AS_OF}) // 1000 - epoch_ms(timestamp) // 1000)"
_seen = (f"CASE WHEN {_age} < 5 THEN 'just now' WHEN {_age} < 60 THEN {_age} || 's ago' "
         f"WHEN {_age} < 3600 THEN ({_age} // 60) || 'm ago' ELSE ({_age} // 3600) || 'h ago' END")


def marks(m: str) -> str:
    return f"strpos(context, {m}) AS mark_at, CASE WHEN strpos(context, {m}) > 0 THEN length({m}) ELSE 0 END AS mark_length"


# Captures
cte("cap_raw", ["event_pages"], """SELECT event_id AS source_pos, page_url AS original,
 regexp_replace(regexp_replace(page_url, '^https?://', ''), '#.*$', '') AS urlkey,
 CASE event_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/css' ELSE '' END AS mimetype,
 strftime(ts, '%Y%m%d%H%M%S') AS timestamp,
 CASE WHEN event_id % 10 = 0 THEN '404' WHEN event_id % 17 = 0 THEN '503' ELSE '200' END AS statuscode,
 cast(event_id % 3 as string) AS digest FROM event_pages""")
cte("cap", ["cap_raw"], f"""SELECT *, regexp_extract(original, '^[a-z]+://([^/?#]+)', 1) AS host FROM (
 SELECT urlkey, first(original ORDER BY timestamp, source_pos) AS original, first(mimetype ORDER BY timestamp, source_pos) AS mimetype,
 min(timestamp) AS timestamp, max(timestamp) AS endtimestamp, count(*) AS groupcount, count(DISTINCT digest) AS uniqcount
 FROM cap_raw WHERE NOT regexp_matches(statuscode, '^[45]..\\z') GROUP BY urlkey)""")

# Navigation
cte("nav", ["event_pages"], "SELECT user_id AS tab_id, event_id AS nav_id, ts, page_url AS url, event_type FROM event_pages")
cte("sess", ["nav"], """SELECT tab_id, min(ts) AS started_at, max(ts) AS fired_for, last(nav_id ORDER BY ts, nav_id) AS nav_id,
 last(url ORDER BY ts, nav_id) AS url, count(*) AS events
FROM (SELECT *, sum(opens) OVER (PARTITION BY tab_id ORDER BY ts, nav_id) AS island FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tab_id ORDER BY ts, nav_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM nav))
GROUP BY tab_id, island""")
cte("latest", ["nav"], """SELECT tab_id, nav_id AS scan_id, ts AS started_at, url AS page_url FROM (
 SELECT * FROM nav QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, nav_id DESC) = 1) WHERE event_type <> 'error'""")

_E = (
    "scan_id, page_url, host, path, query, method, array_to_string(params, '|') AS params, kind, source, context, raw_match, url, "
    "phase, source_idx, pattern_idx, CAST(pos AS BIGINT) AS pos"
)


def pages(src: str, lists: list[str], size: int = 5) -> str:
    """The rows of ``src`` once for every ``size`` values of their longest list."""
    count = f"greatest(1, ({' + '.join(['greatest(' + ', '.join(f'len({c})' for c in lists) + ')', str(size - 1)])}) // {size})"
    cut = ", ".join(f"{c}[page * {size} + 1:page * {size} + {size}] AS {c}" for c in lists)
    return f"(SELECT * REPLACE ({cut}) FROM (SELECT *, unnest(range({count})) AS page FROM {src}))"


LOG_LISTS = {
    "s": ["ids", "names", "sources", "page_urls"], "e": ["query_samples", "params", "kinds", "sources", "page_urls"],
}
MERGED_LISTS = {
    "s": ["sources", "page_urls", "contexts", "names"], "e": ["params", "sources", "page_urls", "query_samples", "kinds"],
}
_counted = lambda src: f"(SELECT *, len(sources) AS source_count, len(page_urls) AS page_count FROM {src})"
_lists = lambda *names: ", ".join(f"array_to_string({n}, '|') AS {n}" for n in names)

ORACLES = {
    "inline_scripts": (["script", "pg"], "SELECT scan_id, page_url, block_idx, text FROM script JOIN pg USING (scan_id)"),
    "script_sources": (["src"], "SELECT scan_id, page_url, url, source_idx FROM src"),
    "script_bodies": (["src_body"], "SELECT scan_id, page_url, url, source_idx, text AS body FROM src_body"),
    "dom_endpoints": (["dom"], f"SELECT {_E} FROM dom"),
    "inline_endpoints": (["inline_e"], f"SELECT {_E} FROM inline_e"),
    "text_endpoints": (["text_e", "body_e"], f"SELECT {_E} FROM text_e UNION ALL SELECT {_E} FROM body_e"),
    "network_endpoints": (["net_e"], "SELECT entry_id, scan_id, page_url, host, path, query, method, array_to_string(params, '|') AS params, kind, source, context, raw_match, url FROM net_e"),
    "rule_secrets": (["any_sec"], "SELECT kind, text_id, id, name, severity, value, context, pattern_idx, CAST(pos AS BIGINT) AS pos FROM any_sec WHERE id <> 'high-entropy'"),
    "entropy_secrets": (["any_sec"], "SELECT kind, text_id, id, name, severity, value, context, CAST(pos AS BIGINT) AS pos FROM any_sec WHERE id = 'high-entropy'"),
    "page_findings": (["page_sec", "text_e", "based"], """SELECT scan_id, page_url AS source, 'secret' AS finding, id AS kind, value, severity, context, pattern_idx, CAST(pos AS BIGINT) AS pos FROM page_sec JOIN based USING (scan_id)
UNION ALL SELECT scan_id, source, 'endpoint', kind, url, '', context, pattern_idx, pos FROM text_e"""),
    "scan_endpoints": (["scan_e"], f"SELECT {_E} FROM scan_e"),
    "scan_secrets": (["scan_s"], "SELECT scan_id, page_url, host, id, name, severity, value, context, source, phase, source_idx, pattern_idx, CAST(pos AS BIGINT) AS pos FROM scan_s"),
    "host_secrets": (["log_s"], f"SELECT host, key, page, value, name, severity, {_lists('ids', 'names', 'sources', 'page_urls')}, context, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, occurrences FROM {pages('log_s', LOG_LISTS['s'])}"),
    "host_endpoints": (["log_e"], f"SELECT host, key, page, method, url, path, url_host, {_lists('query_samples', 'params', 'kinds', 'sources', 'page_urls')}, context, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, occurrences FROM {pages('log_e', LOG_LISTS['e'])}"),
    "host_stats": (["stats"], f"SELECT host, unique_secrets, unique_endpoints, page_count, {ts('updated_at')} AS updated_at FROM stats"),
    "host_report": (["stats"], f"""SELECT host, unique_secrets, unique_endpoints, page_count, {ts('updated_at')} AS updated_at,
 CASE WHEN unique_secrets > 99 THEN '99+' WHEN unique_secrets > 0 THEN unique_secrets::VARCHAR ELSE '' END AS badge,
 'https://securitytrails.com/domain/' || host || '/dns' AS dns_link, 'https://securitytrails.com/domain/' || host || '/history/a' AS history_link,
 'https://securitytrails.com/list/apex_domain/' || array_to_string(string_split(host, '.')[-2:], '.') AS subdomains_link,
 'https://web-check.xyz/check/' || host AS webcheck_link FROM stats"""),
    "finding_counts": (["merged_s", "merged_e"], """SELECT coalesce(e.host, s.host) AS host, coalesce(e.n, 0) AS endpoints, coalesce(s.n, 0) AS secrets
FROM (SELECT host, count(*) AS n FROM merged_e GROUP BY host) e FULL OUTER JOIN (SELECT host, count(*) AS n FROM merged_s GROUP BY host) s ON e.host = s.host"""),
    "merged_secrets": (["merged_s"], f"SELECT host, value, page, id, name, context, source, severity, {ts('timestamp')} AS timestamp, occurrences, source_count, page_count, {_lists(*MERGED_LISTS['s'])} FROM {pages(_counted('merged_s'), MERGED_LISTS['s'])}"),
    "merged_endpoints": (["merged_e"], f"SELECT host, key, page, method, path, url, query, kind, source, context, raw_match, {ts('timestamp')} AS timestamp, occurrences, source_count, page_count, {_lists(*MERGED_LISTS['e'])} FROM {pages(_counted('merged_e'), MERGED_LISTS['e'])}"),
    "review_endpoints": (["merged_e"], f"""SELECT host, key, method, {_display} AS display_url, query, kind, source, {ts('timestamp')} AS timestamp, occurrences,
 len(sources) AS source_count, len(page_urls) AS page_count, {_seen} AS seen, {marks('raw_match')},
 row_number() OVER (ORDER BY timestamp DESC, host, key) AS rank FROM merged_e
 WHERE method = 'GET' AND contains(lower({_display}), '/api/')"""),
    "review_secrets": (["merged_s"], f"""SELECT host, value, CASE WHEN length(value) > 90 THEN value[1:90] || '...' ELSE value END AS preview, name, severity,
 source, CASE WHEN length(source) > 200 THEN source[1:200] || '...' ELSE source END AS shown_source, {ts('timestamp')} AS timestamp, occurrences,
 len(sources) AS source_count, len(page_urls) AS page_count, {_seen} AS seen, {marks('value')},
 row_number() OVER (ORDER BY {severity_rank('severity', 9)}, timestamp DESC, host, value) AS rank FROM merged_s
 WHERE severity = 'medium' AND contains(lower(source), 'example.com')"""),
    "export_lines": (["merged_s", "merged_e"], "SELECT host, url AS line FROM merged_e UNION ALL SELECT host, value FROM merged_s"),
    "export_json": (["live_s", "live_e", "log_s", "log_e", "merged_s", "merged_e"], "SELECT host, host AS hostname, part, kind, name, " + ts("seen") + " AS seen, page, " + ts(AS_OF) + " AS exported_at FROM (" + " UNION ALL ".join(
        f"SELECT host, '{part}' AS part, '{kind}' AS kind, {name} AS name, {seen} AS seen, {page} AS page FROM {t}"
        for kind, name, suffix in (("secrets", "value", "s"), ("endpoints", "method || ':' || url", "e"))
        for part, t, seen, page in (
            ("currentScan", f"live_{suffix}", "scan_time", "0"),
            ("hostLog", pages(f"log_{suffix}", LOG_LISTS[suffix]), "last_seen", "page"),
            ("mergedFindings", pages(f"merged_{suffix}", MERGED_LISTS[suffix]), "timestamp", "page"),
        )
    ) + ")"),
    "capture_collapse": (["cap"], "SELECT host, urlkey, original, mimetype, timestamp, endtimestamp, groupcount, uniqcount FROM cap"),
    "capture_view": (["cap"], """SELECT host, urlkey, original, mimetype, timestamp[1:4] || '-' || timestamp[5:6] || '-' || timestamp[7:8] AS first_day,
 endtimestamp[1:4] || '-' || endtimestamp[5:6] || '-' || endtimestamp[7:8] AS last_day, groupcount FROM cap
 WHERE mimetype = 'text/html' AND (contains(lower(original), '/en') OR contains(lower(mimetype), '/en'))"""),
    "capture_count": (["cap"], """SELECT host, count(*) FILTER (WHERE mimetype = 'text/html' AND (contains(lower(original), '/en') OR contains(lower(mimetype), '/en'))) AS visible,
 count(*) AS total FROM cap GROUP BY host"""),
    "capture_orders": (["cap"], " UNION ALL ".join(
        f"SELECT '{name}' AS sort, row_number() OVER (ORDER BY {column} {way}, urlkey) AS rank, host, urlkey FROM cap WHERE mimetype = 'text/html'"
        for name, (column, way) in SORTS.items())),
    "capture_index": (["cap"], "SELECT original, mimetype, timestamp, endtimestamp, groupcount, uniqcount FROM cap"),
    "capture_mimes": (["cap"], "SELECT DISTINCT mimetype FROM cap WHERE mimetype <> ''"),
    "capture_urls": (["cap"], "SELECT host, urlkey, original FROM cap WHERE contains(lower(original), 'example.org') OR contains(lower(mimetype), 'example.org')"),
    "nav_sessions": (["sess"], f"SELECT tab_id, {ts('started_at')} AS started_at, {ts('fired_for')} AS fired_for, nav_id, url, events FROM sess"),
    "rescan_triggers": (["sess"], f"""SELECT tab_id, {ts('started_at')} AS started_at, {ts('fired_for')} AS fired_for, nav_id, url, previous_url FROM (
 SELECT *, lag(url) OVER (PARTITION BY tab_id ORDER BY started_at) AS previous_url FROM sess) WHERE url IS DISTINCT FROM previous_url"""),
    "latest_scan": (["latest"], f"SELECT tab_id, scan_id, {ts('started_at')} AS started_at, page_url FROM latest"),
    "fresh_findings": (["net_e", "latest"], """SELECT n.user_id AS tab_id, n.entry_id AS scan_id, n.page_url, n.kind, n.method, n.url FROM net_e n
 WHERE EXISTS (SELECT 1 FROM latest l WHERE l.tab_id = n.user_id AND l.scan_id = n.entry_id)"""),
    "retention_prune": (["stats"], f"""SELECT host, {ts('updated_at')} AS updated_at FROM (SELECT *, row_number() OVER (ORDER BY updated_at NULLS FIRST, host) AS n,
 count(*) OVER () AS total FROM stats WHERE host <> (SELECT min(host) FROM stats)) WHERE n <= greatest(1, total // 2)"""),
    "stream_scan": (["logged_e"], f"SELECT {_E} FROM logged_e"),
    "stream_network": (["net_e"], f"""SELECT page_url, method, url, {ts('ts')} AS ts, entry_id FROM (SELECT page_url, method, url,
 unnest(min(struct_pack(ts := ts, entry_id := entry_id))) FROM net_e GROUP BY page_url, method, url)"""),
    "stream_tabs": (["net_e", "latest"], """SELECT n.user_id AS tab_id, n.entry_id AS scan_id, n.page_url, n.kind, n.method, n.url FROM net_e n
 WHERE EXISTS (SELECT 1 FROM latest l WHERE l.tab_id = n.user_id AND l.scan_id = n.entry_id)"""),
    "stream_sessions": (["sess"], f"SELECT tab_id, {ts('started_at')} AS started_at, {ts('fired_for')} AS fired_for, nav_id, url, events FROM sess"),
    "stream_host_log": (["stats"], f"SELECT host, unique_secrets, unique_endpoints, page_count, {ts('updated_at')} AS updated_at FROM stats"),
}


ORACLES["host_log_merge"] = ORACLES["host_secrets"]


def oracle_sql() -> dict[str, str]:
    return {name: query(needs, body) for name, (needs, body) in ORACLES.items()}
