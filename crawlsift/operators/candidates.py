"""One pass over page markup or script text that yields every raw match.

Wide text is read once. Rows leave this step with the match and a short window around
it, so nothing after it ever shuffles markup or script bodies.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import fixed, markup
from crawlsift.functions.regex import guarded, has_group, jvm, quoted, required_literals, rule_form
from crawlsift.functions.text import candidates, chunks, hits
from crawlsift.sources.rules import Rule

CHUNK_IDX = 50
ENTROPY_IDX = 100
RULE_IDX = 1000

# --- fixed values: elements that carry a URL, in the order they are read ------
DOM_GROUPS = [
    (["a"], "href"),
    (["form"], "action"),
    (["iframe"], "src"),
    (["script"], "src"),
    (["link"], "href"),
    (["img"], "src"),
    (["source", "video", "audio"], "src"),
]

_UNIT = "struct<unit:string,unit_idx:int,text:string>"


def text_patterns(endpoints: bool, rules: list[Rule] | None):
    """(idx, regex, read first group, cheap test) for everything but rules run over a text."""
    out = []
    if rules is not None:
        out.append((ENTROPY_IDX, jvm(guarded(fixed.QUOTED_TOKEN)), False, ""))
    if endpoints:
        for i, (_, regex) in enumerate(fixed.TEXT_PATTERNS):
            out.append((i, jvm(guarded(regex)), False, _test(regex)))
    return out


#: Length of the pieces of required literals by which rules are found for a text.
GRAM = 3
_RULE = "struct<idx: int, regex: string, grp: int, literals: array<string>>"


def rule_index(rules: list[Rule]) -> tuple[list[dict], dict[str, list[int]], list[int]]:
    """(rules, rules by piece, rules for every text).

    Of every literal of which a rule's match must hold one, one piece stands for the rule: the
    one that the fewest rules have. A rule with a short literal, or none, is tried on every text.
    """
    table, pieces = [], []
    for i, rule in enumerate(rules):
        literals = sorted({x.lower() for x in required_literals(rule.regex.removeprefix("(?i)"))})
        table.append({"idx": i, "regex": rule_form(guarded(rule.regex)), "grp": int(has_group(rule.regex)), "literals": literals})
        pieces.append([[x[j : j + GRAM] for j in range(len(x) - GRAM + 1)] for x in literals])
    common = Counter(g for of_rule in pieces for g in {g for of_literal in of_rule for g in of_literal})
    by_piece: dict[str, list[int]] = {}
    always = []
    for i, of_rule in enumerate(pieces):
        if not of_rule or not all(of_rule):
            always.append(i)
            continue
        for g in {min(of_literal, key=lambda g: (common[g], g)) for of_literal in of_rule}:
            by_piece.setdefault(g, []).append(i)
    return table, by_piece, always


def possible_rules(text: Column, lowered: Column, rules: list[Rule]) -> Column:
    """The rules that can match ``text``, in table order, as an array of structs.

    The table goes into the plan as one string, however long it is. The pieces of a text are
    looked up among those of the rules; what is left is tested for its literals. Pieces with a
    character that no piece of a rule has in its place are left out at once.
    """
    table, by_piece, always = rule_index(rules)
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    lookup = constant(by_piece, "map<string, array<int>>")
    places = "".join(f"[{''.join(sorted({rf'\x{{{ord(g[i]):x}}}' for g in by_piece}))}]" for i in range(GRAM) if by_piece)
    pieces = F.regexp_extract_all(lowered, F.lit(rf"(?=({places}))"), F.lit(1)) if by_piece else F.array().cast("array<string>")
    found = F.array_intersect(constant(sorted(by_piece), "array<string>"), pieces)
    some = F.flatten(F.transform(found, lambda g: F.element_at(lookup, g)))
    picked = F.sort_array(F.array_distinct(F.concat(constant(always, "array<int>"), some)))
    structs = F.transform(picked, lambda i: F.get(constant(table, f"array<{_RULE}>"), i))
    holds = lambda r: (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda x: F.contains(lowered, x))
    return F.filter(structs, holds)


def _rule_hits() -> str:
    """SQL for the hits of the rules in ``__rules`` over ``text``."""
    cut = "" if fixed.RULE_MATCHES is None else f"slice(regexp_extract_all(text, r.regex, 0), 1, {fixed.RULE_MATCHES})"
    found = cut or "regexp_extract_all(text, r.regex, 0)"
    hit = (
        f"named_struct('idx', {RULE_IDX} + r.idx, 'm', m, 'gaps', split(text, r.regex), "
        f"'groups', CASE WHEN r.grp = 1 THEN regexp_extract_all(text, r.regex, 1) ELSE m END)"
    )
    each = f"transform(array({found}), m -> CASE WHEN size(m) > 0 THEN {hit} END)[0]"
    return f"filter(transform(__rules, r -> {each}), h -> h IS NOT NULL)"


def _test(regex: str) -> str:
    """SQL that is true for every text the pattern can match, by plain search only."""
    column, literals = "text", required_literals(regex.removeprefix("(?i)"))
    if regex.startswith("(?i)"):
        column, literals = "__lower", {x.lower() for x in literals}
    plain = (x.replace("\\", "\\\\").replace("'", "\\'") for x in sorted(literals))
    return " OR ".join(f"contains({column}, '{x}')" for x in plain)


def _inline_patterns(endpoints: bool, sources: bool):
    out = []
    if endpoints:
        out += [(i, jvm(guarded(p)), False, _test(p)) for i, p in enumerate(fixed.INLINE_PATTERNS)]
    if sources:
        # Names of script files hold no blank, so none goes over the end of a block.
        out.append((CHUNK_IDX, jvm(fixed.CHUNK_PATTERN), True, _test(fixed.CHUNK_PATTERN)))
    return out


def _matches(pattern) -> str:
    _, regex, _, test = pattern
    found = f"regexp_extract_all(text, {quoted(regex)}, 0)"
    if test:
        # A plain search is far cheaper than the regular expression it stands before.
        found = f"CASE WHEN {test} THEN {found} ELSE array() END"
    return found


_DOM_NAMES = "|".join(name for group, _ in DOM_GROUPS for name in group)
_DOM_TOKEN = rf"rlike(z.m, r'(?i)^<(?:{_DOM_NAMES})[\t\n\f\r />]')"
# A script element is kept only for its source; its body is scanned as an inline script.
_SOURCED = f"NOT rlike(z.m, r'(?i)^<script') OR contains(lower(regexp_extract(z.m, {quoted(markup.START_TAG)}, 0)), 'src')"
_LINKED = f"contains(lower(z.m), 'href') AND contains(lower(regexp_extract(z.m, {quoted(markup.START_TAG)}, 0)), 'href')"
# Elements whose markup goes on after the start tag, to their end tag.
_OPEN_TOKEN = rf"rlike(z.m, r'(?i)^<(?:{'|'.join(markup.OPEN)})[\t\n\f\r />]')"
_CLOSING = " ".join(
    rf"WHEN rlike(z.m, r'(?i)^<{name}[\t\n\f\r />]') THEN regexp_extract(near, {quoted(markup.closing(name))}, 0)" for name in markup.OPEN
)


def page_candidates(
    pages: DataFrame,
    dom: bool = True,
    inline: bool = True,
    endpoints: bool = True,
    rules: list[Rule] | None = None,
    sources: bool = False,
) -> DataFrame:
    """Every raw match in ``pages(html, ...)``; keeps the other columns of ``pages``.

    Adds ``unit`` (dom, inline or text), ``unit_idx``, ``idx``, ``pos``, ``match``,
    ``value``, ``before`` and ``after``. With ``sources`` the elements and quoted names that
    script URLs come from are there, too.
    """
    keys = [c for c in pages.columns if c != "html"]
    units, df = [], pages
    none = F.array().cast(f"array<{_UNIT}>")
    elements, blocks = dom or sources, inline or sources
    if elements or blocks:
        df = df.withColumn("__tok", markup.tokens(F.col("html")))
    if elements:
        units.append(F.array(_unit("dom", F.lit(0), F.col("html"))))
    if blocks:
        df = df.withColumn("__scripts", markup.script_bodies(F.col("__tok")))
        units.append(F.transform(F.col("__scripts"), lambda s, i: _unit("inline", i, s)))
    if endpoints or rules is not None:
        units.append(F.array(_unit("text", F.lit(0), F.col("html"))))
    tok = F.col("__tok") if elements else F.array().cast("array<string>")
    rows = df.select(*keys, tok.alias("__tok"), F.explode(F.concat(none, *units)).alias("u"))
    rows = rows.select(
        *keys,
        "u.*",
        F.when(F.col("u.unit") == "dom", F.col("__tok")).alias("__tok"),
    )
    return _scan_units(rows, keys + ["unit", "unit_idx"], dom, inline, endpoints, rules, sources)


def text_candidates(
    texts: DataFrame, endpoints: bool = True, rules: list[Rule] | None = None
) -> DataFrame:
    """Every raw match in ``texts(text, ...)``, one plain text per row."""
    keys = [c for c in texts.columns if c != "text"]
    rows = texts.withColumns({"unit": F.lit("text"), "unit_idx": F.lit(0)})
    return _scan_units(rows, keys + ["unit", "unit_idx"], False, False, endpoints, rules)


def _unit(kind: str, idx: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("unit"), idx.alias("unit_idx"), text.alias("text"))


def _scan_units(rows, keys, dom, inline, endpoints, rules, sources=False) -> DataFrame:
    sets = {
        "text": text_patterns(endpoints, rules),
        "inline": _inline_patterns(inline, sources),
    }
    sets = {unit: patterns for unit, patterns in sets.items() if patterns}

    def by_unit(branches: dict[str, str]) -> str:
        whens = " ".join(f"WHEN '{unit}' THEN {e}" for unit, e in branches.items())
        return f"CASE unit {whens} END"

    found = {u: f"array({', '.join(map(_matches, patterns))})" for u, patterns in sets.items()}
    matched = {u: hits("text", "__m", [p[:3] for p in patterns]) for u, patterns in sets.items()}
    if dom or sources:
        matched["dom"] = hits("text", "array(__tok)", [(0, markup.TOKEN, False)])
        found = found or {"dom": "cast(null AS array<array<string>>)"}
    if rules:
        matched["text"] = f"concat({_rule_hits()}, {matched['text']})"
    rows = rows.selectExpr("*", "lower(text) AS __lower")
    if rules:
        possible = possible_rules(F.col("text"), F.col("__lower"), rules)
        rows = rows.withColumn("__rules", F.when(F.col("unit") == "text", possible))
    rows = rows.selectExpr("*", f"{by_unit(found)} AS __m")
    rows = rows.selectExpr("*", f"coalesce({by_unit(matched)}, array()) AS __hits")
    rows = rows.withColumn("__pieces", F.when(F.size("__hits") > 0, chunks(F.col("text"))))

    around = candidates(
        "__hits", "__pieces",
        max(fixed.TEXT_MARGIN, fixed.PARAM_BEFORE, fixed.METHOD_BEFORE),
        max(fixed.TEXT_MARGIN, fixed.PARAM_AFTER),
    )
    if dom or sources:
        wanted = [f"({_DOM_TOKEN} AND ({_SOURCED}))"] if dom else [r"rlike(z.m, r'(?i)^<script[\t\n\f\r />]')"]
        wanted += [f"({_LINKED})"] if sources else []
        elements = candidates(
            "__hits", "__pieces", 0, 2 * fixed.DOM_CONTEXT, keep=" OR ".join(wanted),
            solid=("text", fixed.DOM_CONTEXT), open_only=_OPEN_TOKEN,
            closed=f"CASE {_CLOSING} ELSE '' END",
        )
        around = f"CASE WHEN unit = 'dom' THEN {elements} ELSE {around} END"
    return rows.select(*keys, F.inline(F.expr(around)))
