"""Columns over text: trimming, context snippets, match positions and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsift.functions.regex import quoted

CHUNK = 128
BLOCK = 512
SHORT = 100


# The characters of ``regex.SPACE``, for functions that take a set of characters.
SPACE_CHARS = (
    "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim(c: Column) -> Column:
    """Strip white space as the browser's trim does, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def trim_long(c: Column) -> Column:
    """``trim`` for long texts: to strip the end takes the whole text apart, so a look at it comes first."""
    ends = F.array(*map(F.lit, SPACE_CHARS))

    def step(v):
        return F.when(F.exists(ends, lambda ch: F.endswith(v, ch)), F.rtrim(v, F.lit(SPACE_CHARS))).otherwise(v)

    return named(F.ltrim(c, F.lit(SPACE_CHARS)), step)


def rmatch(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def named(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value of ``c``, which is worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def snippet(c: Column) -> Column:
    """Readable context: plain line ends, no tabs, no trailing blanks, few blank lines.

    Each step runs only on text that a plain search shows to need it, none of them on one line
    without tabs.
    """

    def only_with(c, needles, changed):
        def step(v):
            test = F.lit(False)
            for needle in needles:
                test = test | F.contains(v, F.lit(needle))
            return F.when(test, changed(v)).otherwise(v)

        return named(c, step)

    blank_ends = [b + n for b in " \f\x0b" for n in "\n\u2028\u2029"]
    line_ends = r"[ \f\x0B]+(\n|\x{2028}|\x{2029}|\z)"

    def lines(v):
        v = only_with(v, ["\r"], lambda v: F.regexp_replace(v, r"\r\n?", "\n"))
        v = F.replace(v, F.lit("\t"), F.lit("  "))
        v = only_with(v, blank_ends, lambda v: F.regexp_replace(v, line_ends, "$1"))
        return only_with(v, ["\n\n\n\n"], lambda v: F.regexp_replace(v, r"\n{4,}", "\n\n\n"))

    return trim_long(only_with(c, list("\n\r\t\u2028\u2029"), lines))


def tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def first_values(values: Column, n: int | None) -> Column:
    """The first ``n`` values of an array; all of them without a limit."""
    return values if n is None else F.slice(values, 1, n)


def chunks(text: Column) -> Column:
    """The text as pieces of equal length, so that a window reads few of them."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def window(pieces: str, start: str, end: str) -> str:
    """SQL for characters [start, end) of a chunked text; 0-based, clamped to the text."""
    a = f"greatest({start}, 0)"
    first = f"({a} div {CHUNK})"
    count = f"(({end} - 1) div {CHUNK} - {first} + 1)"
    near = f"array_join(slice({pieces}, cast({first} + 1 AS int), cast({count} AS int)), '')"
    return (
        f"CASE WHEN {end} > {a} THEN substring({near}, cast({a} - {first} * {CHUNK} + 1 AS int), {end} - {a}) "
        f"ELSE '' END"
    )


def running_totals(lengths: str) -> str:
    """SQL for inclusive prefix sums of an int array, in blocks so long arrays stay cheap."""
    sums = "aggregate({}, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    blocks = (
        f"transform(sequence(0, cast((size({lengths}) - 1) div {BLOCK} AS int)), "
        f"b -> slice({lengths}, b * {BLOCK} + 1, {BLOCK}))"
    )
    inner = f"transform({blocks}, block -> {sums.format('block')})"
    # An outer one-element transform names the inner sums, which are needed twice.
    bases = sums.format("transform(sums, s -> element_at(s, -1))")
    totals = (
        f"flatten(zip_with(sums, slice({bases}, 1, size(sums)), "
        f"(s, base) -> transform(slice(s, 2, size(s)), x -> x + base)))"
    )
    return f"transform(array({inner}), sums -> {totals})[0]"


def hits(text: str, found: str, patterns) -> str:
    """SQL for the patterns of a text that matched: matches, gaps between, first groups.

    ``found`` holds the matches of each of ``patterns`` (idx, regex, first group wanted).
    """
    each = []
    for n, (idx, regex, grouped) in enumerate(patterns):
        m, rx = f"{found}[{n}]", quoted(regex)
        group = f"regexp_extract_all({text}, {rx}, 1)" if grouped else m
        each.append(
            f"CASE WHEN size({m}) > 0 THEN named_struct('idx', {idx}, 'm', {m}, "
            f"'gaps', split({text}, {rx}), 'groups', {group}) END"
        )
    return f"filter(array({', '.join(each)}), h -> h IS NOT NULL)"


def candidates(
    hits: str, pieces: str, left: int, right: int, keep: str = "true", solid=None, open_only: str = "true", closed: str = "''"
) -> str:
    """SQL that flattens hits to one struct per match with the text around it.

    ``keep`` is a predicate on z.m that drops matches before any window is cut. ``solid``
    is (text, n): where the right window has fewer than n characters besides white space,
    the whole rest of the text stands in for it; ``open_only`` tells which matches need one.
    ``closed`` is the part of a right window ``near`` after which nothing is needed, '' if it goes on;
    it is looked for in a short window first.
    """
    lengths = "transform(h.m, (m, i) -> length(m) + length(h.gaps[i]))"
    ends = f"transform(array({lengths}), lens -> {running_totals('lens')})[0]"
    start = "(z.end - length(z.m))"
    after = window(pieces, "z.end", f"(z.end + {right})")
    if solid:
        text, n = solid
        dense = rf"length(translate(near, ' \t\n\r\f', '')) >= {n}"
        rest = f"substring({text}, z.end + 1, length({text}))"
        shut = f"transform(array({closed}), part -> CASE WHEN part <> '' THEN part ELSE {{}} END)[0]"
        for near, other in ((after, f"CASE WHEN {dense} THEN near ELSE {rest} END"), (window(pieces, "z.end", f"(z.end + {SHORT})"), None)):
            after = f"transform(array({near}), near -> {shut.format(other or after)})[0]"
        after = f"CASE WHEN {open_only} THEN {after} ELSE '' END"
    one = (
        f"named_struct('idx', h.idx, 'pos', {start}, 'match', z.m, 'value', z.g, "
        f"'before', {window(pieces, f'({start} - {left})', start)}, 'after', {after})"
    )
    zipped = (
        f"zip_with(h.m, zip_with(slice(h.groups, 1, size(h.m)), {ends}, "
        f"(g, end) -> named_struct('g', g, 'end', end)), "
        f"(m, r) -> named_struct('m', m, 'g', r.g, 'end', r.end))"
    )
    return f"flatten(transform({hits}, h -> transform(filter({zipped}, z -> {keep}), z -> {one})))"
