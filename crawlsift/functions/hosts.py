"""Host names as a browser writes them: decoded, lowered, in ASCII, with plain IPv4 addresses.

All of it is SQL text over native functions. International labels become Punycode by two
nested folds over their code points. What the Unicode mapping tables do beyond lower case, full-width
forms and ideographic stops is not done: letters in a decomposed form stay so.
"""

from __future__ import annotations

from crawlsift.functions.regex import quoted

# --- fixed values: parameters of the label coding (RFC 3492) ---------------------------
BASE, LEAST, MOST, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# --- fixed values: a last label that makes a host an IPv4 address -------------------------
ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?\z"
# Stands for a host that is none: no host name may hold it.
NO_HOST = "%"

#: Full-width forms of ASCII, the stops of other scripts, and characters that are left out.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "。｡"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + ".."
_IGNORED = "­​⁠﻿"


def _named(value: str, name: str, use: str) -> str:
    """SQL of ``use``, in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(n: int) -> str:
    return f"cast({n} AS bigint)"


def _digit(value: str) -> str:
    return f"substring('{DIGITS}', cast({value} AS int) + 1, 1)"


def _written(state: str) -> str:
    """The text of a state with its delta added as a number of variable length."""
    limit = f"greatest({_number(LEAST)}, least({_number(MOST)}, v.k - {state}.bias))"
    rest = f"(v.q - x) div ({BASE} - x)"
    more = f"named_struct('q', {rest}, 'k', v.k + {BASE}, 'out', concat(v.out, {_digit(f'x + (v.q - x) % ({BASE} - x)')}), 'done', false)"
    last = f"named_struct('q', v.q, 'k', v.k, 'out', concat(v.out, {_digit('v.q')}), 'done', true)"
    step = f"CASE WHEN v.done THEN v ELSE {_named(limit, 'x', f'CASE WHEN v.q < x THEN {last} ELSE {more} END')} END"
    start = f"named_struct('q', {state}.d, 'k', {_number(BASE)}, 'out', {state}.out, 'done', false)"
    return f"aggregate(sequence(1, 14), {start}, (v, i) -> {step}).out"


def _adapted(state: str, basic: str) -> str:
    """The bias after a delta was written."""
    damped = f"(CASE WHEN {state}.h = {basic} THEN {state}.d div {DAMP} ELSE {state}.d div 2 END)"
    start = _named(damped, "y", f"named_struct('d', y + y div ({state}.h + 1), 'k', {_number(0)})")
    bound = (BASE - LEAST) * MOST // 2
    shrunk = f"named_struct('d', a.d div {BASE - LEAST}, 'k', a.k + {BASE})"
    looped = f"aggregate(sequence(1, 12), {start}, (a, i) -> CASE WHEN a.d > {bound} THEN {shrunk} ELSE a END)"
    return _named(looped, "z", f"z.k + {BASE - LEAST + 1} * z.d div (z.d + {SKEW})")


def _punycode(label: str) -> str:
    """SQL of the coded form of a label with other than ASCII characters."""
    state = lambda d, h, out, bias, n: f"named_struct('d', {d}, 'h', {h}, 'out', {out}, 'bias', {bias}, 'n', {n})"
    emitted = state(_number(0), "t.h + 1", _written("t"), _adapted("t", "b"), "t.n")
    same = state("t.d + 1", "t.h", "t.out", "t.bias", "t.n")
    each = f"CASE WHEN c < m THEN {same} WHEN c = m THEN {emitted} ELSE t END"
    begun = state("s.d + (m - s.n) * (s.h + 1)", "s.h", "s.out", "s.bias", "m")
    through = f"aggregate(cps, {begun}, (t, c) -> {each})"
    step = _named(through, "e", state("e.d + 1", "e.h", "e.out", "e.bias", "e.n + 1"))
    plain = f"regexp_replace({label}, '[^\\\\x00-\\\\x7F]', '')"
    first = state(_number(0), "b", f"CASE WHEN b > 0 THEN concat({plain}, '-') ELSE '' END", _number(FIRST_BIAS), _number(FIRST_CODE))
    codes = f"array_sort(array_distinct(filter(cps, c -> c >= {FIRST_CODE})))"
    basic = f"cast(size(filter(cps, c -> c < {FIRST_CODE})) AS bigint)"
    folded = _named(basic, "b", f"aggregate({codes}, {first}, (s, m) -> {step}).out")
    points = f"transform(regexp_extract_all({label}, '(?s).', 0), ch -> cast(conv(hex(encode(ch, 'UTF-32')), 16, 10) AS bigint))"
    return _named(points, "cps", folded)


def _ipv4(host: str) -> str:
    """SQL of the dotted form of an address of one to four numbers, decimal, octal or hexadecimal."""
    number = (
        f"CASE WHEN rlike(p, '^0[xX][0-9a-fA-F]*\\\\z') THEN try_cast(conv(concat('0', substring(p, 3)), 16, 10) AS decimal(20, 0)) "
        f"WHEN rlike(p, '^0[0-7]+\\\\z') THEN try_cast(conv(p, 8, 10) AS decimal(20, 0)) "
        f"WHEN rlike(p, '^(?:0|[1-9][0-9]{{0,18}})\\\\z') THEN try_cast(p AS decimal(20, 0)) END"
    )
    parts = f"transform(split(regexp_replace({host}, '\\\\.\\\\z', ''), '\\\\.'), p -> {number})"
    weight = "CASE WHEN i = size(ns) - 1 THEN x ELSE x * cast(power(256, 3 - i) AS decimal(20, 0)) END"
    fits = (
        "size(ns) <= 4 AND forall(ns, x -> x IS NOT NULL) AND forall(slice(ns, 1, size(ns) - 1), x -> x <= 255) "
        "AND element_at(ns, -1) < cast(power(256, 5 - size(ns)) AS decimal(20, 0))"
    )
    total = f"cast(aggregate(transform(ns, (x, i) -> {weight}), cast(0 AS decimal(38, 0)), (a, x) -> cast(a + x AS decimal(38, 0))) AS bigint)"
    dotted = _named(total, "v", "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)")
    return _named(parts, "ns", f"CASE WHEN {fits} THEN {dotted} ELSE '{NO_HOST}' END")


def ascii_host(raw: str) -> str:
    """SQL of the host that a browser makes of ``raw``; ``NO_HOST`` where it would reject it.

    Addresses in brackets are lowered only.
    """
    decoded = f"CASE WHEN contains(r, '%') THEN coalesce(try_url_decode(replace(r, '+', '%2B')), '{NO_HOST}') ELSE r END"
    mapped = f"lower(translate(d, {_string(_WIDE + _IGNORED)}, {_string(_PLAIN)}))"
    beyond = r"'[^\\x00-\\x7F]'"
    label = f"CASE WHEN rlike(l, {beyond}) THEN concat('xn--', {_punycode('l')}) ELSE l END"
    in_ascii = f"CASE WHEN rlike(w, {beyond}) THEN array_join(transform(split(w, '\\\\.'), l -> {label}), '.') ELSE w END"
    checked = f"CASE WHEN contains(w, '�') THEN '{NO_HOST}' ELSE {in_ascii} END"
    address = f"CASE WHEN rlike(a, {quoted(ENDS_IN_NUMBER)}) THEN {_ipv4('a')} ELSE a END"
    full = _named(decoded, "d", _named(mapped, "w", _named(checked, "a", address)))
    plain = r"'^[a-z0-9.-]*[a-z-]\\z'"
    # Nearly every host is plain lower case already and takes none of the steps.
    return _named(raw, "r", f"CASE WHEN startswith(r, '[') THEN lower(r) WHEN rlike(r, {plain}) AND NOT rlike(r, {quoted(ENDS_IN_NUMBER)}) THEN r ELSE {full} END")
