"""One pattern text, two engines.

``jvm`` gives the Java form that Spark runs, ``re2`` the form for DuckDB. Both keep
the browser's meaning of white space, word boundary and end of text.
"""

from __future__ import annotations

import re

# White space as ECMAScript defines it.
SPACE = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def _rewrite(pattern: str, boundary, end: str, start: str = "^") -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif pair == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
            i += 2
        elif pair == r"\b" and not inside:
            out.append(boundary(pattern[:i], pattern[i + 2 :]))
            i += 2
        elif pair == r"\/":
            out.append("/")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            if pair[0] == "[" and not inside:
                inside = True
                if pair == "[^":
                    out.append("[^")
                    i += 2
                    continue
            elif pair[0] == "]" and inside:
                inside = False
            out.append(pair[0] if inside else {"$": end, "^": start}.get(pair[0], pair[0]))
            i += 1
    return "".join(out)


def _jvm_boundary(before: str, after: str) -> str:
    # Java 17 counts non-ASCII letters as word characters in \b; browsers do not.
    if re.match(r"\w", after):
        return r"(?<!\w)"
    return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


#: Characters that end a line in the browser.
LINE_END = r"\n\r\x{2028}\x{2029}"


def jvm(pattern: str, lines: bool = False) -> str:
    """The Java form; with ``lines``, ``^`` and ``$`` stand at the ends of every line."""
    if not lines:
        return _rewrite(pattern, _jvm_boundary, r"\z")
    return _rewrite(pattern, _jvm_boundary, rf"(?=[{LINE_END}]|\z)", rf"(?<![^{LINE_END}])")


def rule_form(pattern: str) -> str:
    """The Java form of a secret rule, which always works line by line."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return flags + jvm(pattern.removeprefix("(?i)"), lines=True)


def re2(pattern: str, lines: bool = False) -> str:
    """The RE2 form; with ``lines`` it needs the flag ``m`` and knows line feeds only."""
    return _rewrite(pattern, lambda before, after: r"\b", "$" if lines else r"\z")


def quoted(text: str) -> str:
    """A regular expression as a raw string of Spark SQL."""
    inner = text.replace("'", r"\x27").replace("${", r"$\x7B")
    return f"r'{inner}'"


def has_group(pattern: str) -> bool:
    """True when the pattern has a capture group."""
    return re.search(r"(?<!\\)(?:\\\\)*\((?!\?[^P<]|\?<[=!])", _without_classes(pattern)) is not None


def _without_classes(pattern: str) -> str:
    return re.sub(r"(?<!\\)\[(?:\\.|[^\]\\])*\]", "_", pattern)


def required_literals(pattern: str) -> set[str]:
    """Texts of which every match holds at least one; empty when that cannot be told.

    Used only as a cheap test before the pattern itself, so missing one costs time, never
    a match.
    """
    branches = _split_bars(pattern)
    if len(branches) > 1:
        each = [required_literals(b) for b in branches]
        return set().union(*each) if all(each) else set()
    best: set[str] = set()
    run = ""

    def weight(literals):
        return min(map(len, literals)) if literals else 0

    for item, quantifier in _items(pattern):
        optional = quantifier[:1] in ("?", "*") or quantifier.startswith("{0")
        options: set[str] = set()
        if item[0] == "(" and not optional:
            body = re.sub(r"^\((?:\?:)?", "", item[:-1])
            options = required_literals(body) if not body.startswith("?") else set()
        elif len(item) == 1 and item not in ".^$[":
            run += "" if optional else item
        elif item[0] == "\\" and not item[1].isalnum():
            run += "" if optional else item[1]
        elif item != r"\b":
            optional = True
        if quantifier or optional or item[0] == "(":
            options, run = max([options, {run} if run else set()], key=weight), ""
        if weight(options) > weight(best):
            best = options
    if len(run) > weight(best):
        best = {run}
    return best if weight(best) >= 2 else set()


def first_chars(pattern: str) -> str | None:
    """The inside of a class of characters with one of which every match begins; None when that cannot be told."""
    out = ""
    for branch in _split_bars(pattern):
        for item, quantifier in _items(branch):
            if item == r"\b":
                continue
            if item[0] == "(" and (item[1] != "?" or item[2] == ":"):
                found = first_chars(re.sub(r"^\((?:\?:)?", "", item[:-1]))
            elif item[0] == "[" and item[1] != "^":
                found = item[1:-1] if "-" not in (item[1], item[-2]) else None
            elif item[0] == "\\":
                found = item if item[1] in "dws" or not item[1].isalnum() else None
            else:
                found = item if len(item) == 1 and item not in ".^$[" else None
                found = f"\\{found}" if found in ("-", "]", "&", "\"", "'") else found
            if found is None:
                return None
            out += found
            if quantifier[:1] not in ("?", "*") and not quantifier.startswith("{0"):
                break
        else:
            return None
    return out


def guarded(pattern: str) -> str:
    """A pattern that begins with branches or a word boundary, behind a look at the first character.

    It matches the same; most places of a text are passed over without a trial of each branch.
    """
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    rest = pattern.removeprefix("(?i)")
    first = first_chars(rest) if rest.startswith(("(", r"\b")) else None
    return pattern if first is None else f"{flags}(?=[{first}]){rest}"


_TOKEN = r"\\.|\[(?:\\.|[^\]\\])*\]|."


def _items(pattern: str):
    """(item, quantifier) pairs: groups whole, classes whole, single characters."""
    tokens, i = re.findall(_TOKEN, pattern, re.S), 0
    while i < len(tokens):
        item = tokens[i]
        if item == "(":
            depth = 1
            while depth:
                i += 1
                depth += {"(": 1, ")": -1}.get(tokens[i], 0)
                item += tokens[i]
        i += 1
        quantifier = ""
        if i < len(tokens) and tokens[i] in ("?", "*", "+", "{"):
            while True:
                quantifier += tokens[i]
                i += 1
                if quantifier[0] != "{" or quantifier[-1] == "}":
                    break
            if i < len(tokens) and tokens[i] in ("?", "+"):
                i += 1
        yield item, quantifier


def _split_bars(pattern: str) -> list[str]:
    out, depth = [""], 0
    for token in re.findall(_TOKEN, pattern, re.S):
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += token
    return out
