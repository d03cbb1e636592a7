"""Columns over HTML: tokens, attributes and inline script bodies.

A token is a comment, a raw-text element with its whole body, or a start tag. Quantifiers
are possessive where that cannot change the match, so long tags need no deep recursion.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsift.functions.text import named, rmatch, trim

# --- fixed values: elements whose content is text, not markup -----------------
RAW_TEXT = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"]

WS = r"[\t\n\f\r ]"


def attributes_pattern(possessive: bool = True) -> str:
    p, run = ("+", "++") if possessive else ("", "")
    return rf"""(?:[^>=]{run}|={WS}*"[^"]*"|={WS}*'[^']*'|=)*{p}"""


def token_pattern(possessive: bool = True) -> str:
    attrs = attributes_pattern(possessive)
    raw = "|".join(
        rf"{t}(?:[\t\n\f\r /]{attrs})?>[\s\S]*?(?:</{t}[\t\n\f\r />]|\z)" for t in RAW_TEXT
    )
    return rf"(?i)<(?:!--[\s\S]*?(?:-->|\z)|{raw}|[a-z][^\t\n\f\r />]*{attrs}>)"


TOKEN = token_pattern()
START_TAG = rf"(?i)^<[a-z][^\t\n\f\r />]*{attributes_pattern()}>"
ATTRIBUTE = rf"""[^\t\n\f\r "'>/=]+(?:{WS}*={WS}*(?:"[^"]*"|'[^']*'|[^\t\n\f\r "'>][^\t\n\f\r >]*))?"""


#: Elements that are shown with what stands between their tags.
OPEN = ("a", "form", "video", "audio")


def closing(name: str) -> str:
    """Everything up to the first end tag of an element."""
    return rf"(?is)^.*?</{name}{WS}*>"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^<([a-zA-Z][^\t\n\f\r />]*)", 1))


def start_tag(token: Column) -> Column:
    return F.regexp_extract(token, START_TAG, 0)


def attribute_pairs(tag: Column) -> Column:
    """The attributes of a start tag as they are written, in order."""
    inner = F.regexp_replace(tag, r"^<[a-zA-Z][^\t\n\f\r />]*", "")
    return F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0))


def pair_value(pairs: Column, name: Column) -> Column:
    """Value of the first attribute called ``name`` (lower case) as it is written, null when absent, '' when empty."""
    mine = F.filter(pairs, lambda a: F.lower(F.regexp_extract(a, r"""^[^\t\n\f\r "'>/=]+""", 0)) == name)
    value = F.regexp_replace(F.get(mine, F.lit(0)), rf"^[^=]*(?:={WS}*)?", "")
    return named(value, lambda v: F.when(rmatch(v, "^[\"']"), F.regexp_replace(v, "^[\"']|[\"']\\z", "")).otherwise(v))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first such attribute, null when absent, '' when empty."""
    return decode_entities(pair_value(attribute_pairs(tag), F.lit(name)))


def _names() -> str:
    """All names of references with their characters, as pairs that ``str_to_map`` reads, the usual ones first.

    Names of the older standards are there without their semicolon, too. Numbers of the C1
    range mean the characters of Windows-1252.
    """
    known = dict.fromkeys(["amp;", "quot;", "lt;", "gt;", "apos;", "nbsp;", "amp"])
    known.update(sorted(html5.items()))
    for n in range(0x80, 0xA0):
        char = bytes([n]).decode("cp1252", "ignore")
        if char:
            known[str(n)] = char
    return "\x1e".join(f"{n}\x1f{c}" for n, c in known.items())


NAMES = _names()
# In an attribute a name without semicolon counts only if neither a letter, a digit nor = comes after it,
# so no shorter name inside a longer word is ever meant.
REFERENCE = r"&(?:#[xX][0-9a-fA-F]++;?|#[0-9]++;?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))"


def _character(ref: Column) -> Column:
    """The character a reference stands for; the reference itself when its name is not known."""
    names = F.str_to_map(F.lit(NAMES), F.lit("\x1e"), F.lit("\x1f"))
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.when(F.length(digits) < 8, digits).otherwise(F.lit("9999999"))
    code = F.when(rmatch(ref, "^&#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    number = F.when(valid, F.coalesce(F.element_at(names, code.cast("string")), char)).otherwise(F.lit("\ufffd"))
    named = F.coalesce(F.element_at(names, F.substring(ref, F.lit(2), F.length(ref))), ref)
    return F.when(F.startswith(ref, F.lit("&#")), number).otherwise(named)


def decode_entities(c: Column) -> Column:
    """Replace character references, each once, as in an attribute value."""

    def decoded(v: Column) -> Column:
        refs = F.regexp_extract_all(v, F.lit(REFERENCE), F.lit(0))
        pieces = F.zip_with(
            F.split(v, REFERENCE), refs, lambda text, ref: F.concat(text, F.coalesce(_character(ref), F.lit("")))
        )
        return F.when(F.contains(v, F.lit("&")), F.array_join(pieces, "")).otherwise(v)

    return named(c, decoded)


def script_bodies(toks: Column) -> Column:
    """Text of every script block without a source, in document order, blanks left out."""
    blocks = F.filter(
        toks,
        lambda t: rmatch(t, r"(?i)^<script[\t\n\f\r />]") & attribute(start_tag(t), "src").isNull(),
    )
    texts = F.transform(
        blocks,
        lambda t: F.regexp_replace(
            F.substring(t, F.length(start_tag(t)) + 1, F.length(t)),
            r"(?i)</script[\t\n\f\r />]?\z",
            "",
        ),
    )
    return F.filter(texts, lambda s: trim(s) != "")
