"""Parameter names and request method guessed from the text around a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsift.functions import fixed
from crawlsift.functions.regex import guarded, jvm
from crawlsift.functions.text import first_values, rmatch, tail, trim

def _decoded(name: Column) -> Column:
    """The name without percent codes; null when they are malformed or no UTF-8."""
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    def marks(c, mark):
        return F.size(F.split(c, mark)) - 1

    # Bytes that are no UTF-8 come out as replacement marks that the name did not hold.
    given = marks(name, "\ufffd") + marks(name, "(?i)%EF%BF%BD")
    return F.when(~F.contains(plain, F.lit("\ufffd")) | (marks(plain, "\ufffd") == given), plain)


def query_names(query: Column) -> Column:
    """Distinct parameter names of a query string, in order."""
    pairs = F.split(F.regexp_replace(trim(query), r"^\?", ""), "&")
    raw = F.filter(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), lambda n: n != "")
    names = F.transform(raw, lambda n: trim(F.coalesce(_decoded(n), n)))
    found = first_values(F.array_distinct(F.filter(names, lambda n: n != "")), fixed.PARAMS_PER_ENDPOINT)
    # Most references have no query.
    return F.when(query == "", F.array().cast("array<string>")).otherwise(found)


def _keys(bodies: Column) -> Column:
    def of_body(body):
        return F.transform(
            F.regexp_extract_all(body, F.lit(jvm(fixed.OBJECT_KEY)), F.lit(0)),
            lambda k: F.regexp_extract(k, "[a-zA-Z_][a-zA-Z0-9_]*", 0),
        )

    return F.flatten(F.transform(bodies, of_body))


def around(before: Column, match: Column, after: Column, left: int, right: int) -> Column:
    """Text from ``left`` characters before the start of a match to ``right`` after it."""
    return F.concat(tail(before, left), F.substring(F.concat(match, after), 1, right))


def nearby_names(win: Column) -> Column:
    """Distinct parameter names in a text window: query strings and object keys."""

    def if_has(needle, found, empty):
        return F.when(F.contains(win, F.lit(needle)), found).otherwise(empty)

    none = F.array().cast("array<string>")
    qs = if_has("?", F.regexp_extract(win, jvm(fixed.QUERY_STRING), 1), F.lit(""))
    in_query = F.filter(
        F.transform(F.split(qs, "&"), lambda p: _decoded(F.substring_index(p, "=", 1))),
        lambda n: n.isNotNull() & rmatch(n, jvm(fixed.PARAM_NAME)),
    )
    keywords = F.array(*[F.lit(k) for k in fixed.JS_KEYWORDS])
    bodies = F.regexp_extract_all(win, F.lit(jvm(guarded(fixed.OBJECT_LITERAL))), F.lit(1))
    literals = _keys(if_has("{", bodies, none))
    bodies = F.regexp_extract_all(win, F.lit(jvm(fixed.SEARCH_PARAMS)), F.lit(1))
    search = _keys(if_has("URLSearchParams", bodies, none))
    names = F.concat(in_query, F.filter(literals, lambda k: ~F.array_contains(keywords, k)), search)
    return first_values(F.array_distinct(names), fixed.PARAMS_PER_ENDPOINT)


def guessed_method(near: Column) -> Column:
    """First method word found in the upper-cased window; GET when there is none."""
    guess = F.lit("GET")
    for word in reversed(fixed.METHOD_WORDS):
        guess = F.when(F.contains(near, F.lit(word)), F.lit(word)).otherwise(guess)
    return guess
