"""Predicates that keep or drop candidates, and the severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsift.functions import fixed
from crawlsift.functions.regex import jvm
from crawlsift.functions.text import rmatch


def _any(c: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | rmatch(c, jvm(p))
    return test


def endpoint_noise(path: Column, kind: Column) -> Column:
    """True for paths that are assets or too generic to be an endpoint."""
    broad = (
        (F.length(path) < 4)
        | rmatch(path, jvm(fixed.PATH_NOISE))
        | rmatch(path, jvm(fixed.SINGLE_NOISE))
    )
    return (
        path.isNull()
        | (F.length(path) < 2)
        | rmatch(path, jvm(fixed.STATIC_DIR))
        | rmatch(path, jvm(fixed.STATIC_EXT))
        | (~kind.isin("dom", "inline") & rmatch(path, jvm(fixed.SCRIPT_ASSET)))
        | ((kind == "path") & broad)
    )


def secret_noise(value: Column) -> Column:
    """True for placeholders, identifiers and markup that only look like a secret."""
    repeated = (F.length(value) > 10) & rmatch(value, r"^(.)\1*\z")
    return (
        value.isNull()
        | (F.length(value) < 8)
        | _any(value, fixed.SECRET_PLACEHOLDERS)
        | repeated
    )


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    n = F.length(value)
    shares = F.transform(
        F.array_distinct(F.filter(F.split(value, ""), lambda ch: ch != "")),
        lambda ch: (n - F.length(F.replace(value, ch, F.lit("")))) / n,
    )
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def random_looking(value: Column) -> Column:
    """True for quoted tokens whose alphabet and entropy fit a generated key."""
    hexa = rmatch(value, r"^[0-9a-fA-F]+\z")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    bumps = F.regexp_count(value, F.lit("[a-z][A-Z]"))
    mixed = (
        rmatch(value, "[A-Z]")
        & rmatch(value, "[a-z]")
        & (digits > 0)
        & ~((bumps >= 3) & (digits < 3))
    )
    return F.when(
        hexa, (F.length(value) >= fixed.HEX_LENGTH) & (entropy(value) >= fixed.HEX_ENTROPY)
    ).otherwise(mixed & (entropy(value) >= fixed.MIXED_ENTROPY))


def severity_rank(severity: Column, unknown: int = fixed.LOG_UNKNOWN_RANK) -> Column:
    rank = F.lit(unknown)
    for i, name in reversed(list(enumerate(fixed.SEVERITIES))):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank
