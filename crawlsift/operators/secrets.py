"""From raw matches to secret findings: rule values, then high-entropy strings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import fixed
from crawlsift.functions.filters import random_looking, secret_noise
from crawlsift.functions.stage import pin
from crawlsift.functions.text import snippet, tail, trim
from crawlsift.operators.candidates import ENTROPY_IDX, RULE_IDX
from crawlsift.sources.rules import Rule

ORDER = ["phase", "source_idx", "pattern_idx", "pos"]


def raw_secrets(cands: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidate rows of texts -> accepted secret values, duplicates kept."""
    is_rule = F.col("idx") >= RULE_IDX
    df = cands.filter((F.col("unit") == "text") & (F.col("idx") >= ENTROPY_IDX))
    value = F.when(
        is_rule, trim(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("match")))
    ).otherwise(F.expr("substring(match, 2, length(match) - 2)"))
    df = pin(df, {"value": value}).filter(~secret_noise(F.col("value")))
    df = df.filter(
        is_rule | (~F.startswith(F.col("value"), F.lit("/")) & random_looking(F.col("value")))
    )

    def named(field, fallback):
        if not rules:
            return F.lit(fallback)
        # One string in the plan, however many rules there are.
        labels = F.from_json(F.lit(json.dumps([getattr(r, field) for r in rules])), "array<string>")
        return F.when(is_rule, F.get(labels, F.col("idx") - RULE_IDX)).otherwise(F.lit(fallback))

    margin = fixed.SECRET_MARGIN
    around = F.concat(
        tail(F.col("before"), margin), F.col("match"), F.substring(F.col("after"), 1, margin)
    )
    return df.withColumns({
        "id": named("id", fixed.ENTROPY_ID),
        "name": named("name", fixed.ENTROPY_NAME),
        "severity": named("severity", fixed.ENTROPY_SEVERITY),
        "context": snippet(around),
        # Rules come first, in table order; entropy hits of the same text follow.
        "pattern_idx": F.when(is_rule, F.col("idx") - RULE_IDX).otherwise(F.lit(RULE_IDX)),
    })


def capped_secrets(df: DataFrame, scope: list[str]) -> DataFrame:
    """Caps per source if any are set, no entropy hit for a value a rule has named, first of each kept.

    ``scope`` are the columns that make one source; every window is partitioned by them,
    so the rows are shuffled once.
    """
    rule = F.col("idx") >= RULE_IDX
    df = df.repartition(*scope)
    nth = Window.partitionBy(*scope, rule).orderBy("pattern_idx", "pos")
    if fixed.RULE_FINDINGS is not None:
        df = df.withColumn("__n", F.row_number().over(nth))
        df = df.filter(~rule | (F.col("__n") <= fixed.RULE_FINDINGS))
    same_value = Window.partitionBy(*scope, "value")
    df = df.withColumn("__named", F.max(rule).over(same_value)).filter(rule | ~F.col("__named"))
    if fixed.ENTROPY_FINDINGS is not None:
        df = df.withColumn("__n", F.row_number().over(nth))
        df = df.filter(rule | (F.col("__n") <= fixed.ENTROPY_FINDINGS))
    first = Window.partitionBy(*scope, "value", "id").orderBy("pattern_idx", "pos")
    df = df.withColumn("__first", F.row_number().over(first)).filter("__first = 1")
    return df.drop("__n", "__named", "__first")
