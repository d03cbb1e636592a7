"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target in words. A source gives each of its documents as many whole times
as fit; for the budget that is left, documents are counted by exact length, a proportional
share of each length is taken, and bounded-knapsack dynamic programming over the counts that
remain finds the sum nearest to the budget. The documents of a length are picked in the order
of a seeded hash.

Nulls: a null text has no words, a null source is a source of its own, after all others.
Repeated rows count once each. An empty table gives an empty result. Only the columns named
here are read.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions.stage import ranked_globally
from crawlsift.llm.common import WORD, kept

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: The budget that is left to dynamic programming, in words.
SPAN = 1 << 16
#: Rows of one length that are ranked in one group; larger groups are cut into hash slots.
SLOT = 500


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, source_size, target) from (key, source, size), one row per source: shares of all words
    by weight, none above ``most`` times its size.

    Sources take the weights in turn, in code point order, nulls last. Sharing the excess again
    raises what a unit of weight gets, so a source that has stopped stays so: a round is a sum over
    the sources, and only its totals come to the driver.
    """
    ranked = ranked_globally(sizes, [F.col("source").isNull(), F.col("source")])
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1
    rows = kept(ranked.select("key", F.col("size").alias("source_size"), F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight")), "sources")
    limit, stopped, over = F.lit(float(most)) * F.col("source_size"), -1, F.lit(False)
    while True:
        r = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if r["n"] <= stopped or not r["weight"]:
            break
        stopped, share = r["n"], F.lit(float(r["words"]) - r["given"]) * F.col("weight") / F.lit(r["weight"])
        over = share > limit
    target = F.when(over, limit).otherwise(share) if stopped >= 0 else limit
    return rows.select("key", "source_size", target.alias("target"))


def fit(lengths: dict[int, int], budget: int, seed: int = 1) -> dict[int, int]:
    """How many documents of each length to take, their sum as near to ``budget`` as can be found."""
    lengths = {l: c for l, c in lengths.items() if l > 0 and c > 0}
    total = sum(l * c for l, c in lengths.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(lengths)
    hold = min(budget, SPAN)
    share = (budget - hold) / total
    take = {l: int(c * share) for l, c in lengths.items()}
    left = budget - sum(l * k for l, k in take.items())
    order = sorted(lengths)
    random.Random(seed).shuffle(order)
    for l in order:  # whole documents, while the rest stays larger than the programme's span
        k = min(lengths[l] - take[l], max(0, left - hold) // l)
        take[l] += k
        left -= l * k
    # Sums reachable with the documents that are left, as bits of a number; up to one longest
    # document beyond the budget, since nearest may lie above.
    spare = {l: lengths[l] - take[l] for l in order if lengths[l] > take[l]}
    limit = left + max(spare)
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for l, c in spare.items():
        piece = 1
        while c and l <= limit:
            k = min(piece, c)
            grown = reach | (reach << (l * k)) & mask if l * k <= limit else reach
            if grown != reach:
                steps.append((l, k, reach))
                reach = grown
            c, piece = c - k, piece * 2
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    above = left + (above & -above).bit_length() - 1 if above else below
    goal = above if above - left < left - below else below
    for l, k, before in reversed(steps):
        if not before >> goal & 1:
            take[l] += k
            goal -= l * k
    return {l: k for l, k in take.items() if k}


def _seeded(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("tie"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, tie) of every row."""
    # Nulls get a key of their own, so that joins find them.
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    rows = kept(sized(docs).withColumn("key", key), "sizes")
    counts = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    plan = targets(counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), weights, most)

    def budget(group: pd.DataFrame) -> pd.DataFrame:
        """Of one source: a row per distinct length, whatever the number of documents."""
        goal, size = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
        times = int(goal // size) if size else 0
        more = fit(dict(zip(group["size"], group["n"])), round(goal - times * size), seed)
        return pd.DataFrame({
            "key": group["key"], "size": group["size"], "n": group["n"], "times": times,
            "more": [more.get(l, 0) for l in group["size"]],
            "source_size": size, "target": goal,
        })

    lengths = kept(
        counts.join(plan, "key").groupBy("key").applyInPandas(
            budget, "key string, size long, n long, times long, more long, source_size long, target double"
        ),
        "lengths",
    )
    slots = F.floor(F.col("n") / SLOT).cast("long") + 1
    dealt = rows.join(lengths, ["key", "size"]).withColumn("slot", F.pmod(_seeded(seed + 1), slots))
    # Of a cut length, slots give their documents in turn until the number is reached.
    held = dealt.where((F.col("n") >= SLOT) & (F.col("more") > 0)).groupBy("key", "size", "slot").agg(F.count("*").alias("in_slot"))
    before = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("earlier", F.coalesce(F.sum("in_slot").over(before), F.lit(0))).drop("in_slot")
    dealt = dealt.join(held, ["key", "size", "slot"], "left")
    rank = F.row_number().over(Window.partitionBy("key", "size", "slot").orderBy(_seeded(seed), "doc_id", "tie"))
    chosen = (rank + F.coalesce("earlier", F.lit(0))) <= F.col("more")
    return dealt.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("times") + chosen.cast("long"))).alias("taken"),
        (F.col("times") + chosen.cast("long")).alias("copies"), "source", "tie",
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    taken = mix(docs, weights, most, seed)
    # Rows alike in id, source and text share a list, from which each takes one number.
    taken = taken.groupBy("doc_id", "source", "tie").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("list"))
    # A whole row is one column, so that no name of its own can clash.
    keyed = docs.select(
        F.col("doc_id").alias("own_id"), F.col("source").cast("string").alias("own_source"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("own_tie"), F.struct("*").alias("row"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_tie") == F.col("tie"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy("own_tie"))
    found = keyed.join(taken, same).withColumn("times", F.element_at("list", turn)).where("times > 0")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
