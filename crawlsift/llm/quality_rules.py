"""Quality rules as robust multivariate outliers: minimum covariance determinant (MCD).

Every text is reduced to counts by array functions. Transformed ratios form a vector; for each
language and source the MCD location and scatter are found by concentration steps from a
deterministic start (median and absolute deviation), the h-quantile of distances being read
from a histogram of their logarithms. A row is rejected when its squared Mahalanobis distance
exceeds a cut. Groups with few rows use the estimate of all rows. DataFrame functions only.

Nulls: a null text has no words; null language or source is a group of its own. Repeated rows
are each judged. An empty table gives an empty result. Columns not named here are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import kept

SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]+"
FEATURES = ["f_symbol", "f_caps", "f_mark", "f_lines", "f_repeat"]
#: Smallest spread of each feature, so that one that is constant in clean text stays usable.
FLOOR = {"f_symbol": 0.04, "f_caps": 0.12, "f_mark": 0.06, "f_lines": 0.25, "f_repeat": 0.25}
#: Correlation of the floors of f_lines and f_repeat: a repeated line repeats its words, so both
#: together are less odd than either alone.
TOGETHER = 0.6
#: Least rows of a group with an estimate of its own.
LEAST = 200
STEPS = 3
COVER = 0.75
#: The chi-square quantile of 5 degrees at one in a million, times the consistency factor of a
#: scatter from the inner 75%: COVER over the chance of 7 degrees under that quantile of 5 (6.63).
CUT = 35.9 * COVER / 0.531


def counts(docs: DataFrame) -> DataFrame:
    """Base counts and ratios of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.split(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), " +").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_caps"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_marks"),
    )
    n = F.when(F.col("word_chars") == 0, 0).otherwise(F.size("words")).cast("long")
    rows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_caps", "n_marks", n.alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("words") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                        i.alias("i"),
                    ),
                )
            ),
        ).alias("windows"),
    )
    # Windows of one content stand together now; those with an equal neighbour are repeated.
    size = F.size("windows")

    def repeated(x: Column, i: Column) -> Column:
        near = F.get("windows", i - 1)["h"].eqNullSafe(x["h"]) | F.get("windows", i + 1)["h"].eqNullSafe(x["h"])
        return F.when(near, x["i"])

    places = F.when(size > 0, F.sort_array(F.array_compact(F.transform("windows", repeated))))
    rows = rows.withColumn("places", places).drop("windows")
    covered = F.transform(
        "places",
        lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))),
    )
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("places")


def vectors(rows: DataFrame) -> DataFrame:
    """The statistic vector: ratios on a logarithmic scale, which keeps small ones apart."""
    ratio = lambda a, b: F.log1p(10 * F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double"))
    return rows.withColumns({
        "f_symbol": ratio("n_symbols", "word_chars"), "f_caps": ratio("n_caps", "word_chars"),
        "f_mark": ratio("n_marks", "word_chars"), "f_lines": ratio("n_dup_lines", "n_lines"),
        "f_repeat": ratio("n_repeat_words", "n_words"),
    })


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, means and covariances per group, with the floors added."""
    p = len(FEATURES)
    sums = [F.count("*").alias("n")]
    sums += [F.avg(a).alias(f"m{i}") for i, a in enumerate(FEATURES)]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    floors = {f"c{i}{i}": F.col(f"c{i}{i}") + FLOOR[a] ** 2 for i, a in enumerate(FEATURES)}
    i, j = FEATURES.index("f_repeat"), FEATURES.index("f_lines")
    floors[f"c{i}{j}"] = F.col(f"c{i}{j}") + TOGETHER * FLOOR["f_repeat"] * FLOOR["f_lines"]
    return _factor(out.withColumns(floors))


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor of each group's covariance as columns l<i><j>, by rows."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            dots = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
            rest = reduce(lambda a, b: a - b, dots, F.col(f"c{i}{j}"))
            cell = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", cell)
    return groups.select(*[c for c in groups.columns if not (c[0] == "c" and c[1:].isdigit())])


def _distance(fields: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, a in enumerate(FEATURES):
        rest = F.col(a) - F.col(f"{fields}m{i}")
        for k in range(i):
            rest = rest - F.col(f"{fields}l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"{fields}l{i}{i}"))
    return reduce(lambda a, b: a + b, [s * s for s in solved])


def _inner(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows within each group's h-quantile of distance, from a histogram of logarithms."""
    from pyspark.sql import Window

    bin_ = F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * 16).cast("int")
    scored = scored.withColumn("bin", bin_)
    sizes = scored.groupBy(*keys, "bin").agg(F.count("*").alias("k"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sizes.withColumn("under", F.coalesce(F.sum("k").over(upto), F.lit(0)))
        .withColumn("all", F.sum("k").over(group))
        .where(F.col("under") < F.col("all") * COVER)
        .groupBy(*keys)
        .agg(F.max("bin").alias("last"))
    )
    return _with(scored, cuts, keys).where(F.col("bin") <= F.col("last")).drop("bin", "last")


def _with(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Attach group columns; the planner broadcasts them while they are small and otherwise
    joins by shuffle, where a hot group is split."""
    return rows.join(groups, keys)


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """MCD location and factor per group of non-null text keys: deterministic start, then steps."""
    start = rows.groupBy(*keys).agg(
        *[F.percentile_approx(a, 0.5, 1000).alias(f"m{i}") for i, a in enumerate(FEATURES)]
    )
    away = _with(rows, start, keys)
    spread = away.groupBy(*keys).agg(
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, a in enumerate(FEATURES)]
    )
    d2 = reduce(
        lambda a, b: a + b,
        [
            ((F.col(a) - F.col(f"m{i}")) / F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOOR[a]))) ** 2
            for i, a in enumerate(FEATURES)
        ],
    )
    scored = _with(away, spread, keys).select(*keys, *FEATURES, d2.alias("d2"))
    groups = kept(_moments(_inner(scored, keys), keys), "mcd")
    for _ in range(STEPS):
        scored = _with(rows, groups, keys).select(*keys, *FEATURES, _distance().alias("d2"))
        groups = kept(_moments(_inner(scored, keys), keys), "mcd")
    return groups


def judge(docs: DataFrame, cut: float = CUT, least: int = LEAST) -> DataFrame:
    """Counts, distance and verdict of every row."""
    rows = kept(
        vectors(counts(docs)).withColumns({
            "g_lang": F.concat(F.lit("="), F.col("lang").cast("string")),
            "g_source": F.concat(F.lit("="), F.col("source").cast("string")),
        }).fillna("", ["g_lang", "g_source"]).withColumn("g_all", F.lit(1)),
        "counts",
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    usable = rows.where(~F.col("base_failed"))
    keys = ["g_lang", "g_source"]
    own = estimates(usable, keys).where(F.col("n") >= int(least * COVER)).drop("n")
    whole = estimates(usable, ["g_all"]).drop("n")
    names = [c for c in whole.columns if c != "g_all"]
    # One row of estimates over all rows: joined by its constant key, as a broadcast.
    pooled = rows.join(F.broadcast(whole.select("g_all", *[F.col(c).alias(f"w_{c}") for c in names])), "g_all", "left")
    both = pooled.join(own, keys, "left")
    d2 = F.coalesce(_distance(), _distance("w_"), F.lit(0.0))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (d2 <= cut)).alias("kept"), d2.alias("distance"),
    )
