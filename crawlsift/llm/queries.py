"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from crawlsift.llm import (
    context_mixing, decontaminate, filter_audit, fingerprints, jaccard_join, line_dedup, mixing, period_runs, quality_knn, quality_rules,
    sharding, token_ids, toxicity,
)
from crawlsift.llm.common import read, remainder, ship, work_path

THRESHOLD = 0.7


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3)
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), part != 1)
    return toxicity.score(docs, lexicon).select(
        "doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits"
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(read(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token_ids")
    token_ids.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_ids.decoded(token_ids.read(spark, path), token_ids.ranking(spark, path))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4)
    model = quality_knn.learn(docs, read(spark, sf_dir, "labels"), part != 2)
    return quality_knn.score(docs, model).select(
        "doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = period_runs.with_planted_runs(read(spark, sf_dir, "documents"))
    return period_runs.digests(period_runs.collapse(planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_dedup, op2_toxicity, op3_ngram_jaccard_join, op4_quality_rules, op5_decontamination, op6_sharding,
        op7_token_ids, op8_mixing, op9_quality_classifier, op10_lm_scoring, op11_fingerprints, op12_filter_audit, op13_period_runs, pipeline,
    ]
    return {f.__name__: _shipped(f) for f in found}


#: Lines by their text without blanks at the ends; the spread is counted exactly.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM lines
), boilerplate AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('=' || source, '')) >= 10
), marked AS (
  SELECT keyed.*, boilerplate.k IS NOT NULL AS gone FROM keyed LEFT JOIN boilerplate USING (k)
), cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""


#: Every order of the five filters, with the letters that a document fails as a string.
OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), marks AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::int) AS good, max((coalesce(toxic, 0) = 1)::int) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT part,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN first_id IS NOT NULL AND (docs.doc_id IS NULL OR docs.doc_id > first_id) THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM docs LEFT JOIN marks ON marks.doc_id = docs.doc_id GROUP BY 1, 2
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS l, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, l,
         coalesce(sum(n) FILTER (NOT contains(failed, l) AND translate(failed, earlier, '') = failed), 0) AS kept,
         coalesce(sum(n) FILTER (contains(failed, l) AND translate(failed, earlier, '') = failed), 0) AS removed,
         coalesce(sum(n) FILTER (contains(failed, l) AND translate(failed, earlier, '') <> failed), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = l), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(failed, l) AND translate(failed, earlier, '') = failed), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(failed, l) AND translate(failed, earlier, '') = failed), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
       unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::bigint AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op12_filter_audit": OP12_SQL}
