"""Document fingerprints: bottom-k sketches of shingle hashes, by column functions alone.

A text's sketch holds the ``K`` smallest distinct hashes of its five-word shingles, in order. The
sketch of a union is the k smallest of both sketches, so parts merge in any order, as columns
(``merge``) or as an aggregate that shuffles only hashes (``merge_rows``). From two sketches
follow resemblance (the share of the union's sample that both have), containment and the
number of distinct shingles. Texts with at most ``K`` distinct shingles are compared exactly;
beyond that the standard error of resemblance r is sqrt(r (1 - r) / K), 0.04 at most.

A word is a run of characters other than space and \\t to \\r. A text of fewer than five words has one
shingle of all its words; one without words has an empty sketch, whose resemblance is 1 to another
empty sketch and 0 to any other. Nulls are empty texts. Equal texts have equal sketches.

``with_next`` pairs each document with the one after it by id (the last with the first). Rows
that repeat an id are in the order of a hash of their texts, null ids come first. Rows equal in id and text
are one row with a count, so that no group of copies meets in one task; each but the last of them
has its own text as the next one. An only row is its own next one. Extra columns are not read, an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.common import kept

K, SHINGLE = 128, 5
#: Copies of one row made in one step.
STEP = 1 << 16

BLANKS = " \t\n\x0b\f\r"
KEY = ["has_id", "id", "h", "n_chars"]


def named(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    cut = F.btrim(text, F.lit(BLANKS))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[\x20\x09-\x0D]+"))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of ``size`` words, as they stand in the text."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        one = F.array(F.xxhash64(w))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return named(words(text), hashes)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, ascending; null is an empty text."""
    return bottom(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def merge_rows(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """(keys, column): one sketch per group, merged from those of its rows.

    Hashes are made distinct and cut to ``k`` a group before they are shuffled by group, so a
    group of any number of rows sends at most ``k`` hashes from each task.
    """
    hashes = df.select(*keys, F.explode(column).alias("__hash")).distinct()
    order = Window.partitionBy(*keys).orderBy("__hash")
    least = hashes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    found = least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(column))
    groups = df.select(*keys).distinct()
    same = [groups[c].eqNullSafe(found[c]) for c in keys]
    joined = groups.join(found, same, "left")
    return joined.select(*[groups[c] for c in keys], F.coalesce(found[column], F.array().cast("array<bigint>")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of all distinct shingles of both that both have, 0 to 1."""

    def share(sample: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(sample, a), b))
        return F.when(F.size(sample) == 0, F.lit(1.0)).otherwise(both / F.size(sample))

    return named(merge(a, b, k), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else by the largest hash kept."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too, 0 to 1; 1 for an empty ``a``."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared))


def packed(a: Column) -> Column:
    """A sketch as text: its hashes as 8 bytes each, in base 64 without line breaks."""
    digits = F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", "")


def unpacked(text: Column) -> Column:
    digits = F.regexp_extract_all(F.hex(F.unbase64(text)), F.lit("[0-9A-F]{16}"), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, -10).cast("bigint"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, sketch, distinct_shingles) per document; no shuffle."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.inline(F.array(F.struct(sketch(text, k).alias("sketch")))))
    return rows.withColumn("distinct_shingles", distinct_count(F.col("sketch"), k))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_chars"), text.alias("text"),
    )


def _order(keys: DataFrame) -> DataFrame:
    """Distinct ``keys`` with their number of rows and the key before each (the last before the first).

    Keys are sorted in ranges; only the last key of each range meets those of other ranges, one
    row per range. The ranges are written first, so that they are the same for both.
    """
    counted = keys.groupBy(*KEY).agg(F.count("*").alias("times"))
    ranges = kept(counted.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    key = F.struct(*KEY)
    ends = ranges.groupBy("range").agg(F.max(key).alias("last"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ends = ends.select("range", F.coalesce(F.max("last").over(earlier), F.max("last").over(whole)).alias("handed"))
    inside = Window.partitionBy("range").orderBy(*KEY)
    return ranges.withColumn("before", F.lag(key).over(inside)).join(F.broadcast(ends), "range").select(
        *KEY, "times", F.coalesce("before", "handed").alias("before"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, next_text, times): each distinct row with the text of the one after it.

    The texts are shuffled once to their own key and once to the key before.
    """
    keyed = _keyed(docs)
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text"))
    linked = texts.join(_order(keyed.select(*KEY)), KEY)
    after = linked.select(*[F.col(f"before.{c}").alias(c) for c in KEY], F.col("text").alias("next_text"))
    df = linked.drop("before").join(after, KEY)
    # All rows of a group of equal rows but the last come before another one of the group.
    copies = F.struct((F.col("times") - 1).alias("times"), F.col("text").alias("next_text"))
    last = F.struct(F.lit(1).cast("bigint").alias("times"), F.col("next_text").alias("next_text"))
    turns = F.when(F.col("times") > 1, F.array(copies, last)).otherwise(F.array(last))
    df = df.select("has_id", "id", "n_chars", "text", F.inline(turns).alias("times", "next_text"))
    return df.select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "n_chars", "text", "next_text", "times")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its second half, rounded down, replaced by as much of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, a bounded number of copies at a time."""
    n = F.col(times)
    rounds = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")))
    df = df.withColumn("__round", rounds)
    inside = F.least(F.lit(STEP), n - F.col("__round").cast("bigint") * STEP).cast("int")
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), inside))).drop(times, "__round", "__copy")


def compare_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to that and to the next text's.

    One row for each row of ``docs``, with the hash of the edited text.
    """
    df = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    made = F.struct(
        sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("changed"),
        sketch(F.col("next_text"), k).alias("following"), F.sha2("edited", 256).alias("edited_sha256"),
    )
    df = df.select("doc_id", "n_chars", "times", F.inline(F.array(made)))
    own = F.col("own")
    found = df.select(
        "doc_id", "n_chars", "edited_sha256", packed(own).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        resemblance(own, F.col("changed"), k).alias("near_edited"), resemblance(own, F.col("following"), k).alias("near_next"),
        distinct_count(own, k).alias("distinct_shingles"), "times",
    )
    return repeated(found, "times")
