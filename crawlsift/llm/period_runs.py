"""Runs of words that repeat with a period, found on an enhanced suffix array.

A run is a longest stretch of words that are equal ``period`` words apart, of at least
``least_words`` words and ``least_power`` periods, where no smaller period does. The texts of a
slice of a batch share one suffix array over word hashes, each text closed by a symbol of its
own, so that nothing matches across texts. Prefix doubling sorts only suffixes that are still
tied, and keeps the ranks of every round: two ranks compare stretches of any length.

Branching squares come from the intervals of equal LCP, which are index ranges and never nodes of
a tree. For an interval of ``depth`` words each suffix i in any child but the largest looks up
whether i + depth or i - depth lies in the interval and in another child: then
``depth`` words stand twice in a row, and the word after them breaks the period. Such a square
is rotated to the left as long as the period holds (by binary search over the kept ranks),
which gives the run; runs of one stretch merge into the one of the smallest period.

A run of L words and period q has q words that match L - q words, so a text in which no
``least_words * (least_power - 1) / least_power`` words stand twice has no run; the first
doubling rounds tell, and only the other texts go on.

Words are equal by a hash of 63 bits. A null text has no words, texts of any length are read whole,
each in one task (about 100 bytes of memory a word). Rows stay where they are: no shuffle. Repeated rows
give repeated results, extra columns are not read, an empty table gives an empty result. A null id has the crc32 of
the empty text where a query needs one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlsift.llm.common import mix, slices, span_hashes, word_spans

LEAST_WORDS, LEAST_POWER = 24, 3
#: Suffixes looked up in one go.
LOOKUPS = 1 << 20

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def refine(rank: np.ndarray, tied: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice ``width`` symbols, and the suffixes that are still tied.

    A rank is the number of suffixes that sort before all those of equal rank.
    """
    key = rank[tied].astype(np.int64) * len(rank) + rank[tied + width]
    order = np.argsort(key, kind="stable")
    tied, key = tied[order], key[order]
    old = rank[tied]
    at = np.arange(len(tied))
    head = np.ones(len(tied), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    old_head = np.ones(len(tied), dtype=bool)
    old_head[1:] = old[1:] != old[:-1]
    finer = rank.copy()
    finer[tied] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(old_head, at, 0))
    alone = head.copy()
    alone[:-1] &= head[1:]
    return finer, tied[~alone]


def first_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by one symbol, and the tied suffixes; symbols are any numbers."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    alone = head.copy()
    alone[:-1] &= head[1:]
    return rank, order[~alone]


def lcp_of(levels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at ``a`` and ``b``."""
    length = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def equal_stretch(levels: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` (1 or more) symbols from ``a`` and from ``b`` are equal."""
    k = np.frexp(length.astype(np.float64))[1] - 1
    known = k < len(levels)
    k = np.where(known, k, 0)
    last = length - (np.int64(1) << k)
    return known & (levels[k, a] == levels[k, b]) & (levels[k, a + last] == levels[k, b + last])


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place of ``lcp`` the bounds of its interval: the next smaller places on both sides."""
    values = lcp.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        # Equal places share the left bound; their right bounds are set when a smaller one comes.
        left[k] = (left[stack[-1]] if values[stack[-1]] == v else stack[-1]) if stack else 0
        stack.append(k)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching squares; ``lcp[k]`` is that of the suffixes k - 1 and k."""
    left, right = lcp_intervals(lcp)
    cuts = np.flatnonzero(lcp > 0)
    cuts = cuts[np.lexsort((cuts, right[cuts], left[cuts]))]
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lb, rb = left[cuts], right[cuts]
    head = np.ones(len(cuts), dtype=bool)
    head[1:] = (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])
    heads = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    # Children of an interval: from its left bound to the first cut, between cuts, to its end.
    starts = np.insert(cuts, heads, lb[heads])
    owner = np.insert(which, heads, np.arange(len(heads)))
    ends = np.empty(len(starts), dtype=np.int64)
    ends[:-1] = starts[1:]
    last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1)
    ends[last] = rb[heads]
    size = ends - starts
    begin = np.concatenate(([0], last[:-1] + 1))
    inside = np.arange(len(starts)) - begin[owner]
    code = size * len(starts) + (len(starts) - 1 - inside)
    small = np.flatnonzero(code != np.maximum.reduceat(code, begin)[owner])
    total = np.cumsum(size[small])
    found = []
    done = 0
    while done < len(small):
        base = int(total[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + LOOKUPS, side="right")))
        some = small[done:upto]
        n = size[some]
        i = sa[spread(starts[some], n)]
        cut = heads[owner[some]]
        depth, lo, hi = (np.repeat(x, n) for x in (lcp[cuts[cut]], lb[cut], rb[cut]))
        own_lo, own_hi = np.repeat(starts[some], n), np.repeat(ends[some], n)
        for start, other in ((i, i + depth), (i - depth, i - depth)):
            at = isa[np.maximum(other, 0)]
            hit = (other >= 0) & (at >= lo) & (at < hi) & ~((at >= own_lo) & (at < own_hi))
            found.append(np.stack((start[hit], depth[hit])))
        done = upto
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, period


def runs_of(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of two periods or more, by the ranks of all rounds."""
    isa = levels[-1]
    sa = np.empty(len(isa), dtype=np.int64)
    sa[isa] = np.arange(len(isa))
    lcp = np.zeros(len(sa), dtype=np.int64)
    lcp[1:] = lcp_of(levels, sa[:-1], sa[1:])
    start, period = squares(sa, isa, lcp)
    end = start + 2 * period
    # The farthest turn to the left with which the period still holds.
    least, most = np.zeros(len(start), np.int64), start.copy()
    while np.any(least < most):
        middle = (least + most + 1) >> 1
        holds = equal_stretch(levels, start - middle, start - middle + period, period + middle)
        least, most = np.where(holds, middle, least), np.where(holds, most, middle - 1)
    start = start - least
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def find_runs(
    words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of texts, in this order.

    ``words`` are hashes of the words of all texts, ``first`` the index of each text's first
    word, and one more at the end.
    """
    texts = np.arange(len(first) - 1)
    counts = np.diff(first)
    # A word with its text, and after each text a symbol that stands nowhere else, behind all words.
    owner = np.repeat(texts, counts + 1)
    symbols = np.empty(len(owner), dtype=np.uint64)
    is_word = np.ones(len(owner), dtype=bool)
    is_word[np.cumsum(counts + 1) - 1] = False
    symbols[is_word] = mix(words + mix(owner[is_word].astype(np.uint64) + np.uint64(1))) >> np.uint64(1)
    symbols[~is_word] = np.uint64(1 << 63) + texts.astype(np.uint64)
    rank, tied = first_ranks(symbols)
    width, twice = 1, max(1, -(-least_words * (least_power - 1) // least_power))
    while len(tied) and 2 * width <= twice:
        rank, tied = refine(rank, tied, width)
        width *= 2
    left = np.zeros(len(counts), dtype=bool)
    left[owner[tied]] = True
    chosen = left[owner]
    if not chosen.any():
        return (np.zeros(0, np.int64),) * 4
    owner = owner[chosen]
    rank, tied = first_ranks(symbols[chosen])
    levels, width = [rank], 1
    while len(tied):
        rank, tied = refine(rank, tied, width)
        levels.append(rank)
        width *= 2
    start, end, period = runs_of(np.stack(levels))
    length = end - start
    good = (length >= least_words) & (length >= least_power * period)
    order = np.lexsort((period[good], start[good]))
    start, length, period = start[good][order], length[good][order], period[good][order]
    text = owner[start]
    return text, start - np.searchsorted(owner, text), length, period


def _batch(column: pa.Array, least_words: int, least_power: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each row."""
    counts, per_row, values, collapsed = [], [], [], []
    for lo, hi, data, offsets in slices(column):
        starts, ends, first = word_spans(data, offsets)
        text, start, length, period = find_runs(span_hashes(data, starts, ends), first, least_words, least_power)
        counts.append(np.diff(first))
        per_row.append(np.bincount(text, minlength=hi - lo))
        values.append(np.stack((start, length, period)))
        edge = np.searchsorted(text, np.arange(hi - lo + 1))
        raw = data.tobytes()
        for row in range(hi - lo):
            kept = raw[offsets[row] : offsets[row + 1]].split()
            a, b = edge[row], edge[row + 1]
            if a < b:
                turn = np.zeros(len(kept) + 1, dtype=np.int64)
                np.add.at(turn, start[a:b] + period[a:b], 1)
                np.add.at(turn, start[a:b] + length[a:b], -1)
                kept = compress(kept, np.cumsum(turn[:-1]) == 0)
            collapsed.append(b" ".join(kept))
    start, length, period = np.concatenate(values, axis=1)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_ARROW_RUN))
    ends = np.concatenate(([0], np.cumsum(np.concatenate(per_row)))).astype(np.int32)
    texts = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.array(np.concatenate(counts), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs), texts


def collapse(docs: DataFrame, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs by start and period, and the text without repeats.

    Of each run only the first period stays, unless another run drops it; words that stay are
    joined by one space.
    """
    rows = docs.select("doc_id", "text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, runs, texts = _batch(batch.column(1), least_words, least_power)
                yield pa.RecordBatch.from_arrays([batch.column(0), n, runs, texts], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType()),
    ])
    return rows.mapInArrow(job, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of one id in ten repeated from some word on, by its crc32.

    With h the crc32 of the id and g = h div 10, words from a = g mod n on become those from a
    to a + p, over and over, where p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    cut = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        whole = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), whole), F.lit(1), n.cast("int")), " ")

    planted = F.get(F.transform(F.array(F.split(cut, r"[\x20\x09-\x0D]+")), repeated), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & (cut != ""), planted).otherwise(F.col("text")).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """One row per document: its strongest run and hashes of all runs and of the collapsed text."""

    def stronger(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    df = collapsed.withColumn("best", F.aggregate("runs", none, stronger))
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
