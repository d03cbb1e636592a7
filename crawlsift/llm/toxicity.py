"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Words are folded first: lower case, look-alike letters of other scripts, digits and signs that
stand for letters, marks around a word removed. The lexicon holds whole words and word
beginnings whose number of distinct settings (word before, word after) sets toxic labelled texts
apart; its weights are their log-odds. Copies of a labelled text count once. Two-word phrases that hold a match but are known from clean texts are exceptions and
cancel the matches inside them. Weights are summed, put in relation to the length, and turned
into a score by a logistic curve fitted on the same labelled sample.

Nulls and empty texts have no match and get the score of none. Labels may be missing: without
both classes the lexicon is empty and every score is the same. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import labelled

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",
    "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e",
    "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "χ": "x", "ɡ": "g", "ı": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# l and i are one letter after folding, since 1 stands for either.
SAME = {"l": "i", "!": "i", "|": "i"}

LETTERS = str.maketrans({**LOOKALIKES, "l": "i"})
EVERY = str.maketrans({**LOOKALIKES, **SIGNS, **SAME})
EDGES = re.compile(r"^[^\w@$]+|[^\w]+$")
SAMPLE = 30_000
#: Lengths of word beginnings, least toxic texts (and settings) with a pattern, least log-odds
#: of its settings, most clean settings for a toxic one.
BEGIN, LEAST, ODDS, PURE = (3, 4, 5, 6), 4, 3.0, 0.1
#: One setting in so many rules candidates out before all settings are counted.
SHARE = 16
#: Folded words in the table, and settings a task holds before it hands them on.
CACHE = HELD = 200_000


def fold(word: str) -> str:
    """One word without marks at its ends; signs count as letters only beside letters."""
    word = EDGES.sub("", word.lower())
    if word.isalpha():
        return word.translate(LETTERS)
    return word.translate(EVERY) if any(c.isalpha() for c in word) else word


_folded: dict[str, str] = {}


def folded(text: str) -> list[str]:
    """The folded words of a text, by a table of bounded size."""
    global _folded
    words = text.split()
    try:
        return [_folded[w] for w in words]
    except KeyError:
        if len(_folded) > CACHE:
            _folded = {}
        for w in words:
            if w not in _folded:
                _folded[w] = fold(w)
        return [_folded[w] for w in words]


@dataclass
class Lexicon:
    """Patterns start with a space; those that end with one match whole words only."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def matches(self, words: list[str]) -> tuple[float, int]:
        """(weight, number) of the matches, at most one for each place in the text."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:
                if p not in self.weights:
                    self._automaton.add_word(p, (len(p), -1.0))
            self._automaton.make_automaton()
        if not self.weights or not words:
            return 0.0, 0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self._automaton.iter(" " + " ".join(words) + " "):
            start = end - n + 1
            if w < 0:
                excused.append((start, end))
            else:
                best[start] = max(w, best.get(start, 0.0))
        for lo, hi in excused:
            for start in [s for s in best if lo <= s < hi]:
                del best[start]
        return sum(best.values()), len(best)

    def features(self, words: list[str]) -> tuple[float, float]:
        """The weight of all matches, and the weight per square root of the length."""
        total, _ = self.matches(words)
        return float(np.log1p(total)), float(np.log1p(10 * total / np.sqrt(len(words) + 1)))

    def score(self, words: list[str]) -> float:
        a, b = self.features(words)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-z)))


def _patterns(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    for n in BEGIN:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


def _distinct(sample: DataFrame) -> DataFrame:
    """The row numbers of one row of each text and class; only digests are shuffled, not texts."""
    return sample.groupBy(F.md5("text").alias("digest"), "y").agg(F.min("row").alias("row")).select("row")


def _words(text: str) -> Iterator[tuple[str, str]]:
    """The folded words of a text, each with its setting: the word before and the word after."""
    words = ["", *folded(text), ""]
    return ((w, f"{x} {z}") for x, w, z in zip(words, words[1:], words[2:]))


def _rows(rows: set, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _candidates(sample: DataFrame) -> set[str]:
    """The patterns of at least ``LEAST`` toxic texts, but those whose clean settings among a share
    of all settings alone are too many for all their toxic occurrences."""

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, times = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                for w, n in Counter(folded(text)).items():
                    found = _patterns({w})
                    times.update(dict.fromkeys(found, n))
                texts.update(_patterns(set(folded(text))))
            names = list(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([texts[p] for p in names], pa.int64()), pa.array([times[p] for p in names], pa.int64())],
                names=["pattern", "texts", "times"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types, rows = ["word", "setting"], [pa.string(), pa.string()], set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows.update((w, x) for w, x in _words(text) if crc32(x.encode()) % SHARE == 0)
                if len(rows) > HELD:
                    yield _rows(rows, names, types)
                    rows = set()
        yield _rows(rows, names, types)

    most = sample.where("y = 1").select("text").mapInArrow(toxic, "pattern string, texts long, times long").groupBy("pattern")
    most = most.agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")).where(F.col("texts") >= LEAST)
    least = sample.where("y = 0").select("text").mapInArrow(clean, "word string, setting string")
    begins = [F.when(F.length("word") > n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in BEGIN]
    whole = F.when(F.length("word") > 2, F.concat(F.lit(" "), "word", F.lit(" ")))
    least = least.select(F.explode(F.array_compact(F.array(whole, *begins))).alias("pattern"), F.xxhash64("setting").alias("setting"))
    least = least.distinct().groupBy("pattern").agg(F.count("*").alias("clean"))
    rows = most.join(least, "pattern", "left").where(F.coalesce("clean", F.lit(0)) <= PURE * F.col("times"))
    return {r.pattern for r in rows.select("pattern").collect()}


def _table(sample: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """(pattern, toxic settings, clean settings) of all patterns that pass the limits, and the
    number of distinct texts per class.

    A word of a much-copied text has many texts but few settings.
    """
    candidates = sample.sparkSession.sparkContext.broadcast(_candidates(sample))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = candidates.value, {}
        names, types, rows = ["pattern", "setting", "y"], [pa.string(), pa.string(), pa.int32()], set()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for w, x in _words(text):
                    if w not in known:
                        if len(known) > CACHE:
                            known.clear()
                        known[w] = _patterns({w}) & wanted
                    rows.update((p, x, y) for p in known[w])
                if len(rows) > HELD:
                    yield _rows(rows, names, types)
                    rows = set()
        yield _rows(rows, names, types)

    classes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    rows = sample.mapInArrow(find, "pattern string, setting string, y int").distinct()
    rows = rows.groupBy("pattern").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    rows = rows.where((F.col("toxic") >= LEAST) & (odds >= ODDS) & (F.col("clean") <= PURE * F.col("toxic")))
    return [(r.pattern, r.toxic, r.clean) for r in rows.collect()], n1, n0


def _choose(table: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Of nested patterns, the longest that is as common as the shorter one."""
    chosen: dict[str, float] = {}
    reach: dict[str, int] = {}  # the most settings of a chosen pattern with this beginning
    for p, toxic, clean in sorted(table, key=lambda x: (-x[1], -len(x[0]), x[0])):
        shorter = any(p[:k] in chosen for k in range(2, len(p)))
        if not shorter and reach.get(p, 0) < 0.95 * toxic:
            chosen[p] = float(np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1)))
            for k in range(2, len(p) + 1):
                reach[p[:k]] = max(toxic, reach.get(p[:k], 0))
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps for a logistic curve with a small penalty."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, b))


def learn(docs: DataFrame, labels: DataFrame, where: Column, bound: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon and curve from at most about ``bound`` labelled texts for which ``where`` holds.

    ``exceptions`` are phrases to add to those that the sample shows.
    """
    copies = labelled(docs, labels, "toxic", where, bound).withColumn("row", F.monotonically_increasing_id()).persist()
    rows = _distinct(copies).persist()
    sample = copies.join(F.broadcast(rows), "row").select("text", "y")  # about bound numbers
    try:
        table, n1, n0 = _table(sample)
        lexicon = Lexicon(_choose(table, n1, n0))
        given = tuple(" " + " ".join(map(fold, p.split())) + " " for p in exceptions)

        def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {1: Counter(), 0: Counter()}
            for batch in batches:
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                    words = folded(text)
                    hit = [lexicon.matches([w])[1] > 0 for w in words]
                    found[y].update({f" {words[i]} {words[i + 1]} " for i in range(len(words) - 1) if hit[i] or hit[i + 1]})
            names = list(found[1] | found[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([found[1][p] for p in names], pa.int64()), pa.array([found[0][p] for p in names], pa.int64())],
                names=["phrase", "toxic", "clean"],
            )

        learnt = (
            sample.mapInArrow(phrases, "phrase string, toxic long, clean long").groupBy("phrase")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("clean") >= LEAST) & (F.col("clean") >= 10 * F.col("toxic")))
            .orderBy(F.desc("clean"), "phrase")
        )
        lexicon.exceptions = (*given, *[r.phrase for r in learnt.collect()])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [lexicon.features(folded(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column("y")], names=["a", "b", "y"]
                )

        got = sample.mapInArrow(measure, "a double, b double, y int").toPandas()  # the bounded sample
        if n1 and n0:
            lexicon.curve = _logistic(got[["a", "b"]].to_numpy(), got["y"].to_numpy(dtype=float))
        return lexicon
    finally:
        rows.unpersist()
        copies.unpersist()


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, n_words, n_hits, weight, score) of every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # what passed, from about bound texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = folded(text or "")
                total, hits = lex.matches(words)
                rows.append((len(words), hits, total, lex.score(words) if hits else None))
            none = lex.score([])
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                 pa.array([none if s is None else s for s in cols[3]], pa.float64())],
                names=["doc_id", "n_words", "n_hits", "weight", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hits long, weight double, score double")
