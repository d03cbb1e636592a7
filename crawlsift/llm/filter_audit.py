"""Filter interaction audit: what every order of a set of filters removes at every step.

Each document has a mask of the filters that it fails. The masks of a part (a language) with the
number of their documents are a zero-suppressed decision diagram: a node tests one filter, its
``hi`` edge leads to the documents that fail it, its ``lo`` edge to those that pass, a filter
that nobody fails has no node, and every node knows how many documents, good ones and toxic ones
lie below it. Following the ``lo`` edges from the root is the path of a document that passes
everything, so each of its nodes gives one step: what hangs on its ``hi`` edge is removed there.
All orders of the filters follow from one diagram by swapping adjacent levels, one swap an order.

The diagrams hold at most 2^5 counts a part, whatever the number of documents; reading texts,
finding equal ones and counting masks is plain Spark.

A null text is empty, a null language is the empty part. Texts are equal by a hash of 128 bits
and their length. A null id comes after all others, so it is no smaller id, and it fails E if
any row with an id has its text; rows that repeat an id and its text are no copies of each
other. A document is good or toxic if any of its labels says so. Extra columns are not read. An empty table
has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import kept

FILTERS = "ABCDE"
BLANKS = " \t\n\x0b\f\r"
COUNTS = ["n", "good", "toxic"]
OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)

Weight = tuple[int, int, int]
ZERO = 0


class Diagram:
    """A zero-suppressed diagram of weighted masks: ``nodes[id]`` is (filter, lo, hi)."""

    def __init__(self, order: str, masks: dict[str, Weight]):
        """``masks`` maps the failed filters of documents, as a string in any order, to weights."""
        self.order = list(order)
        self.nodes: dict[int, tuple[str, int, int]] = {}
        self.ids: dict[tuple, int] = {}
        self.weight: list[Weight] = [(0, 0, 0)]
        self.root = self._build({frozenset(m): w for m, w in masks.items() if any(w)}, 0)

    def _build(self, masks: dict[frozenset, Weight], level: int) -> int:
        if not masks:
            return ZERO
        if level == len(self.order):
            return self._leaf(masks[frozenset()])
        f = self.order[level]
        passed = {m: w for m, w in masks.items() if f not in m}
        failed = {m - {f}: w for m, w in masks.items() if f in m}
        return self._node(f, self._build(passed, level + 1), self._build(failed, level + 1))

    def _new(self, key: tuple, weight: Weight) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.weight)
            self.weight.append(weight)
        return self.ids[key]

    def _leaf(self, weight: Weight) -> int:
        return self._new((None, weight), weight)

    def _node(self, f: str, lo: int, hi: int) -> int:
        """The node of these edges; a filter without failures is left out."""
        if hi == ZERO:
            return lo
        below = tuple(a + b for a, b in zip(self.weight[lo], self.weight[hi]))
        made = self._new((f, lo, hi), below)
        self.nodes[made] = (f, lo, hi)
        return made

    def _edges(self, node: int, f: str) -> tuple[int, int]:
        mine = self.nodes.get(node)
        return mine[1:] if mine and mine[0] == f else (node, ZERO)

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next: only nodes of the two levels change.

        A node of the upper filter keeps its id, so whatever points to it stays as it is.
        """
        above, below = self.order[level : level + 2]
        self.order[level : level + 2] = below, above
        moved = []
        for node, (f, lo, hi) in self.nodes.items():
            if f == above:
                (lo_lo, lo_hi), (hi_lo, hi_hi) = self._edges(lo, below), self._edges(hi, below)
                if lo_hi != ZERO or hi_hi != ZERO:
                    moved.append((node, lo_lo, lo_hi, hi_lo, hi_hi))
        for node, *_ in moved:
            del self.ids[self.nodes[node]]
        for node, lo_lo, lo_hi, hi_lo, hi_hi in moved:
            changed = (below, self._node(above, lo_lo, hi_lo), self._node(above, lo_hi, hi_hi))
            self.nodes[node] = changed
            self.ids[changed] = node
        self._sweep()

    def _sweep(self) -> None:
        """Forget nodes that the root does not reach."""
        seen, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            if node in self.nodes and node not in seen:
                seen.add(node)
                todo += self.nodes[node][1:]
        for node in [n for n in self.nodes if n not in seen]:
            del self.ids[self.nodes.pop(node)]

    def steps(self) -> list[tuple[Weight, Weight]]:
        """Per filter of the order what stays after it and what it removes, along the all-pass path."""
        out, node = [], self.root
        for f in self.order:
            node, failed = self._edges(node, f)
            out.append((self.weight[node], self.weight[failed]))
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, lead through all orders of n things.

    The last thing walks through every gap of each order of the others; when it stands at an
    end, the others make their next swap.
    """
    if n < 2:
        return
    others, back = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        other = next(others, None)
        if other is None:
            return
        yield other + 1 if back else other
        back = not back


def all_steps(masks: dict[str, Weight], filters: str = FILTERS) -> dict[str, list[tuple[Weight, Weight]]]:
    """Steps of every order of ``filters``, by order."""
    diagram = Diagram(filters, masks)
    found = {filters: diagram.steps()}
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        found["".join(diagram.order)] = diagram.steps()
    return found


def audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The audit of one part from its mask counts (part, failed, n, good, toxic)."""
    masks = {r.failed: (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
    found = all_steps(masks)
    fails, alone, total = {}, {}, dict.fromkeys(FILTERS, 0)
    for order, steps in found.items():
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for f, (_, removed) in zip(order, steps):
            total[f] += removed[0]
    part = rows["part"].iloc[0]
    out = [
        (part, order, i + 1, stay[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], total[f])
        for order, steps in sorted(found.items()) for i, (f, (stay, gone)) in enumerate(zip(order, steps))
    ]
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def failures(text: Column) -> Column:
    """The filters of one text alone that it fails, in letters: words, variety, capitals, signs."""
    cut = F.btrim(text, F.lit(BLANKS))
    words = F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[\x20\x09-\x0D]+"))

    def letters(w: Column) -> Column:
        n = F.size(w).cast("long")
        tests = {
            "A": n < 200,
            "B": 100 * F.size(F.array_distinct(w)).cast("long") < 50 * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
            "D": F.rlike(text, F.lit("[#$%&*|]")),
        }
        return F.concat(*[F.when(t, F.lit(f)).otherwise(F.lit("")) for f, t in tests.items()])

    # The one-element array names the words, so that the text is split once.
    return F.get(F.transform(F.array(words), letters), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and the letters of the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = kept(docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("failed"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.length(text).alias("h3"),
    ), "filter-masks")
    same = ["h1", "h2", "h3"]
    # Repeated rows are counted before anything is joined, so that no id is a hot key by itself.
    rows = rows.groupBy("no_id", "id", "part", "failed", *same).agg(F.count("*").alias("n"))
    first = rows.groupBy(*same).agg(F.min(F.struct("no_id", "id")).alias("first")).select(
        *same, "first.no_id", "first.id", F.lit(True).alias("is_first"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(
        F.lit(False).alias("no_id"), F.col("doc_id").alias("spread"),
    ).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    # Rows without an id have no label; their hash spreads them.
    keyed = rows.withColumn("spread", F.when(F.col("no_id"), F.col("h1")).otherwise(F.col("id")))
    joined = keyed.join(marks, ["no_id", "spread"], "left").join(first, [*same, "no_id", "id"], "left")
    failed = F.concat("failed", F.when(F.col("is_first"), F.lit("")).otherwise(F.lit("E")))
    n = F.col("n")
    return joined.groupBy("part", failed.alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("quality", F.lit(0))).alias("good"),
        F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: what stays, goes, went before, and what each filter does in all.

    One row for each of the 120 orders and 5 steps of every part of ``docs``.
    """
    return mask_counts(docs, labels).groupBy("part").applyInPandas(audit_part, OUT)
