"""Benchmark decontamination: SimHash windows, a multi-index over Hamming blocks, exact check.

Every benchmark item gets a 64-bit SimHash over its weighted shingles. In a document, windows
as long as an item in words are fingerprinted by differences of running sums. Fingerprints are
cut into blocks; two fingerprints within ``RADIUS`` bits differ by at most RADIUS // BLOCKS bits
in one block at least, so a table of all block values within that distance of an item's block
gives every item in the radius (the guarantee of multi-index hashing). Candidates inside the
radius are verified by weighted Jaccard similarity of their shingles.

A window that is similar enough shares a shingle with the item, so only windows over a place
where a shingle of some item occurs are fingerprinted; nothing that could be verified is left
out. Words are compared in lower case without punctuation. Shingles weigh by the inverse
document frequency in the benchmark, a statistic of the item set.

Items of fewer than five words have one shingle of all their words; items without words match
nothing. Nulls count as empty texts. Repeated rows and items each have results of their own.
Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import lower, shingles, slices, span_hashes, word_spans

SHINGLE, LEAST = 5, 0.8
BITS, BLOCKS = 64, 8
#: Bits that may differ. A window of similarity 0.8 differs by about 10 bits from its item,
#: with a standard deviation of 3.
RADIUS = 19
#: Windows of a text that are fingerprinted at a time.
WINDOWS = 4_096
#: Items that one index holds; a larger benchmark is worked through in groups of this size.
ITEMS = 2_000

_KEEP = np.ones(256, dtype=bool)
_KEEP[[c for c in range(33, 128) if not chr(c).isalnum()]] = False


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case without ASCII punctuation, and the rows' new offsets."""
    keep = _KEEP[data]
    before = np.concatenate(([0], np.cumsum(keep)))
    data, offsets = lower(data[keep]), before[offsets]
    # Upper-case letters of the Latin-1 block, two bytes each.
    after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[after] += 0x20
    return data, offsets


def _shingled(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, first shingle per row, word hashes, first word per row."""
    data, offsets = normal(data, offsets)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    hashes, begin = shingles(words, first, size)
    return hashes, begin, words, first


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 by the bits of each hash (rows x BITS)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of summed signs, as eight blocks of eight bits each."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Index:
    """Items of one group: shingles with weights, fingerprints, and the block tables."""

    ids: list[int]
    lengths: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    owners: dict[int, list[int]]
    sets: list[dict[int, float]]
    prints: np.ndarray
    near: np.ndarray
    size: int
    least: float
    radius: int

    def candidates(self, prints: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, bits) within the radius: by the block tables, then by all bits."""
        close = np.zeros((len(prints), len(among)), dtype=bool)
        for b in range(BLOCKS):
            close |= self.near[b][:, among][prints[:, b]]
        window, item = np.nonzero(close)
        bits = np.bitwise_count(prints[window] ^ self.prints[among[item]]).sum(axis=1)
        inside = bits <= self.radius
        return window[inside], among[item[inside]], bits[inside]


def _weight(counts: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / counts) + 1.0


def build(items: list[tuple[int, str]], shares: dict[int, int], n: int, size: int, least: float, radius: int) -> Index:
    """The index of one group of items; ``shares`` has the benchmark's count of each shingle."""
    texts = pa.array([t for _, t in items], pa.large_string())
    ids, lengths, owners, sets, sums = [], [], {}, [], []
    for lo, hi, data, offsets in slices(texts):
        hashes, begin, _, first = _shingled(data, offsets, size)
        for r in range(hi - lo):
            own = hashes[begin[r] : begin[r + 1]]
            if not len(own):
                continue
            weights = _weight(np.array([shares.get(int(h), 1) for h in own]), n)
            table: dict[int, float] = {}
            for h, w in zip(own.tolist(), weights.tolist()):
                table[h] = table.get(h, 0.0) + w
            for h in table:
                owners.setdefault(h, []).append(len(ids))
            ids.append(items[lo + r][0])
            lengths.append(int(first[r + 1] - first[r]))
            sets.append(table)
            sums.append((_signs(own) * weights[:, None]).sum(axis=0))
    prints = _packed(np.array(sums)) if sums else np.zeros((0, BLOCKS), dtype=np.uint8)
    known = np.array(sorted(owners), dtype=np.uint64)
    weights = _weight(np.array([shares.get(int(h), 1) for h in known]), n) if len(known) else np.zeros(0)
    # For each block and value, the items whose block is within radius // BLOCKS bits of it.
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None, None] ^ prints[None])
    near = np.ascontiguousarray((apart <= radius // BLOCKS).transpose(2, 0, 1))
    return Index(ids, np.array(lengths), known, weights, owners, sets, prints, near, size, least, radius)


def _jaccard(index: Index, item: int, own: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item and a window's shingles."""
    table: dict[int, float] = {}
    for h, w in zip(own.tolist(), weights.tolist()):
        table[h] = table.get(h, 0.0) + w
    other = index.sets[item]
    both = sum(min(w, table.get(h, 0.0)) for h, w in other.items())
    return both / (sum(table.values()) + sum(other.values()) - both)


def _runs(places: np.ndarray, span: int, n: int) -> Iterator[np.ndarray]:
    """Starts of the windows of ``span`` shingles that cover a place, in order, in pieces of at
    most ``WINDOWS`` that lie within as many shingles; ``n`` is the number of shingles."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.maximum(places - span + 1, 0), 1)
    np.add.at(change, places + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    starts = starts[starts + span <= n]
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + WINDOWS))
        yield starts[lo:hi]
        lo = hi


def search(index: Index, data: np.ndarray, offsets: np.ndarray, n_items: int) -> list[tuple[int, int, int, int, int, float]]:
    """(row, item id, first word, words, bits, similarity): the best window per row and item."""
    hashes, begin, words, first = _shingled(data, offsets, index.size)
    if not len(hashes) or not len(index.known):
        return []
    at = np.searchsorted(index.known, hashes)
    at[at == len(index.known)] = 0
    hit = index.known[at] == hashes
    rows = np.searchsorted(begin, np.flatnonzero(hit), side="right") - 1
    out = []
    for row in np.unique(rows):
        lo, hi = int(begin[row]), int(begin[row + 1])
        own, marks = hashes[lo:hi], hit[lo:hi]
        # Shingles of no item weigh as much as the rarest ones.
        weights = np.where(marks, index.weights[at[lo:hi]], _weight(np.array(1), n_items))
        here = sorted({i for h in np.unique(own[marks]).tolist() for i in index.owners[h]})
        n_words = int(first[row + 1] - first[row])
        places = np.flatnonzero(marks)
        for length in np.unique(index.lengths[here]):
            among = np.array([i for i in here if index.lengths[i] == length], dtype=np.int64)
            span = int(min(max(length - index.size + 1, 1), len(own)))
            best: dict[int, tuple] = {}
            for starts in _runs(places, span, len(own)):
                # Running sums over this stretch alone, so that a long text costs no more at a time.
                at_first = int(starts[0])
                signs = _signs(own[at_first : starts[-1] + span]) * weights[at_first : starts[-1] + span, None]
                sums = np.zeros((len(signs) + 1, BITS), dtype=np.float64)
                np.cumsum(signs, axis=0, out=sums[1:])
                prints = _packed(sums[starts - at_first + span] - sums[starts - at_first])
                for w, i, b in zip(*[x.tolist() for x in index.candidates(prints, among)]):
                    s = int(starts[w])
                    like = _jaccard(index, i, own[s : s + span], weights[s : s + span])
                    if like >= index.least and (i not in best or like > best[i][5]):
                        best[i] = (int(row), index.ids[i], s, min(int(length), n_words), int(b), float(like))
            out.extend(best.values())
    return out


def _indexes(benchmark: DataFrame, size: int, least: float, radius: int) -> tuple[list, int]:
    """Broadcast indexes over groups of ``ITEMS`` items, each of bounded size, and their number.

    The benchmark is the stated query set; every group of it meets all documents.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    listed = sorted(((r.item_id, r.text) for r in items.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    shares: dict[int, int] = {}
    for _, _, data, offsets in slices(pa.array([t for _, t in listed], pa.large_string())):
        hashes, begin, _, _ = _shingled(data, offsets, size)
        for r in range(len(begin) - 1):
            for h in np.unique(hashes[begin[r] : begin[r + 1]]).tolist():
                shares[h] = shares.get(h, 0) + 1
    context = benchmark.sparkSession.sparkContext
    groups = range(0, len(listed), ITEMS)
    return [context.broadcast(build(listed[g : g + ITEMS], shares, len(listed), size, least, radius)) for g in groups], len(listed)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, bits, similarity) of every document and item that match."""
    shared, n = _indexes(benchmark, size, least, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for lo, _, data, offsets in slices(batch.column("text")):
                for index in shared:
                    rows += [(lo + r, *rest) for r, *rest in search(index.value, data, offsets, n)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.float64())],
                names=["doc_id", "item_id", "start", "n_words", "bits", "similarity"],
            )

    kind = "doc_id long, item_id long, start long, n_words int, bits int, similarity double"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item; they are judged where they are read."""
    shared, n = _indexes(benchmark, size, least, radius)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, _, data, offsets in slices(batch.column(text)):
                for index in shared:
                    keep[[lo + r for r, *_ in search(index.value, data, offsets, n)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
