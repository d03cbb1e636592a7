"""Quality by nearest-neighbour voting over latent-semantic vectors.

Every text becomes a vector of term frequencies; terms are runs of three character classes
and a few marks of repetition and length, which tell prose from junk in any language. A
singular value decomposition of a bounded labelled sample gives the latent space; the sample's
vectors are broadcast. For every document the cosine with every sample vector is computed in
blocks, and the labels of the nearest ones vote, weighted by similarity.

Nulls count as empty texts; a vector without terms gets the share of good texts in the sample.
Without labels every score is 0.5. Other columns are passed by or through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.common import labelled, shingles, slices, span_hashes, word_spans

#: Most labelled texts in the sample, latent dimensions, neighbours that vote, texts in a block.
SAMPLE, DIMENSIONS, NEIGHBOURS, BLOCK = 6_000, 48, 15, 256

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#*$%&", b"|", b"<>", b"@_=/\\-"]
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
_K = len(_KINDS) + 1
MARKS = 24
TERMS = _K**3 + MARKS


def _repeats(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per row, the share of values that are copies of another one in the row."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    again = np.flatnonzero((v[1:] == v[:-1]) & (r[1:] == r[:-1])) + 1
    return np.bincount(r[again], minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term frequencies (rows x terms) of the texts in one slice."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    lengths = np.diff(offsets)
    if len(data) > 2:
        kind = _KIND[data]
        code = kind[:-2] * _K * _K + kind[1:-1] * _K + kind[2:]
        row = np.repeat(np.arange(n), lengths)
        whole = row[:-2] == row[2:]
        found = np.bincount(row[:-2][whole] * (_K**3) + code[whole], minlength=n * _K**3)
        out[:, : _K**3] = found.reshape(n, -1) / np.maximum(lengths - 2, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    marks = out[:, _K**3 :]
    if len(words):
        near = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
        marks[:, 0] = near / np.maximum(counts, 1)
        three, begin = shingles(words, first, 3)
        marks[:, 1] = _repeats(three, np.repeat(np.arange(n), np.diff(begin)), n)
        marks[:, 2] = _repeats(words, row, n)
        marks[:, 3] = np.bincount(row, weights=ends - starts, minlength=n) / np.maximum(counts, 1) / 20
    some = np.flatnonzero(counts)
    marks[some, 4 + np.minimum(np.log2(counts[some]).astype(int), MARKS - 5)] = 0.05
    return out


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, found: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; rows without terms stay zero."""
        v = (np.sqrt(found) * self.weights) @ self.axes
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(size > 0, size, 1)).astype(np.float32)

    def scores(self, found: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(found), self.prior)
        k = min(neighbours, len(self.labels))
        for lo in range(0, len(found) if k else 0, BLOCK):
            v = self.latent(found[lo : lo + BLOCK])
            cosine = v @ self.vectors.T
            at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(cosine, at, axis=1)
            weight = np.exp(20 * (near - 1)) * (near > 0)
            total = weight.sum(axis=1)
            vote = (weight * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1)
            out[lo : lo + BLOCK] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def _text_frequencies(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column):
        yield frequencies(data, offsets)


def learn(docs: DataFrame, labels: DataFrame, where: Column, bound: int = SAMPLE) -> Model:
    """The latent space and the labelled vectors of at most about ``bound`` texts."""
    sample = labelled(docs, labels, "quality", where, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for found in _text_frequencies(batch.column("text")) for x in found.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("y")], names=["x", "y"])

    got = sample.mapInArrow(run, "x binary, y int").orderBy("x", "y").toPandas()  # the bounded sample
    if not len(got):
        return Model(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.sqrt(np.stack([np.frombuffer(b, dtype=np.float16) for b in got["x"]]).astype(np.float32))
    y = got["y"].to_numpy(dtype=float)
    weights = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)) + 1
    x *= weights
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, :DIMENSIONS]
    model = Model(weights.astype(np.float32), axes.astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), y, float(y.mean()))
    v = x @ model.axes
    size = np.linalg.norm(v, axis=1, keepdims=True)
    model.vectors = (v / np.where(size > 0, size, 1)).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by SAMPLE and DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scores(f) for f in _text_frequencies(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, with all their columns, whose score is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scores(f) for f in _text_frequencies(batch.column(text))]
            yield batch.filter(pa.array(np.concatenate(out) >= least)) if out else batch

    return docs.mapInArrow(run, docs.schema)
