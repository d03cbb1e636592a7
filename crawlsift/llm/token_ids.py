"""Token ids in a byte-aligned variable-length file format with separate control bytes.

Ids are ranked by frequency over the corpus, so that common ids take one byte. Four ids share
a control byte of four 2-bit lengths; their 1 to 4 data bytes follow in a stream of their own.
Files are tables with one row per document, one folder per range of ``doc_id`` in ascending
order; within a folder rows are in (doc_id, text hash) order. Reading decodes whole batches with a
table over control bytes.

The tokenizer splits on white space, so a text's ids are the ids of its blank-separated parts;
parts are encoded on first sight and kept in a worker's table of bounded size. The tokenizer
composes letters with the marks after them before it lowers them, and some letters compose in
lower case only; so a text with such marks keeps its capitals until it gets there.

Nulls: a null text has only the end id; null ids sort first. Repeated rows are all written. An
empty table gives empty files. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.llm.common import partitions, slices, text_bytes

END = 2
#: Signs that close a word and are tokens apart from it: neither letters, digits nor apostrophes.
MARKS = b".,!?;:#*$%&|<>()[]{}+-=/_~^@\"\\`"
#: Letters of the plain and extended Latin blocks that stay letters when lowered; marks that could
#: be composed with them are in later blocks.
LATIN = [c for c in map(chr, range(0x180)) if c.isalpha() and c.lower().isalpha()]
#: Entries of a worker's tables.
CACHE = 600_000

# ---- the coding -----------------------------------------------------------------------------

#: For each control byte the lengths of its four ids, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned numbers under 2^32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = np.ones(len(ranks), dtype=np.uint8)
    most = max(1, (int(ranks.max(initial=0)).bit_length() + 7) // 8)
    for k in range(1, most):
        size += ranks >= 1 << 8 * k
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    cells = ranks.astype("<u2") if most <= 2 else ranks
    used = np.arange(cells.itemsize, dtype=np.uint8) < size[:, None]
    return control.tobytes(), cells.view(np.uint8)[used.ravel()].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` coded."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate((np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8))).astype(np.uint32)
    out = raw[at]
    for k in range(1, int(size.max()) if n else 0):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


# ---- the tokenizer --------------------------------------------------------------------------


class Parts(dict):
    """Parts and their coded ids; a part that is not there yet is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: bytes) -> bytes:
        self[part] = found = self.encode(part)
        return found


class Encoder:
    """Ids of blank-separated parts of a text as little-endian bytes, learnt on first sight.

    A part made of letters and closing marks is split there, as the tokenizer's own pattern
    does. Letters of the plain and extended Latin blocks that are still letters when lowered go
    straight to its byte alphabet, by a table, and its model. Every other part is encoded by the
    whole tokenizer as it stands.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): alphabet.pre_tokenize_str(c.lower())[0][0] for c in LATIN}
        self.latin = re.compile(f"[{''.join(LATIN)}]+").fullmatch
        self.kind = width(self.tokenizer)
        self.end = np.array([END], dtype=self.kind).tobytes()
        self.coded = [i.to_bytes(int(self.kind[-1]), "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts = Parts(self.part)
        self.letters: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def part(self, part: bytes) -> bytes:
        core = part.rstrip(MARKS)
        ends = len(core)
        found = self.letters.get(core) if ends else b""
        if found is None:
            text = core.decode()
            if core.isalpha():  # letters of ASCII only
                text = text.lower()
            elif self.latin(text):
                text = text.translate(self.alphabet)
            else:
                return self.whole(part.decode())
            if len(self.letters) > CACHE:
                self.letters = {}
            self.letters[core] = found = b"".join([self.coded[t.id] for t in self.model.tokenize(text)])
        if ends == len(part):
            return found
        marks = part[ends:]
        if marks not in self.letters:
            self.letters[marks] = self.whole(marks.decode())
        return found + self.letters[marks]

    def encode(self, parts: list[bytes]) -> bytes:
        """Ids of a text's parts and the end id."""
        if len(self.parts) > CACHE:
            self.parts.clear()
        return b"".join([*map(self.parts.__getitem__, parts), self.end])


def lowered(data: bytes) -> bytes:
    """``data`` with ASCII capitals lowered, unless that could change its ids.

    The tokenizer looks for its special strings before it lowers letters, and composes letters
    with combining marks (U+0300 to U+036F, which begin with these two bytes) before, too.
    """
    return data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()


def width(tokenizer) -> str:
    """The narrowest type for all ids."""
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tie, part, ids) of every row; ``part`` passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            ids = []
            for lo, hi, data, offsets in slices(batch.column("text")):
                whole = data.tobytes()
                whole = lowered(whole)
                ids += [encoder.encode(whole[offsets[i] : offsets[i + 1]].split()) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "tie", "part", "ids"])

    return docs.select("doc_id", "tie", "part", "text").mapInArrow(run, "doc_id long, tie long, part int, ids binary")


def frequencies(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n): occurrences of every id, the end ids included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind))
            if len(found) > len(total):
                total = np.concatenate((total, np.zeros(len(found) - len(total), dtype=np.int64)))
            total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """Upper ends of id ranges of about equal row counts; one number per range."""
    marks = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", marks, 10_000).alias("b")).first().b if marks else []
    return sorted(set(found or []))


def write(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None) -> None:
    """Encode all texts and write the files and the ranking under ``path``.

    Texts are encoded once, into a table in the shared folder; ranks come from its counts.
    """
    from tokenizers import Tokenizer

    spark, kind = docs.sparkSession, width(Tokenizer.from_file(tokenizer))
    ends = bounds(docs, parts or partitions(spark))
    part = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e < F.col("doc_id"))) if ends else F.lit(0)
    rows = docs.select(
        "doc_id", F.xxhash64(text_bytes(F.col("text"))).alias("tie"),
        F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)).cast("int").alias("part"), "text",
    )
    encoded(rows, tokenizer).write.option("compression", "zstd").parquet(f"{path}/plain")
    plain = spark.read.parquet(f"{path}/plain")
    ranking = frequencies(plain, kind).orderBy(F.desc("n"), "id").toPandas()  # at most the vocabulary
    ranks = np.zeros(int(ranking["id"].max()) + 1 if len(ranking) else 1, dtype=np.uint32)
    ranks[ranking["id"].to_numpy()] = np.arange(len(ranking), dtype=np.uint32)
    spark.createDataFrame(ranking.assign(rank=range(len(ranking)))[["rank", "id"]], "rank long, id long").write.parquet(f"{path}/ranking")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, control, data = [], [], []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), dtype=kind)
                c, d = pack(ranks[ids])
                counts.append(len(ids)), control.append(c), data.append(d)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["doc_id", "tie", "part", "n_tokens", "control", "data"],
            )

    coded = plain.mapInArrow(code, "doc_id long, tie long, part int, n_tokens long, control binary, data binary")
    sorted_ = coded.repartition(len(ends) + 1, "part").sortWithinPartitions("part", "doc_id", "tie")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids before each row within its range."""
        last, so_far = None, 0
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n_tokens").to_numpy()
            before = np.empty(len(n), dtype=np.int64)
            for p in np.unique(part):  # ranges come in order
                here = np.flatnonzero(part == p)
                so_far = so_far if p == last else 0
                before[here] = so_far + np.cumsum(n[here]) - n[here]
                so_far, last = int(before[here[-1]] + n[here[-1]]), p
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(before), *batch.columns[3:]], names=["doc_id", "part", "before", "n_tokens", "control", "data"])

    placed = sorted_.mapInArrow(place, "doc_id long, part int, before long, n_tokens long, control binary, data binary")
    placed.write.partitionBy("part").parquet(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, control, data) of all documents in the files under ``path``."""
    files = spark.read.schema("doc_id long, before long, n_tokens long, control binary, data binary, part int").parquet(f"{path}/ids")
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("k")).toPandas().sort_values("part")  # one row per range
    base = dict(zip(sizes["part"], sizes["k"].cumsum() - sizes["k"]))
    starts = F.create_map(*[F.lit(int(x)) for kv in base.items() for x in kv]) if base else None
    start = F.col("before") + (starts[F.col("part")].cast("long") if base else 0)
    return files.select("doc_id", start.alias("start"), "n_tokens", "control", "data")


def ranking(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each rank."""
    found = spark.read.parquet(f"{path}/ranking").toPandas().sort_values("rank")
    return found["id"].to_numpy(dtype=np.uint32)


def decoded(files: DataFrame, ids: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from coded rows."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for n, c, d in zip(batch.column("n_tokens").to_pylist(), batch.column("control"), batch.column("data")):
                crc.append(zlib.crc32(ids[unpack(c.as_buffer(), d.as_buffer(), n)].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
