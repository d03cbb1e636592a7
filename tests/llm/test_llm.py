"""Corpus operators against brute force, and on nulls, empty, long, repeated and clashing rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlsift.llm import (
    common, context_mixing, decontaminate, jaccard_join, line_dedup, mixing, quality_knn, quality_rules, sharding, text_mixing, token_ids, toxicity,
)

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, number string, score string, part string"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(n, seed):
    return " ".join(words(n, seed))


ROWS = [
    (1, prose(80, 1), "en", "a"), (2, prose(80, 1), "en", "b"),  # equal texts
    (3, prose(80, 1).rsplit(" ", 2)[0] + " other end", "en", "a"),  # near copy
    (4, None, "en", "a"), (5, "", None, None), (6, " \t\n ", "de", "b"), (7, "one two", "de", "a"), (8, "one two", "de", None),
    (9, prose(30_000, 2), "fr", "c"), (10, "x" * 50_000, "fr", "c"),
    (11, "same line\n" * 40, "en", "a"), (12, "é Été ÉTÉ ¶ ½ don't 3rd <|endoftext|> \x1f a b", None, "b"),
    (13, prose(90, 3), "en", "b"), (13, prose(90, 3), "en", "b"),  # a repeated row
    (14, prose(90, 4), "es", "b"), (14, prose(60, 5), "es", "b"),  # one id, two texts
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "x", "x", "x", "x") for i, t, lang, s in ROWS], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i != 11), int(i == 7)) for i in range(1, 15)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(80, 1)), (2, None), (3, "one two"), (4, prose(20, 77))], "item_id long, text string")


def test_every_operator_on_odd_rows_and_on_none(docs, empty, labels, bench, tmp_path):
    held = common.remainder(F.col("doc_id"), 10) == 0
    jobs = {
        "lines": line_dedup.clean, "join": jaccard_join.join, "rules": quality_rules.judge, "shards": sharding.shard, "mix": mixing.mix,
        "toxic": lambda d: toxicity.score(d, toxicity.learn(d, labels, F.lit(True))),
        "knn": lambda d: quality_knn.score(d, quality_knn.learn(d, labels, F.lit(True))),
        "lm": lambda d: context_mixing.score(d, held),
    }
    for name, job in jobs.items():
        got = job(docs).toPandas()
        assert len(got) == len(ROWS), name
        assert sorted(got["doc_id"].fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in ROWS), name
        assert len(job(empty).toPandas()) == 0, name
    assert len(decontaminate.matches(empty, bench).toPandas()) == 0
    assert len(decontaminate.matches(docs, bench.where("false")).toPandas()) == 0


def test_pipeline_stages_keep_columns(spark, docs, empty, labels, bench, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    for source in (docs, empty):
        source.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, source, folder)
            assert got.dtypes == source.dtypes, name
            assert got.count() <= 3 * len(ROWS)
        assert corpus_pipeline.run(spark, folder).count() >= 0
    kept = {(r.doc_id, r.text) for r in jaccard_join.distinct_documents(docs).collect()}
    assert (1, ROWS[0][1]) in kept and not any(i in (2, 3, 8) for i, _ in kept)
    assert len({t for i, t in kept if i == 14}) == 2 and jaccard_join.distinct_documents(docs).where("doc_id = 13").count() == 1
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean.isdisjoint({1, 2, 3, 7, 8}) and {4, 5, 6, 9, 10, 11, 12, 13, 14, None} <= clean


def test_lines_with_exact_counts_and_both_ways(spark):
    rng = random.Random(7)
    common_lines = [f"line {i} here" for i in range(30)]
    rows = []
    for i in range(300):
        lines = [f"own {i} {k}" for k in range(3)] + [x for k, x in enumerate(common_lines) if rng.random() < (k + 1) / 60] + [""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(f" {x}\r" if x and rng.random() < 0.3 else x for x in lines), None if i % 25 == 24 else f"s{i % 25}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in t.split("\n"):
            sites[x.strip(" \r")].add(s)
    want = {i: "\n".join(x for x in t.split("\n") if not x.strip(" \r") or len(sites[x.strip(" \r")]) < 10) for i, t, _ in rows}
    for limit in (1_000_000, 0):
        assert {r.doc_id: r.text for r in line_dedup.clean(frame, broadcast=limit).collect()} == want


def test_lines_on_many_sites_of_a_hot_source(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1_500):
        site = "hot" if i % 3 == 0 else f"s{rng.randint(0, 199)}"
        rows.append((i, "\n".join(["on all", *(f"line {k}" for k in range(12) if rng.random() < (k + 1) / 60), f"own {i}"]), site))
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in t.split("\n"):
            sites[x].add(s)
    for least in (1, 2, 60):
        got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=least).collect()}
        assert got == {i: "\n".join(x for x in t.split("\n") if len(sites[x]) < least) for i, t, _ in rows}


def test_toxic_words_through_disguise_and_exceptions(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        text = words(rng.randint(20, 80), i)
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilewort", "Vilewort!", "v1lewort", "vіlewоrt"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic), 1))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(d, lab, F.col("doc_id") < 300, exceptions=("vilewort garden",))
    got = {r.doc_id: r.score for r in toxicity.score(d, lexicon).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y, _ in marks)
    assert lexicon.matches(toxicity.folded("the Vilewort garden"))[1] == 0 and lexicon.matches(toxicity.folded("the vilewort"))[1] == 1


def test_toxic_words_beside_many_copies(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        text = words(rng.randint(20, 60), i)
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), "vilewort")
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    long = " ".join("".join(rng.choice(LETTERS) for _ in range(9)) for _ in range(2_500))
    rows += [(1000 + i, long, 1) for i in range(80)]  # copies
    rows += [(2000 + i, f"{long} {i}", 1) for i in range(80)]  # near copies
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"), F.lit(True))
    assert lexicon.matches(["viiewort"])[1] == 1 and len(lexicon.weights) < 50


def test_links_of_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = words(rng.choice([3, 8, 40, 150]), 100 + g)
        for _ in range(rng.randint(2, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[t] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    like = {t: sum(len(s & x) >= 0.8 * len(s | x) for u, x in sets.items() if u != t) for t, s in sets.items()}
    parent = {t: t for t in sets}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t, s in sets.items():
        for u, x in sets.items():
            if len(s & x) >= 0.8 * len(s | x):
                parent[find(t)] = find(u)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert all(got.n_links[i] == like[t] for i, t in rows)
    first = defaultdict(lambda: 10**9)
    for i, t in rows:
        first[find(t)] = min(first[find(t)], i)
    assert all(got.class_id[i] == first[find(t)] for i, t in rows)


def test_recall_by_similarity(spark):
    """Pairs of known similarity: as many shingles differ as words are new at the end of the copy."""
    rows, want = [], {}
    for i in range(1_000):
        text = words(124, i)
        for j, new in ((0, 0), (1, 1 + i % 18)):  # 120 shingles, of which 119 to 102 are shared
            rows.append((2 * i + j, " ".join(text[: 124 - new] + words(new, 10_000 + i))))
        want[2 * i] = (120 - new) / (120 + new)  # 0.98 to 0.74
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").n_links
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [got[i] == 1 for i, x in want.items() if low <= x < high]
        print(low, len(band), np.mean(band))
        assert len(band) > 50 and np.mean(band) >= 0.99, (low, np.mean(band))
    assert not any(got[i] for i, x in want.items() if x < 0.8)


def test_pruning_bounds_are_posterior_tails():
    for k, m in zip(range(jaccard_join.STEP, 200, jaccard_join.STEP), jaccard_join.least_matches()):
        grid = (np.arange(20_000) + 0.5) / 20_000
        for x, stays in ((m, True), (m - 1, False)):
            density = grid**x * (1 - grid) ** (k - x)
            assert (density[grid >= 0.8].sum() / density.sum() >= jaccard_join.TOLERANCE) == stays


def test_base_counts_and_outliers(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words(50, 1)) for _ in range(rng.randint(40, 120))) + ("\nsame line\nsame line" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100, " ".join(w + "###" for w in words(80, 9))), (101, None)]
    d = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(d).toPandas().set_index("doc_id")
    for i, t in rows:
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)]
        assert got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].tolist() == want
    assert not got.kept[100] and got.kept[[i for i in range(60) if not got.base_failed[i]]].all()


def test_outliers_by_one_feature_alone(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng.randint(60, 120), i)) for i in range(260)]
    text = words(100, 1000)
    rows.append((900, "".join(c + "#" * (i % 16 == 15) for i, c in enumerate(" ".join(text)))))  # symbols
    rows.append((901, "\n".join([*(rng.choice("abcd") for _ in range(40)), *(" ".join(words(40, 2000 + i)) for i in range(8))])))  # lines
    rows.append((902, " ".join([*text[:60], *text[:20], *text[60:80]])))  # words
    d = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(d).toPandas().set_index("doc_id")
    assert not got.base_failed.any() and got.kept[range(260)].all() and not got.kept[[900, 901, 902]].any()


def test_windows_of_items_with_changes(spark):
    item = words(40, 50)
    one = item[:20] + ["changed"] + item[21:]
    rows = [
        (1, " ".join(words(300, 51) + item + words(500, 52))), (2, " ".join(w.upper() + "," for w in item)), (3, " ".join(one[-38:])),
        (4, " ".join(item[:20])), (5, " ".join(words(400, 53))), (6, " ".join(["x"] + item[:39])),
    ]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(d, b).collect()}

    def like(a, b):
        x, y = ({tuple(s[j : j + 5]) for j in range(len(s) - 4)} for s in (a, b))
        return len(x & y) / len(x | y)

    assert set(got) == {1, 2, 6} and got[1].start == 300 and like(item, ["x"] + item[:39]) >= 0.8 > like(item, one[-38:])


def test_window_starts_and_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, span = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        places = np.flatnonzero(rng.random(n) < 0.1)
        monkeypatch.setattr(decontaminate, "WINDOWS", int(rng.integers(1, 9)))
        got = [s for run in decontaminate._runs(places, span, n) for s in run.tolist()]
        assert got == [s for s in range(n - span + 1) if ((places >= s) & (places < s + span)).any()]
    item = words(40, 50)
    text = " ".join(item[:30] + words(200, 54) + item + item[:20] + words(90, 55))
    rows = []
    for size in (3, 4096):
        monkeypatch.setattr(decontaminate, "WINDOWS", size)
        index = decontaminate.build([(9, " ".join(item))], {}, 1, 5, 0.8, 19)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        rows.append(decontaminate.search(index, data, np.array([0, len(data)]), 1))
    assert rows[0] == rows[1] and rows[0][0][2] == 230


def test_shards_spread_rows_of_one_id(spark):
    rows = [(None if i % 3 else i, f"t{i % 50}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sharding.shard(frame, shards=7).collect()]
    again = [tuple(r) for r in sharding.shard(frame.repartition(5), shards=7).collect()]
    order = lambda rs: sorted(rs, key=lambda r: r[-1])
    assert order(got) == order(again) and sorted(r[-1] for r in got) == list(range(300))
    ids = sharding.numbered(frame.where("doc_id IS NULL"), ["doc_id", "text"]).select("bucket").distinct().count()
    assert ids > 10


def test_shards_are_a_permutation(spark):
    for n in (1, 2, 39, 40, 41, 1000):
        got = sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))).toPandas()
        sizes = got.groupby("shard").slot.agg(["count", "max", "nunique"])
        assert sizes["count"].sum() == n and (sizes["count"] == sizes["max"] + 1).all() and (sizes["nunique"] == sizes["count"]).all()
        assert sizes["count"].max() - (sizes["count"].min() if n >= 40 else 0) <= 1
        assert (got["size"] == 18).all() and (got.text_crc32 == zlib.crc32(b"ab")).all()


def test_permutation_by_hand(spark):
    total, seed = 1000, 4
    rows = math.isqrt(total - 1) + 1
    columns, p = -(-total // rows), sharding.PRIME

    def mixed(half, key):
        x = (half + key) % p
        return ((x * x + key * 3 + 1) % p) ** 2 % p + half

    def place(v):
        while True:
            left, right = divmod(v, columns)
            for r in range(sharding.ROUNDS):
                key = (r * 7919 + seed * 104729 + 12345) % p
                if r % 2 == 0:
                    left = (left + mixed(right, key) % p) % rows
                else:
                    right = (right + mixed(left, key) % p) % columns
            v = left * columns + right
            if v < total:
                return v

    got = spark.range(total).select("id", sharding.permuted(F.col("id"), F.lit(total).cast("long"), seed).alias("v")).collect()
    assert all(r.v == place(r.id) for r in got) and len({r.v for r in got}) == total


def test_byte_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_ids.pack(x)
        assert len(control) == -(-n // 4) and (token_ids.unpack(control, data, n) == x).all()


def test_parts_are_encoded_as_by_the_whole_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    encoder, rng = token_ids.Encoder(public.path("word_bpe_49k.json")), random.Random(5)
    parts = ["word***", "naïve$$$", "a.b,c", "it's", "'s", "x'", "...", "1st!", "straße&&", "ä%<|", "<|endoftext|>", "<|endoftext|>."]
    for _ in range(3000):
        head = "".join(rng.choices("abzé'ß0Ж", k=rng.randint(0, 4)))
        parts.append(head + "".join(rng.choices(token_ids.MARKS.decode() + "'a", k=rng.randint(0, 5))))
    for p in filter(None, parts):
        assert encoder.part(p.encode()) == encoder.whole(p), p


def test_ids_of_letters_with_and_without_marks():
    """Every code point under U+0250, alone, doubled and with marks, in both cases, and mixed strings."""
    public = pytest.importorskip("public_tokenizers")
    encoder, rng = token_ids.Encoder(public.path("word_bpe_49k.json")), random.Random(8)
    chars = [chr(c) for c in range(1, 0x250)]
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x323, 0x327, 0x328, 0x331, 0x338, 0x345)]
    texts = chars + [c + "a" for c in chars] + ["a" + c for c in chars] + ["x" + c + m for c in chars for m in marks]
    texts += ["\u0130stanbul", "T\u0308", "J\u030C x", "H\u0331", "W\u030A", "Y\u030A.", "\u01C5", "\u03A3\u03A3", "A\u0323\u0308"]
    pool = chars + marks + list("aAeEtTyYwWhHjJ  ..'") * 8 + ["\u212B", "\u1E9E", "\u03A3", "\uFB01", "\U0001F600", "<|endoftext|>", "<|"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(20_000)]
    for t in texts:
        got = encoder.encode(token_ids.lowered(t.encode()).split())
        assert np.frombuffer(got, dtype=encoder.kind).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2], ascii(t)


def test_token_files(spark, docs, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    token_ids.write(docs, f"{tmp_path}/a", path, parts=3)
    got = token_ids.decoded(token_ids.read(spark, f"{tmp_path}/a"), token_ids.ranking(spark, f"{tmp_path}/a")).toPandas()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[(-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32)) == want
    got = got.sort_values("start")
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and got.doc_id.fillna(-1).is_monotonic_increasing
    token_ids.write(empty, f"{tmp_path}/b", path)
    assert token_ids.read(spark, f"{tmp_path}/b").count() == 0


def test_budget_fit_is_nearest():
    rng = random.Random(2)
    for _ in range(200):
        lengths = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        budget = rng.randint(0, 200)
        sums = {0}
        for x, c in lengths.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        got = mixing.fit(lengths, budget)
        assert all(0 < k <= lengths[x] for x, k in got.items())
        near = min(abs(s - budget) for s in sums)
        assert abs(sum(x * k for x, k in got.items()) - budget) == near
    large = {x: 50 for x in range(3, 3000, 7)}
    assert sum(x * k for x, k in mixing.fit(large, 12_345_678).items()) == 12_345_678


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, out, free = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, list(order)
    left = float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        out.update({s: most * sizes[s] if over else left * weight[s] / total for s in over or free})
        left, free = left - sum(out[s] for s in over), [s for s in free if s not in over] if over else []
    return out


@pytest.mark.parametrize("sizes", [
    {"b": 100, "a": 10, None: 1000, "c": 50}, {"a": 0, None: 0}, {None: 7}, {"\uffee": 5, "\U00010000": 90, "z": 0, "é": 900, None: 40},
    {f"s{i:03}": 3**(i % 12) for i in range(150)}, {},
])
def test_targets_share_and_stop(spark, sizes):
    rows = [(f"1{s}" if s is not None else "0", s, n) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "key string, source string, size long"), (5.0, 2.0, 1.0), 3.0).collect()
    want = plain_targets(sizes, (5.0, 2.0, 1.0), 3.0)
    assert len(got) == len(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.key[1:] if r.key != "0" else None], rel_tol=1e-9, abs_tol=1e-9) and r.target <= 3 * r.source_size + 1e-9
    assert math.isclose(sum(r.target for r in got), sum(sizes.values()), rel_tol=1e-9)


def test_names_of_helper_columns_may_be_taken(spark):
    names = ["row", "times", "time", "list", "copies", "tie", "id", "a", "b", "root", "keeper", "own_id", "own_a", "own_tie", "__id", "target"]
    rows = [(i, prose(80, i // 2), "s", *map(str, range(len(names)))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    once = sorted(tuple(r) for r in jaccard_join.distinct_documents(d).collect())
    assert once == rows[::2]
    assert sorted(tuple(r) for r in mixing.mixed_documents(d).collect()) == rows


def test_classifier_on_held_out_texts(spark):
    rows = [(i, prose(60, i) if i % 2 else " ".join(w + "##" for w in words(60, i))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality_knn.score(d, quality_knn.learn(d, lab, F.col("doc_id") < 100)).toPandas().set_index("doc_id").score
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(100, 200))


def test_language_model_counts_and_gain(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "HEAD", 50)  # most words take the joined way
    rng = random.Random(8)
    lists = {"en": words(300, 1), "de": words(300, 2)}
    rows = [(i, " ".join(rng.choice(lists[lang]) for _ in range(rng.randint(0, 120))), lang) for i in range(200) for lang in [rng.choice(["en", "de"])]]
    rows += [(900, None, None), (901, "Neverseen WORDS", "en")]
    held = common.remainder(F.col("doc_id"), 10) == 0
    got = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held).toPandas().set_index("doc_id")
    counts = Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").lower().split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        tokens = [*(t or "").lower().split(), ""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_language_model_does_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "GROUP", 100)  # several groups of words
    rows = [(i, prose(30 + i % 50, i % 40), "en") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held, found = common.remainder(F.col("doc_id"), 10) == 0, []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(context_mixing.score(docs.repartition(parts, "text"), held).toPandas().set_index("doc_id").sort_index())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (found[0].score - found[1].score).abs().max() < 1e-9


def test_language_model_reads_words_in_order(spark):
    """Words that follow each other in learnt texts cost less in that order than shuffled."""
    rng, names = random.Random(4), words(40, 3)
    follows = {w: rng.sample(names, 2) for w in names}

    def chain(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    rows = [(i, " ".join(chain(60)), "en") for i in range(300)]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    more = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(held)]
    for i, j in zip(held, more):
        rows.append((j, " ".join(rng.sample(rows[i][1].split(), 60)), "en"))
    got = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common.remainder(F.col("doc_id"), 10) == 0)
    got = got.toPandas().set_index("doc_id")
    for i, j in zip(held, more):
        assert abs(got.base_score[i] - got.base_score[j]) < 1e-6
        assert got.score[i] > got.score[j] + 10 and got.score[i] > got.base_score[i] + 10


def test_codes_of_tokens_are_a_distribution():
    """The chances of all tokens that may follow sum to one, at a text's start and after many blocks."""
    rng = np.random.default_rng(6)
    codes = text_mixing.Codes.of(rng.integers(1, 900, 70) ** 2)
    model = text_mixing.Model(codes, [rng.integers(-60, 60, 1 << log).astype(np.int8) for log in text_mixing.SLOTS])
    for before in (0, 1, 300):
        start = rng.integers(0, 70, before)
        texts = [np.append(start, t) for t in range(70)]
        logs = model.scores(np.concatenate(texts), np.arange(71) * (before + 1))
        given = model.scores(start, np.array([0, before]))[0]
        assert abs((10 ** (logs - given)).sum() - 1) < 1e-3
    assert text_mixing.Codes.of(np.array([3])).length.tolist() == [0]


def test_scores_of_texts_by_hand():
    """Batches give what a plain pass over one token after another gives."""
    rng = np.random.default_rng(9)
    codes = text_mixing.Codes.of(rng.integers(1, 900, 40) ** 2)
    tables = [rng.integers(-60, 60, 1 << log).astype(np.int8) for log in text_mixing.SLOTS]
    texts = [rng.integers(0, 40, n) for n in (0, 1, 9, 64, 65, 200, 500)]
    got = text_mixing.Model(codes, tables).scores(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for text, score in zip(texts, got):
        made = text_mixing.contexts(text, np.array([0, len(text)]), codes.rank)
        for i in range(len(text)):
            back = [codes.rank[t] for t in text[max(0, i - text_mixing.BACK) : i]]
            assert made[1][i] == common.mix(np.array([min(back, default=len(codes.rank) + 1) + 1], dtype=np.uint64))[0]
        w, bends, total, lo, width = np.ones(text_mixing.K), np.zeros(text_mixing.K), 0.0, 0, text_mixing.FIRST
        while lo < len(text):
            slopes = np.zeros(text_mixing.K)
            for i in range(lo, min(lo + width, len(text))):
                for bit, slots in text_mixing.planes(text[i : i + 1], [m[i : i + 1] for m in made], codes):
                    x = np.array([t[s[0]] for t, s in zip(tables, slots)]) * text_mixing.PART
                    p = 1 / (1 + math.exp(-np.clip(w @ x, -12, 12)))
                    total += math.log10(p if bit[0] else 1 - p)
                    slopes, bends = slopes + (bit[0] - p) * x, bends + p * (1 - p) * x * x
            w, lo, width = w + slopes / (text_mixing.K * bends + 100), lo + width, 2 * width
        assert abs(score - total) < 1e-4 * (1 + abs(total))


def test_bits_of_a_group_share_a_hash():
    """For its time the slots of a few bits are neighbours, and the tokens come back from their bits."""
    rng = np.random.default_rng(10)
    codes = text_mixing.Codes.of(rng.integers(1, 900, 70) ** 2)
    tokens = rng.integers(0, 70, 300)
    tokens = tokens[text_mixing.longest_first(tokens, codes)]
    made = [rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(text_mixing.K)]
    read, before = np.zeros(300, dtype=np.uint64), []
    for j, (bit, slots) in enumerate(text_mixing.planes(tokens, made, codes)):
        read[: len(bit)] |= bit.astype(np.uint64) << np.uint64(63 - j)
        for k, at in enumerate(slots):
            assert at.min() >= 0 and at.max() < 1 << text_mixing.SLOTS[k]
            if j % text_mixing.GROUP:
                assert (at >> text_mixing.GROUP == before[k][: len(at)] >> text_mixing.GROUP).all() and (at != before[k][: len(at)]).all()
        before = slots
    assert (read == codes.code[tokens]).all()


def test_places_of_hashes():
    rng = np.random.default_rng(11)
    near = (np.int64(5) << 50) + np.arange(0, 400, 2)  # one entry of the table has them all
    ends = np.array([-(1 << 63), 0, (1 << 63) - 1])
    hashes = np.unique(np.concatenate((rng.integers(-(1 << 63), (1 << 63) - 1, 5_000), near, ends)))
    found = np.concatenate((hashes, hashes[1:] - 1, rng.integers(-(1 << 63), (1 << 63) - 1, 5_000)))
    assert (context_mixing.Places(hashes).of(found) == np.searchsorted(hashes, found)).all()
    assert (context_mixing.Places(hashes[:0]).of(found) == 0).all()


def test_a_beginning_that_words_share_is_spelled_once(monkeypatch):
    """Same scores, weights and sums as word by word, from fewer bytes."""
    names = [w.encode() + end for w in words(60, 12) for end in (b"", b"s", b"ing")] + [b"", "\u00e9t\u00e9".encode()]
    model = context_mixing.fresh()
    model.counts = [np.random.default_rng(k).integers(0, 9, (1 << log, 2)).astype(np.float32) for k, log in enumerate(context_mixing.SLOTS)]
    frozen, seen, plain = model.freeze(), [], context_mixing._bits
    monkeypatch.setattr(context_mixing, "_bits", lambda data: seen.append(len(data)) or plain(data))
    got = frozen.word_scores(names)
    assert seen == [len({(w + b" ")[: i + 1] for w in names for i in range(len(w) + 1)})]
    assert np.abs(got - [frozen.word_scores([w])[0] for w in names]).max() < 1e-4

    once, each = context_mixing.Learner(model.counts), context_mixing.Learner(model.counts)
    once.step(names)
    monkeypatch.setattr(context_mixing, "edges", lambda context, data: (np.arange(len(data)), np.arange(len(data)), np.ones(len(data), dtype=np.int64)))
    each.step(names)
    assert np.abs(once.model.weights - each.model.weights).max() < 1e-6 and np.allclose(once.sums, each.sums, rtol=1e-4, atol=1e-3) and once.bits == each.bits


def test_spelling_is_a_distribution():
    """The chance of each next byte, closing blank included, sums to one."""
    model = context_mixing.fresh()
    model.counts = [np.random.default_rng(k).integers(0, 9, (1 << log, 2)).astype(np.float32) for k, log in enumerate(context_mixing.SLOTS)]
    frozen = model.freeze()

    logs = frozen.word_scores([b"", b"a", b"ab"])
    assert (logs < 0).all()
    data = np.arange(256, dtype=np.uint8)
    total = np.zeros(256)
    made = context_mixing.contexts(data, np.zeros(256, dtype=np.int64))
    for node, bit in context_mixing._bits(data):
        x, levels = [], []
        for k, (stretched, level) in enumerate(frozen.counts):
            at = context_mixing.slot(made[k], node, context_mixing.SLOTS[k])
            x.append(stretched[at].astype(np.float32)), levels.append(level[at])
        gate = levels[-1].astype(np.int64) * (len(context_mixing._LEVELS) + 1) + levels[-2]
        w = frozen.weights[gate]
        z = w[:, context_mixing.K] + sum(w[:, k] * x[k] for k in range(context_mixing.K))
        p = frozen.refined(context_mixing._squash(z), np.zeros(256, dtype=np.int64))
        total += np.log(np.where(bit, p, 1 - p))
    assert abs(np.exp(total).sum() - 1) < 1e-6

