"""Fingerprints, filter audit and period runs against brute force, on the given tables and on odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlsift.llm import common, filter_audit, fingerprints, period_runs, queries
from tests.llm.test_llm import KIND, ROWS, prose

DATA = Path("/root/testdata/sf0.001")
MORE = ROWS + [
    (20, "one two three " * 20, "en", "a"), (21, "a " * 300 + "b", "", "a"), (22, "x y " * 6 + "x y z " * 9 + "q", "de", "a"),
    (23, prose(80, 1), "fr", "a"), (10, prose(5, 9) + " $", "en", "a"), (30, "WORD " * 12 + "\x1f\x85\xa0 end", "en", "a"),
    (None, "", "en", "b"), (None, "no id here", "de", "a"), (31, "é" * 7, "en", "a"), (32, prose(2000, 8) + " " + prose(2000, 8), "fr", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "x", "x", "x", "x") for i, t, lang, s in rows], KIND)


def given(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    return common.read(spark, str(DATA), "documents")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- period runs --------------------------------------------------------------------------


def plain_runs(words, least=24, power=3):
    """All runs by comparing the words with themselves at every distance."""
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    seen, out = set(), []
    for q in range(1, len(codes) // 2 + 1):
        same = np.concatenate(([0], (codes[:-q] == codes[q:]).astype(np.int8), [0]))
        turns = np.diff(same)
        for s, e in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) + q):
            if e - s >= 2 * q and (s, e) not in seen:
                seen.add((s, e))
                if e - s >= max(least, power * q):
                    out.append((int(s), int(e - s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 2, 9, 40, 90]), rng.randint(1, 4)
            t = [rng.randint(0, k) for _ in range(n)]
            if n > 4 and rng.random() < 0.6:
                a, p = rng.randint(0, n // 2), rng.randint(1, n // 3 + 1)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        codes = common.mix(np.array([w for t in texts for w in t], dtype=np.uint64))
        first = np.cumsum([0] + [len(t) for t in texts])
        least, power = rng.choice([(24, 3), (2, 2), (7, 2), (5, 4)])
        got = list(zip(*(x.tolist() for x in period_runs.find_runs(codes, first, least, power))))
        assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, power)]


def test_long_runs_in_few_steps(monkeypatch):
    monkeypatch.setattr(period_runs, "LOOKUPS", 100)
    base = common.mix(np.arange(300, dtype=np.uint64))
    words = np.concatenate((common.mix(np.arange(1000, 1500, dtype=np.uint64)), np.resize(base, 20_000), np.zeros(5_000, np.uint64)))
    found = [x.tolist() for x in period_runs.find_runs(words, np.array([0, len(words)]))]
    assert found == [[0, 0], [500, 20_500], [20_000, 5_000], [300, 1]]


def test_run_query_on_all_rows(spark):
    common.ship(spark)
    for docs in (frame(spark, MORE), given(spark)):
        found = period_runs.digests(period_runs.collapse(period_runs.with_planted_runs(docs)))
        got = [tuple(r)[:8] for r in found.collect()]
        want = [plain_digest(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert sum(r[1] for r in got) > 3
    assert period_runs.collapse(frame(spark, [])).count() == 0


def test_collapsed_texts_and_spans(spark):
    common.ship(spark)
    rows = {r.doc_id: r for r in period_runs.collapse(frame(spark, [r for r in MORE if r[0] in (4, 7, 20, 21)])).collect()}
    assert rows[20].collapsed == "one two three" and [tuple(r) for r in rows[20].runs] == [(0, 60, 3)]
    assert rows[21].collapsed == "a b" and rows[21].n_words == 301
    assert rows[4].collapsed == "" and rows[4].n_words == 0 and rows[4].runs == []
    assert rows[7].collapsed == "one two" and rows[7].runs == []


# ---- filter audit -------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order by removing documents one filter at a time."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            ids[text or ""].append(i)
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        w, same = split(text), ids[text]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search("[#$%&*|]", text) is not None, "E": bool(same) and (i is None or min(same) < i),
        }
        parts[lang or ""].append((frozenset(f for f, bad in fails.items() if bad), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        mine, total = [], defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                all_fails = sum(f in r[0] for r in rows)
                mine.append((part, order, step, len(left), len(gone), all_fails - len(gone), sum(r[0] == {f} for r in rows),
                             sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return out


def test_swaps_lead_through_all_orders():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swapped_diagram_is_the_one_built_anew():
    rng = random.Random(2)
    for _ in range(20):
        masks = {"".join(m): (rng.randint(1, 9), 1, 0) for r in range(6) for m in itertools.combinations("ABCDE", r) if rng.random() < 0.4}
        diagram = filter_audit.Diagram("ABCDE", masks)
        for level in filter_audit.adjacent_swaps(5):
            diagram.swap(level)
            fresh = filter_audit.Diagram("".join(diagram.order), masks)
            assert diagram.steps() == fresh.steps() and len(diagram.nodes) == len(fresh.nodes)


def test_audit_on_all_rows(spark):
    common.ship(spark)
    marks = [(i, int(i != 11), int(i == 7)) for i in range(1, 24)] + [(None, 1, 1), (3, None, None), (7, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, MORE), labels).collect()
    want = plain_audit([(i, t, lang) for i, t, lang, _ in MORE], marks)
    assert sorted(map(tuple, got)) == sorted(want)
    docs, labels = given(spark), common.read(spark, str(DATA), "labels")
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == sorted(want)
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0
    assert filter_audit.audit(docs.where("false"), labels).count() == 0


def test_audit_against_sql(spark):
    import duckdb

    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = queries.queries()["op12_filter_audit"](spark, str(DATA))
    want = con.execute(queries.oracle_sql()["op12_filter_audit"]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want) and len(want) % 600 == 0


# ---- fingerprints -------------------------------------------------------------------------


def plain_sketch(text, k=fingerprints.K):
    def chain(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    w = split(text)
    grams = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    return sorted({chain(g) for g in grams})[:k]


def plain_share(a, b, k=fingerprints.K):
    sample = sorted(set(a) | set(b))[:k]
    return len([h for h in sample if h in set(a) and h in set(b)]) / len(sample) if sample else 1.0


def plain_fingerprints(docs):
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), seed=42) >= 1 << 63)
    rows = sorted(((i is not None, i or 0, signed(t or ""), t or "") for i, t in docs))
    pack = lambda s: base64.b64encode(b"".join(h.to_bytes(8, "big", signed=True) for h in s)).decode()
    out = []
    for at, (has_id, i, _, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][3]
        m = len(text) // 2
        changed = text[: len(text) - m] + after[:m]
        own, new, next_one = plain_sketch(text), plain_sketch(changed), plain_sketch(after)
        out.append((i if has_id else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), pack(own), pack(new),
                    plain_share(own, new), plain_share(own, next_one)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_on_all_rows(spark, parts):
    copies = MORE + [(13, prose(90, 3), "en", "b")] * 3
    for docs in [frame(spark, copies)] + ([given(spark)] if parts == 5 else []):
        got = fingerprints.compare_edits(docs.repartition(parts)).select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
        want = plain_fingerprints([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprints_of_one_row_of_none_and_of_many_copies(spark, monkeypatch):
    one = fingerprints.compare_edits(frame(spark, [(5, "a b c d e f", "en", "a")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert fingerprints.compare_edits(frame(spark, [])).count() == 0
    monkeypatch.setattr(fingerprints, "STEP", 3)
    many = fingerprints.compare_edits(frame(spark, [(5, "a b", "en", "a")] * 10 + [(6, "c d", "en", "a")])).collect()
    assert sorted((r.doc_id, r.near_next) for r in many) == [(5, 0.0)] + [(5, 1.0)] * 9 + [(6, 0.0)]


def test_parts_merge_and_estimates_hold(spark):
    halves = [(prose(3000, 1) + " " + prose(3000, 2)), (prose(3000, 1) + " " + prose(9000, 3))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(halves)], "doc_id long, text string")
    rows = fingerprints.fingerprints(docs).collect()
    exact = [len(set(zip(*(split(t)[j:] for j in range(5))))) for t in halves]
    for row, n in zip(sorted(rows), exact):
        assert abs(row.distinct_shingles / n - 1) < 4 / fingerprints.K**0.5
    pair = spark.createDataFrame([tuple(halves)], "a string, b string").select(
        fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = pair.select(
        fingerprints.resemblance(a, b), fingerprints.containment(a, b), fingerprints.containment(b, a),
        (fingerprints.unpacked(fingerprints.packed(a)) == a), fingerprints.containment(F.array().cast("array<bigint>"), b)).first()
    assert abs(got[0] - 0.2) < 0.15 and abs(got[1] - 0.5) < 0.25 and abs(got[2] - 0.25) < 0.2 and got[3] and got[4] == 1.0
    # Words of one text in parts that overlap by four words: the merged parts are the whole.
    w = split(halves[0])
    parts = [("x", " ".join(w[i : i + 504])) for i in range(0, len(w), 500)] + [("y", ""), (None, "a b c")]
    df = spark.createDataFrame(parts, "key string, text string").select("key", fingerprints.sketch(F.col("text")).alias("s"))
    merged = {r.key: r.s for r in fingerprints.merge_rows(df, ["key"], "s").collect()}
    assert merged["x"] == plain_sketch(halves[0]) and merged["y"] == [] and len(merged[None]) == 1
