"""Hard negatives, benchmark decontamination and periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import decontaminate, hard_negatives, periodic, queries, words

SCHEMA = "doc_id long, text string, source string, row string, tiles string, spans int, place int, `a.b` int"
EXTRA = (None, "r", "t", 1, 2, 3)
FOLDER = "/root/testdata/sf0.001"


# --- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    fit = [(i, str(label), [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, label, w in fit:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, w)), (label, w))
    out = []
    for a, (label, w) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(w, v)), i, m) for i, m, v in fit if i != a]
        for s, p in sorted((s, i) for s, i, m in scored if m == label)[:positives]:
            near = sorted((t, i) for t, i, m in scored if m != label and -50 * s <= -100 * t <= -95 * s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(near[:negatives], 1)]
    return sorted(out)


def vectors(n, seed, hot=0):
    """Nulls, non-finite components, shorter and empty vectors, repeated ids, one vector on many rows."""
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf")]
    rows = []
    for _ in range(n):
        v = [rng.choice(odd) if rng.random() < 0.003 else float(np.float32(rng.uniform(-1, 1))) for _ in range(rng.choice([12, 12, 12, 9, 0]))]
        rows.append((rng.randint(0, 500) if rng.random() > 0.02 else None, rng.choice([0, 0, 1, 2, None]), v if rng.random() > 0.02 else None))
    return rows + [(7, 0, [0.5] * 12)] * hot + [(100, 1, [0.375] * 12)] * 3


@pytest.mark.parametrize("blocks", [(2048, 256), (40, 3)])
def test_negatives_equal_brute_force(spark, blocks):
    rows = vectors(500, 1, hot=150)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, weights string")
    found = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, per_candidates=blocks[0], per_anchors=blocks[1])
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)


def test_look_ups_give_whole_scores():
    rng = np.random.default_rng(3)
    for low, high in ((-5, 5), (0, 1), (-40_000, 90_000), (-3, 0)):
        w, a = rng.integers(low, high, (50, 24)), rng.integers(low, high, (7, 24))
        sums = hard_negatives.subset_sums(hard_negatives.narrowest(a, len(hard_negatives.bit_planes(w))))
        assert (hard_negatives.look_up(sums, hard_negatives.bit_planes(w)) == w @ a.T).all()


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    alone = spark.createDataFrame([(50, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none, F.lit(True)).count() == 0
    assert hard_negatives.mine(alone, F.lit(True)).count() == 0


# --- decontamination


def normal(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(texts, items, size):
    windows = {}
    for item, text in items:
        w = normal(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).update([] if item is None else [str(item)])
    out = []
    for text in texts:
        w, hit, named = normal(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found is not None:
                    hit.update(range(i, i + n))
                    named |= found
        out.append((len(w), sorted(hit), sorted(named)))
    return out


def contaminated():
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "g4mma", "é", "naïve", "日本", "x"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([4, 9, 10, 25]))) for i in range(30)] + [(3, "Short One"), (None, "lost item"), (5, None), (6, " -- ")]
    items += [(100 + i, "a stock phrase that every item of a group shares word by word") for i in range(40)]
    texts = [prose(rng.choice([0, 5, 40, 300])) for _ in range(60)] + [None, "", "?!", "SHORT...one", "say: lost-item!", prose(20_000)]
    texts += [f"{prose(30)}\n{items[k][1].upper()}, {prose(5)}" for k in range(30)]
    texts += ["A stock phrase that every item of a group shares word by word"] * 50
    return [(i % 90 if i % 17 else None, t, *EXTRA) for i, t in enumerate(texts)], items


@pytest.mark.parametrize("slice_bytes", [decontaminate.SLICE_BYTES, 2000])
def test_hits_equal_brute_force(spark, slice_bytes):
    rows, items = contaminated()
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, benchmark, slice_bytes=slice_bytes).select("row.text", "n_words", "spans", "items").collect()
    got = sorted((r.text or "", r.n_words, [w for s in r.spans for w in range(*s)], list(r.items)) for r in found)
    want = brute_hits([r[1] for r in rows], items, decontaminate.SIZE)
    assert got == sorted((r[1] or "", *w) for r, w in zip(rows, want))


def test_what_is_removed(spark):
    rows, items = contaminated()
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    want = brute_hits([r[1] for r in rows], items, decontaminate.SIZE)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(r[1] or "" for r, w in zip(rows, want) if not w[1])
    cut = decontaminate.decontaminate(docs, benchmark, remove="spans")
    assert cut.columns == docs.columns
    left = [[w for k, w in enumerate(normal(r[1])) if k not in set(hits[1])] for r, hits in zip(rows, want) if not hits[1] or len(hits[1]) < hits[0]]
    assert sorted(map(tuple, (normal(r.text) for r in cut.collect()))) == sorted(map(tuple, left))
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, benchmark, remove="words")


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words", *EXTRA)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find(docs, none).drop("row").collect()] == [(2, [], [])]
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


# --- periodic runs


def brute_runs(w):
    n, smallest = len(w), {}
    for q in range(n // 4, 0, -1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                smallest[i, j - i + q] = q
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in smallest.items())


def collapsed(w, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repetitive(n, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        k, w = rng.choice([1, 2, 3, 5, 40]), []
        for _ in range(rng.randint(0, 5)):
            base = [str(rng.randrange(k)) for _ in range(rng.randint(1, 30))]
            w += base if rng.random() < 0.5 else (base * 9)[: rng.randint(1, 9 * len(base))]
        texts.append(rng.choice([" ", "\n", " \t\x0b"]).join(w))
    return texts


@pytest.mark.parametrize("tile", [periodic.TILE, 16])
def test_runs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE", tile)
    base = [str(k % 701) for k in range(2500)]
    texts = [*repetitive(150, 3), None, "", " \n ", " ".join(["a"] * 5000), " ".join(base * 2), "É É É É É É", *["b c " * 9] * 40]
    rows = [(i % 150 if i % 9 else None, t, *EXTRA) for i, t in enumerate(texts)]
    found = periodic.find_runs(spark.createDataFrame(rows, SCHEMA)).select("row.text", "runs", "collapsed").collect()
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w)
        want.append((t or "", runs, collapsed(w, runs)))
    assert sorted((r.text or "", [tuple(x) for x in r.runs], r.collapsed) for r in found) == sorted(want)


def test_a_long_text_of_one_long_period(spark):
    base = [f"w{k}" for k in range(9000)]
    w = ["x", *base * 4, "y"]
    row = periodic.find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 36_000, 9000)]
    assert row.collapsed == " ".join(["x", *base, "y"])


def test_runs_of_nothing(spark):
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query_follows_its_rule(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, row = brute_runs(w), got[r.doc_id]
        best = max(((length, -start, -q) for start, length, q in runs), default=None)
        want = (best[0], -best[1], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        assert (row.n_runs, (row.length, row.start, row.period, row.exponent_milli)) == (len(runs), want)
        lines = "".join(f"{start},{length},{q}\n" for start, length, q in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 7)
    raw = words.raw_of("one two\tthree  \x0bfour é five")
    assert [w for some in words.word_lists(raw, words.BETWEEN_WHITE) for w in some] == raw.split()
    numbering = words.Numbering()
    assert numbering.encode(b"b a b", words.BETWEEN_WHITE).tolist() == [0, 1, 0]
    assert numbering.words() == [b"b", b"a"]
