"""Each operator against brute force, the library or SQL, and on awkward rows."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm import bpe, components, exact_dedup, fixity, line_spread, packing, passages, quality, queries, simhash, topk, url_trees

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, digest string, id long, row string, key string, place int, `a.b` int"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    extra = ("d", 1, "r", "k", 2, 3)
    long = prose(30_000, 1)
    texts = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, " \n\t"), (6, long), (6, long), (None, "lost"),
             (None, None), (7, prose(120, 2)), (8, prose(60, 3) + " " + prose(120, 2)), (9, "É é"), (9, "other"), (10, "x")]
    rows = [(i, t, None if i == 5 else f"s{(i or 0) % 3}", *extra) for i, t in texts]
    return [*rows, (11, "ALL\nNULL", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), con, queries.SQL[name]) is None


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- packing


def _spec(name):
    return queries.tokenizer_spec(name)


def test_packing_gives_every_piece_a_place(messy):
    spec = _spec("byte_bpe_50k.json")
    library = Tokenizer.from_str(spec)
    found = packing.pack_documents(messy, spec).collect()
    want = Counter()
    for doc_id, text, *_ in awkward():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in found) // 1024) + 1


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, _spec("byte_bpe_50k.json")).count() == 0


def test_cached_encoder_equals_the_library():
    spec = _spec("byte_bpe_50k.json")
    encoder, library, rng = packing.CachedEncoder(spec), Tokenizer.from_str(spec), random.Random(2)
    signs = [*"abz AB 'sé  \n\t\x1c\x85\xa0  3٣日😀!!#", "<|endoftext|>", "'re", " ", " the"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        ids = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert encoder.encode(text) == ids.tobytes(), repr(text)


def test_genetic_packing_improves_on_a_poor_start():
    lengths = sorted([600, 420, 300, 724, 512, 512, 700, 324, 200, 824, 100, 924] * 6, reverse=True)
    rng = random.Random(1)
    order = list(range(len(lengths)))
    rng.shuffle(order)
    poor = packing.best_fit(order, lengths, 1024)
    best = packing.evolve(lengths, [poor], 1024, "seed", generations=30, population=6)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in best)
    assert len(best) <= len(poor) and len(best) <= -(-sum(lengths) // 1024) + 1
    assert packing.as_bins(packing.as_numbers(best, len(lengths))) is not None


def test_packing_in_levels(spark):
    rows = spark.range(3000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(1024)) + 1).alias("length"))
    found = packing.pack(rows, 1024, shard_pieces=500).join(rows, "uid").collect()
    assert len({r.uid for r in found}) == 3000
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * -(-sum(r.length for r in found) // 1024)


def test_packing_of_pieces_that_never_fill_a_bin(spark, monkeypatch):
    levels, pack_shards = [], packing._pack_shards

    def seen(items, shards, *rest):
        levels.append(shards)
        return pack_shards(items, shards, *rest)

    monkeypatch.setattr(packing, "_pack_shards", seen)
    rows = spark.range(3000).select(F.col("id").alias("uid"), F.lit(600).cast("long").alias("length"))
    found = packing.pack(rows, 1024, shard_pieces=500).collect()
    assert len({r.uid for r in found}) == len({r.sequence_id for r in found}) == 3000
    assert len(levels) == 1 and max(Counter(r.sequence_id >> 20 for r in found).values()) <= 1.25 * 500


# --- quality


def test_quality_finds_junk_and_keeps_prose(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(5, 200), i).capitalize() + ".", 1) for i in range(300)]
    for i in range(300, 360):
        text = prose(rng.randint(20, 200), i)
        kind = i % 4
        bad = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), text.replace(" ", "### "), " ".join(["word"] * 80)][kind]
        rows.append((i, bad, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    found = quality.judge(docs).select("row.good", "kept").collect()
    assert sum(r.kept for r in found if r.good) >= 298
    assert sum(not r.kept for r in found if not r.good) >= 57


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs).select("row.doc_id", "kept").join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.98
    assert np.mean([not r.kept for r in judged if r.quality == 0]) > 0.9


def test_quality_of_awkward_rows(messy, nothing):
    found = quality.judge(messy).select("row.*", "quality", "kept").collect()
    assert len(found) == len(awkward())
    assert all(r.quality == 0 and not r.kept for r in found if not (r.text or "").strip())
    assert quality.keep_good(messy).columns == messy.columns
    assert quality.keep_good(nothing).count() == 0


def test_posteriors_know_the_good_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) for right in (0.95, 0.9, 0.6, 0.85)], axis=1)
    votes = np.where(votes, quality.BAD, quality.GOOD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    bad = dict(zip(map(tuple, patterns), quality.posteriors(patterns, counts.astype(float))))
    guess = np.array([bad[tuple(v)] >= 0.5 for v in votes])
    assert (guess == truth).mean() > 0.95


# --- fixity


def _record(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, payload binary")


def test_fixity_finds_each_kind_of_damage(spark):
    good = [(f"f{i % 7}", 70_000 * (i // 7), bytes([i % 250]) * 20) for i in range(400)]
    bad = [list(r) for r in good]
    bad[17][2] = b"damaged"
    gone = bad.pop(101)
    bad.append(["f9", 0, b"new"])
    found = fixity.audit(fixity.fixity_tree(_record(spark, good)), fixity.fixity_tree(_record(spark, [tuple(r) for r in bad])))
    assert {(r.file, r.offset, r.status) for r in found.collect()} == {
        (good[17][0], good[17][1], "changed"), (gone[0], gone[1], "missing"), ("f9", 0, "extra")
    }


def test_fixity_of_awkward_rows(spark):
    rows = [(None, None, None), ("f", 0, None), ("f", 0, b"x"), ("f", 0, b"x"), (None, None, b"")]
    same = fixity.audit(fixity.fixity_tree(_record(spark, rows)), fixity.fixity_tree(_record(spark, rows[::-1])))
    assert same.count() == 0
    fewer = fixity.audit(fixity.fixity_tree(_record(spark, rows)), fixity.fixity_tree(_record(spark, rows[:3] + rows[4:])))
    assert [(r.file, r.offset, r.status) for r in fewer.collect()] == [("f", 0, "changed")]
    empty = fixity.fixity_tree(_record(spark, []))
    assert fixity.audit(empty, empty).count() == 0
    assert fixity.audit(fixity.fixity_tree(_record(spark, rows)), empty).count() == 2


def test_warc_files_are_read_record_by_record(spark, tmp_path):
    import gzip

    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"y" * n) for n in (0, 5, 300)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(records[1] + b"WARC/1.1 cut off")
    found = fixity.read_warc(spark, str(tmp_path)).collect()
    by = {n: [bytes(r.payload) for r in sorted(found, key=lambda r: r.offset) if r.file == n] for n in {r.file for r in found}}
    assert by["a.warc"] == records and by["b.warc.gz"] == records
    assert by["c.warc"] == [records[1], b"WARC/1.1 cut off"]


def test_gzip_members_of_any_size_are_cut_where_they_end():
    import gzip

    rng = random.Random(8)
    records = [rng.randbytes(n) for n in (0, 1, fixity.SLICE - 30, fixity.SLICE, 3 * fixity.SLICE, 7)] * 3
    members = [gzip.compress(r) for r in records]
    starts = [sum(map(len, members[:k])) for k in range(len(members))]
    assert list(fixity.parse_records(b"".join(members))) == list(zip(starts, records))
    broken = b"".join(members[:5]) + members[4][:-9]
    assert list(fixity.parse_records(broken))[5:] == [(starts[5], members[4][:-9])]
    many = gzip.compress(b"x") * 50_000
    assert sum(1 for _ in fixity.parse_records(many)) == 50_000 and not list(fixity.parse_records(b""))


# --- passages


def _compact(hashes, bounds, least):
    out = set()
    for a, b in zip(bounds, bounds[1:]):
        for c in range(a, b):
            low = high = c
            while low > a and hashes[low - 1] > hashes[c]:
                low -= 1
            while high < b - 1 and hashes[high + 1] >= hashes[c]:
                high += 1
            if high - low + 1 >= least:
                out.add((c, low, high))
    return out


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        bounds = np.append(0, np.cumsum(rng.integers(1, 40, rng.integers(1, 6))))
        hashes = rng.integers(1, rng.choice([5, 50, 10**9]), bounds[-1]).astype(np.uint64)
        least = int(rng.integers(1, 12))
        found = passages.compact_windows(hashes, bounds, least)
        assert set(zip(*(f.tolist() for f in found))) == _compact(hashes.tolist(), bounds.tolist(), least)


def _words(text):
    return [w for w in re.split("[\t-\r ]+", (text or "").lower()) if w]


def _passage_docs():
    """30 texts, of which some share a passage of 55 words, exactly or with one word changed or added."""
    shared = prose(55, 900).split()
    docs = []
    for i in range(30):
        own = prose(150, 1000 + i).split()
        if i % 5 == 0:
            piece = list(shared)
            if i == 10:
                piece[27] = "changed"
            if i == 15:
                piece.insert(20, "added")
            own[40 + i : 40 + i] = piece
        docs.append((i, " ".join(own)))
    return docs


def test_passages_are_found_and_verified(spark):
    docs = _passage_docs()
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = {i: _words(t) for i, t in docs}
    shingle = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    for r in found:
        a = shingle(texts[r.doc_id][r.first_word : r.end_word])
        b = shingle(texts[r.other_doc_id][r.other_first_word : r.other_end_word])
        assert len(a & b) / len(a | b) >= 0.8 and r.end_word - r.first_word >= 50
    holders = {i for i in range(30) if i % 5 == 0}
    assert {r.doc_id for r in found} | {r.other_doc_id for r in found} == holders
    assert len({r.doc_id for r in found}) == len(holders) - 1


@pytest.mark.parametrize("size", [50, 52, 54, 60])
def test_an_edit_anywhere_in_a_passage_is_alike(size):
    """Wherever one word of a repeated passage is changed: similar where some window of 46 shingles is, by brute force."""
    rng = np.random.default_rng(size)
    for at in range(size):
        body = rng.integers(1, 1 << 60, size).astype(np.uint64)
        edited = body.copy()
        edited[at] = 7
        lead, tail, far, end = (rng.integers(1, 1 << 60, 40).astype(np.uint64) for _ in range(4))
        one = passages.shingles(np.concatenate([lead, body, tail]))
        other = passages.shingles(np.concatenate([far[:25], edited, end]))
        best = 0.0
        for i in range(len(one) - 45):
            j = i - 15
            if 0 <= j <= len(other) - 46:
                a, b = set(one[i : i + 46].tolist()), set(other[j : j + 46].tolist())
                best = max(best, len(a & b) / len(a | b))
        found = passages.alike(one, other, 46)
        assert bool(found) == (best >= 0.8) and best >= 0.8, (size, at, best)
        for a, b, c, d, score in found:
            x, y = set(one[a:b].tolist()), set(other[c:d].tolist())
            assert b - a >= 46 and score == pytest.approx(len(x & y) / len(x | y)) and score >= 0.8


def test_equal_texts_stand_behind_one(spark):
    """A thousand equal texts, a text that shares a passage with them, short equal texts: one row a copy, one passage link."""
    body = prose(120, 31)
    words = body.split()
    docs = [(i, body if i % 2 else body.upper()) for i in range(1000)] + [(2000, f"{prose(60, 32)} {' '.join(words[20:90])} {prose(60, 33)}")]
    docs += [(3000 + i, "too short to count") for i in range(5)] + [(4000, None), (4001, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = passages.repeated_passages(frame).collect()
    whole = [r for r in found if 2000 not in (r.doc_id, r.other_doc_id)]
    assert len(whole) == 999 and len({r.other_id for r in whole}) == 1 and len({r.id for r in whole}) == 999
    assert {(r.first_word, r.end_word, r.similarity) for r in whole} == {(0, 120, 1.0)}
    links = [r for r in found if 2000 in (r.doc_id, r.other_doc_id)]
    assert len(links) == 1 and links[0].id > links[0].other_id
    left = passages.cut_repeats(frame).collect()
    assert sum(" ".join(words[30:80]) in r.text.lower() for r in left if r.text) == 1
    assert sum(r.doc_id >= 3000 for r in left) >= 5


def test_cutting_repeats_leaves_one_copy(spark):
    docs = spark.createDataFrame([(i, t, len(t), i) for i, t in _passage_docs()], "doc_id long, text string, n_chars long, id int")
    cut = passages.cut_repeats(docs).collect()
    assert len(cut) == 30 and all(r.n_chars == len(r.text) for r in cut)
    piece = " ".join(prose(55, 900).split()[:20])
    assert sum(piece in r.text for r in cut) == 1
    untouched = dict(_passage_docs())
    assert all(r.text == untouched[r.doc_id] for r in cut if r.doc_id % 5)


def test_passages_of_stock_sentences_between_strangers(spark):
    """Two texts share a passage whose every sentence also stands in forty other texts."""
    stock = [prose(14, 5000 + k) for k in range(6)]
    docs = [(i, f"{prose(60, 6000 + i)} {stock[i % 6]} {prose(60, 7000 + i)}") for i in range(240)]
    for i in range(8):
        passage = " ".join(random.Random(i).sample(stock, 6))
        docs += [(1000 + 2 * i + k, f"{prose(40, 8000 + 2 * i + k)} {passage} {prose(40, 9000 + 2 * i + k)}") for k in (0, 1)]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    met = {frozenset((r.doc_id, r.other_doc_id)) for r in found}
    assert {frozenset((1000 + 2 * i, 1001 + 2 * i)) for i in range(8)} <= met
    assert all(min(pair) >= 1000 for pair in met)


def test_passages_of_a_family_of_edited_copies(spark):
    """Of every two of many edited copies that are clearly alike, the later one is found beside some copy."""
    base = prose(100, 77).split()
    docs, bodies = [], {}
    for i in range(60):
        rng = random.Random(i % 20)
        body = list(base)
        for k in rng.sample(range(12), 4):
            body[8 * k + 4] = f"edit{i % 20}x{k}"
        bodies[i] = body
        docs.append((i, " ".join([prose(30, 300 + i), *body, prose(30, 400 + i)])))
    shingle = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ids = {r.doc_id: r.id for r in frame.select("doc_id", passages.text_id("doc_id", "text").alias("id")).collect()}
    sets = {i: shingle(b) for i, b in bodies.items()}
    due = {max(i, j, key=ids.get) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    assert len(due) > 5 and due <= {r.doc_id for r in passages.repeated_passages(frame).collect()}


def test_windows_of_a_key_in_a_cell_are_one(spark):
    """A phrase said over and over gives a key at most one row per cell; all its places lie between first and last."""
    rng = np.random.default_rng(5)
    key, text, place = rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), rng.integers(0, 900, 3000)
    want = {}
    for k, t, p in zip(key.tolist(), text.tolist(), place.tolist()):
        want.setdefault((k, t, p // passages.STEP), []).append(p)
    found = list(zip(*(f.tolist() for f in passages.by_cell(key, text, place))))
    assert sorted(found) == sorted((k, t, min(ps), max(ps)) for (k, t, _), ps in want.items())
    none = np.zeros(0, dtype=np.int64)
    assert [len(f) for f in passages.by_cell(none, none, none)] == [0] * 4
    phrase = " ".join([prose(6, 21)] * 60)
    texts = spark.createDataFrame([(i, f"{prose(60, 22 + i)} {phrase}") for i in range(3)], "id long, text string")
    shared = passages.shared_windows(texts.select("id", passages.word_hashes(F.col("text")).alias("words")), 46)
    rows = passages.joint_windows(shared, 46, 5, range(2, 3)).collect()
    assert rows and len({(r.key, r.id, r.place // passages.STEP) for r in rows}) == len(rows)


def _cell_pairs(count):
    """Pairs of shingle cells that share stretches with edits, stock sentences or repeated phrases, or nothing."""
    rng = np.random.default_rng(9)
    for n in range(count):
        alphabet = int(rng.choice([8, 60, 1 << 30]))
        one = rng.integers(0, alphabet, rng.integers(46, 285)).astype(np.int32)
        other = np.concatenate([rng.integers(0, alphabet, 30), one[rng.integers(0, 40) : rng.integers(41, 285)], rng.integers(0, alphabet, 30)])
        other = other.astype(np.int32)[: passages.STEP + 92]
        other[rng.integers(0, len(other), rng.integers(0, 30))] = -5
        yield one, other


def test_hopeful_cells_hold_all_that_is_alike(spark):
    """Cells that leave are alike to no other; strangers who share a stock sentence do leave."""
    most, hits = passages.tolerated(46, 0.8), 0
    for one, other in _cell_pairs(1500):
        own = passages.fewest_own(one, np.setdiff1d(one, other), 46)
        windows = [one[k : k + 46] for k in range(max(1, len(one) - 45))]
        assert own == min(len(set(w.tolist()) - set(other.tolist())) for w in windows)
        if passages.alike(one, other, 46):
            hits += 1
            assert own <= most and passages.fewest_own(other, np.setdiff1d(other, one), 46) <= most
    assert hits > 100
    stock = list(range(10))
    rows = [(i, 0, 0, [1000 * i + k for k in range(60)] + stock + [1000 * i + k for k in range(100, 160)]) for i in range(1, 40)]
    rows += [(50 + i, 3, 530, [70_000 + k for k in range(60)] + stock) for i in range(2)]
    parts = spark.createDataFrame(rows, "id long, cell int, start int, part array<int>")
    assert {tuple(r) for r in passages.hopeful(parts, 46, 0.8).collect()} == {(50, 3), (51, 3)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The shuffle of a table that is stored goes with its write, not with the driver's garbage."""
    from tabwright.llm import common

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    stored = common.written(spark.range(5000).groupBy(F.col("id") % 7).count(), "sevens")
    assert stored.count() == 7 and spark.conf.get(common.CLEANUP) == "false"
    kept = tracker.shuffleStatuses().size()
    assert kept <= before + 1  # that of the count alone


def test_passages_of_awkward_rows(messy, nothing):
    found = passages.repeated_passages(messy).collect()
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in found} == {frozenset((7, 8))}
    kept = passages.cut_repeats(messy)
    assert kept.columns == messy.columns
    assert kept.count() >= len(awkward()) - 1
    assert passages.repeated_passages(nothing).count() == 0 and passages.cut_repeats(nothing).count() == 0
    assert passages.without_words(" a b  c\nd ", [(1, 3)]) == " a d " and passages.without_words("a b", [(0, 9)]) == ""


# --- lines


def test_line_spread_of_awkward_rows(spark, messy, nothing):
    lines = [(i, "common line\nown %d\n\n common line " % i, f"s{i % 5}") for i in range(10)]
    cut = line_spread.cut_spread_lines(spark.createDataFrame(lines, "doc_id long, text string, source string")).collect()
    assert all((r.lines, r.removed) == (4, 2) and r.clean_text == f"own {r.doc_id}\n" for r in cut)
    assert line_spread.cut_spread_lines(messy).count() == len(awkward())
    assert line_spread.cut_spread_lines(nothing).count() == 0


def test_line_spread_near_and_far_from_the_threshold(spark):
    rows = [(("x", n), f"s{k}") for n in (2, 3, 4, 5, 40, 3000) for k in range(n)]
    frame = spark.createDataFrame([(f"{a[0]}{a[1]}", s) for a, s in rows], "line string, site string")
    for threshold in (4, 41, 2900, 3001):
        found = {r.line for r in line_spread.spread_lines(frame, threshold).collect()}
        assert found == {f"x{n}" for n in (2, 3, 4, 5, 40, 3000) if n >= threshold}


# --- exact copies


def test_exact_copies_of_awkward_rows(spark, messy, nothing):
    found = exact_dedup.text_copies(messy, exact_dedup.fresh_index(spark), "one").collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in awkward():
        groups[lower_az(text)].append(doc_id)
    assert len(found) == len(awkward())
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == (max(ids) if ids else None)
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.drop_copies(messy, exact_dedup.fresh_index(spark), "one")
    assert kept.columns == messy.columns and kept.count() == len(groups)
    assert exact_dedup.text_copies(nothing, exact_dedup.fresh_index(spark), "one").count() == 0


def test_digest_index_remembers_earlier_batches(spark):
    index = exact_dedup.fresh_index(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "B"), (10, "c"), (11, "c")], "doc_id long, text string")
    exact_dedup.mark_copies(first, index, "one").collect()
    found = {r.doc_id: r for r in exact_dedup.mark_copies(second, index, "two").collect()}
    assert (found[9].keep_id, found[9].kept, found[9].group_size) == (3, False, 2)
    assert (found[11].kept, found[10].keep_id, found[10].group_size) == (True, 11, 2)
    exact_dedup.mark_copies(second, index, "again").collect()
    assert index.rows().count() == 3
    plan = index.unseen(exact_dedup.digest_groups(second.select("doc_id", exact_dedup.digest_of().alias("digest"))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


# --- SimHash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _near_groups(codes):
    forest = components.Forest(len(codes))
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= 3):
            forest.join(i, i + 1 + int(j))
    return forest.roots()


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: r for r in queries.op7_simhash(spark, FOLDER).collect()}
    rows = docs.select("doc_id", "text").collect()
    codes = np.array([_fingerprint(r.text) for r in rows], dtype=np.uint64)
    roots = _near_groups(codes)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    for r, code, root in zip(rows, codes, roots):
        assert (found[r.doc_id].fingerprint, found[r.doc_id].component_id) == (f"{int(code):016x}", least[root])


def _clusters(seed, groups=12, size=60):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 1 << 63, groups):
        for _ in range(size):
            code = int(base)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                code ^= 1 << int(bit)
            out.add(code)
    codes = np.array(sorted(out), dtype=np.uint64)
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return codes[np.argsort(rank)]


def test_gray_tree_links_equal_brute_force():
    codes = _clusters(1)
    forest = components.Forest(len(codes))
    for a, b in simhash.links_within(codes):
        assert bin(int(codes[a] ^ codes[b])).count("1") <= 3
        forest.join(a, b)
    assert np.array_equal(forest.roots(), _near_groups(codes))


def test_near_links_across_ranges(spark, monkeypatch):
    codes = _clusters(2)
    monkeypatch.setattr(simhash, "RANGE_ROWS", 64)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash.near_links(fps).collect()
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    forest = components.Forest(len(codes))
    for r in links:
        forest.join(at[r.a], at[r.b])
    assert np.array_equal(forest.roots(), _near_groups(codes))
    found = {r.node: r.root for r in components.components(simhash.near_links(fps)).collect()}
    signed = codes.view(np.int64)
    for root in np.unique(_near_groups(codes)):
        members = signed[_near_groups(codes) == root]
        if len(members) > 1:
            assert {found.get(int(m), int(m)) for m in members} == {int(members.min())}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(500)]
    odd = [(5, 5), (None, 7), (2000, 2001), (2001, 2000)]
    links = spark.createDataFrame(chain + star + odd, "a long, b long").repartition(7)
    found = {r.node: r.root for r in components.components(links).collect()}
    assert all(found[i] == 0 for i in range(1, 301)) and all(found[i] == 1000 for i in range(1001, 1501)) and found[2001] == 2000


def test_simhash_of_awkward_rows(messy, nothing):
    found = simhash.near_duplicates(messy).collect()
    assert len(found) == len(awkward())
    blank = {r.component_id for r in found if r.fp == 0}
    assert blank == {3}
    kept = simhash.drop_near(messy)
    assert kept.columns == messy.columns and kept.where("text is null or trim(text) = ''").count() <= 1
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near(nothing).count() == 0


# --- BPE


def test_bpe_equals_the_library(messy, nothing):
    spec = _spec("word_bpe_49k.json")
    own, library, rng = bpe.WordBpe(spec), Tokenizer.from_str(spec), random.Random(4)
    library.no_truncation()
    library.no_padding()
    signs = [*"abz ABZ'sté́İΣςßǅ  \n\t\x1c\x1f\x85\xa0​0٣½日本😀!!##İﬁẞ 　Ⅷ²", "<|endoftext|>", "<|startoftext|>", "'re", "n't"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    # Every code point that Python's Unicode tables lack, in a word of its own and between letters.
    newer = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and c < 0x30000]
    for low in range(0, len(newer), 20000):
        texts = [f"{c} a{c}B" for c in newer[low : low + 20000]]
        ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [own.encode(t) for t in texts] == ids
    long = "ab" * 4000 + "thing" * 2000
    assert own.encode(long) == library.encode(long, add_special_tokens=False).ids
    assert own.decode_text(own.encode("Héllo wörld")) == "héllo wörld"
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(messy, spec).collect())
    want = Counter()
    for doc_id, text, *_ in awkward():
        ids = library.encode(text or "", add_special_tokens=False).ids
        spelled = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want[(doc_id, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in spelled))] += 1
    assert found == want
    assert bpe.encode_documents(messy, spec).count() == len(awkward()) and bpe.round_trip(nothing, spec).count() == 0


# --- URLs


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://A.Example.NET/en/1?x=1#y"), (2, "http://example.com/de/"), (3, "http://shop.org/fr/x"), (4, "http://x.org/de/"),
        (5, None), (6, "no scheme/net/"), (7, "http://net/"), (8, "http://net"), (9, "http://badnet/"), (10, "ftp://a.net?u=http://b.org/fr/"),
        (11, "://é.ORG/fr/É#"), (12, ""), (12, ""), (None, "http://q.net/a"),
    ]
    pages = spark.createDataFrame([(*r, 0, "h") for r in rows], "page_id long, url string, verdict int, host string")
    found = {(r.page_id, r.host, r.path, r.rule) for r in url_trees.filter_urls(pages, queries.RULES).collect()}
    assert found == {
        (1, "a.example.net", "/en/1", "example.net/en/"), (2, "example.com", "/de/", "example.com/de/"), (3, "shop.org", "/fr/x", "org/fr/"),
        (4, "x.org", "/de/", None), (5, "", "", None), (6, "", "", None), (7, "net", "/", "net/"), (8, "net", "", None),
        (9, "badnet", "/", None), (10, "a.net", "", None), (11, "é.org", "/fr/É", "org/fr/"), (12, "", "", None),
        (None, "q.net", "/a", "net/"),
    }
    assert url_trees.filter_urls(pages.limit(0), queries.RULES).count() == 0


def test_url_trees_learn_held_out_urls(spark):
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        bad = rng.random() < 0.4
        host = f"{rng.choice(VOCABULARY)}.{'clicks' if bad else 'papers'}.{rng.choice(['com', 'org'])}"
        query = "?" + "&".join(f"{rng.choice('abc')}={rng.randint(1, 10**9)}" for _ in range(rng.randint(2, 5))) if bad else ""
        rows.append((f"http://{host}/{rng.choice(VOCABULARY)}/{i}{query}", bad))
    labelled = spark.createDataFrame(rows[:1600], "url string, blocked boolean")
    model = url_trees.UrlTrees.fit(labelled)
    rest = spark.createDataFrame(rows[1600:], "url string, blocked boolean")
    host, path = url_trees.host_and_path(F.col("url"))
    judged = model.judge(rest.withColumns({"host": host, "path": path})).collect()
    assert np.mean([(r.learned == "block") == r.blocked for r in judged]) > 0.95
    one = url_trees.UrlTrees.fit(labelled.where("blocked"))
    assert one.constant == "block" and url_trees.UrlTrees.fit(labelled.limit(0)).constant == "allow"


# --- search


def test_top_k_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (8, [-0.3, 0.0]), (9, [0.0, 2.0, 5.0]), (9, [0.0, 1.0, 5.0]), (None, [1.0, 1.0]), (50, [0.1, 0.2]), (50, [0.1, 0.2]), (100, None)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=4, per_candidates=3, per_queries=1).collect()
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for query, weights in ((0, [128, 64]), (50, [25, 51])):
        want = sorted((-sum(a * b for a, b in zip(weights, w)), i) for i, w in valid if i != query)[:4]
        assert [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == query] == want
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_tokenizer_files_are_a_parameter():
    assert public_tokenizers.path("word_bpe_49k.json") and _spec("word_bpe_49k.json").startswith("{")


@pytest.mark.parametrize("size", [3, 20_000_000])
def test_windows_that_no_head_verified_meet_their_whole_group(spark, monkeypatch, size):
    """Strangers in one large group: elections end without a span, and every pair of texts is still linked once."""
    monkeypatch.setattr(passages, "SLICE", size)
    monkeypatch.setattr(passages, "PIECE", 5)
    large = spark.createDataFrame([(7, i, 10 * i) for i in range(12)], "key long, id long, place int")
    schema = "id long, first_word int, end_word int"
    linked = lambda spans: sorted((r.other, r.id) for part in passages.rest(large, spans) for r in part.collect())
    assert linked(spark.createDataFrame([], schema)) == [(a, b) for a in range(12) for b in range(a + 1, 12)]
    # A verified window asks no more, but answers: text 3 stays a partner of the later ones.
    left = linked(spark.createDataFrame([(3, 0, 100)], schema))
    assert left == [(a, b) for a in range(12) for b in range(a + 1, 12) if b != 3]


def test_promising_stretches_hold_all_that_is_alike():
    """Every stretch of enough places with a large enough share of shingles that the other text may hold, and no other place."""
    rng = np.random.default_rng(8)
    for one, other in _cell_pairs(300):
        places = {k for a, b in passages.promising(one, np.setdiff1d(one, other), 46, 0.8) for k in range(a, b + 1)}
        assert all(set(range(a, b)) <= places for a, b, *_ in passages.alike(one, other, 46))
    for _ in range(100):
        part = rng.integers(0, rng.choice([4, 30, 10**6]), rng.integers(1, 50)).astype(np.int32)
        own = rng.choice(part, len(part) // 3)
        held = set()
        for a in range(len(part)):
            for b in range(a + 12, len(part) + 1):
                codes = set(part[a:b].tolist())
                if len(codes - set(own.tolist())) >= 0.8 * len(codes) - 1e-9:
                    held |= set(range(a, b))
        assert held == {k for a, b in passages.promising(part, own, 12, 0.8) for k in range(a, b + 1)}


def test_rest_asks_only_where_a_lesser_text_may_be_alike(spark):
    """Strangers who share a stock sentence with equal texts: the pairs left are those of the equal ones, not of all in the group."""
    stock = [7_000 + k for k in range(20)]
    rows = [(i, 0, 0, [1000 * i + k for k in range(60)] + stock + [1000 * i + k for k in range(100, 160)]) for i in range(1, 40)]
    rows += [(50 + i, 0, 0, [90_000 + k for k in range(60)] + stock + [1000 * (50 + i) + k for k in range(60)]) for i in range(3)]
    parts = spark.createDataFrame(rows, "id long, cell int, start int, part array<int>")
    hope = passages.chances(parts, 46, 0.8)
    found = {r.id: (r.early, [tuple(s) for s in r.stretches]) for r in hope.collect()}
    assert set(found) == {50, 51, 52} and found[50] == (True, []) and not found[52][0]
    assert found[51][1] == found[52][1] == [(0, 99)]
    windows = [(i, 70) for i in range(1, 40)] + [(i, place) for i in range(50, 53) for place in (70, 130)]
    large = spark.createDataFrame([(3, i, place) for i, place in windows], "key long, id long, place int")
    spans = spark.createDataFrame([(51, 0, 104)], "id long, first_word int, end_word int")
    linked = lambda hope: sorted((r.other, r.id) for part in passages.rest(large, spans, hope) for r in part.collect())
    assert linked(hope) == [(50, 52), (51, 52)]


@pytest.mark.parametrize("size", [1.0, 3e7])
def test_top_k_blocks_are_packed_rows(spark, size):
    """Exact scores in 32 and in 64 bits, ties and own ids included; neither lists of ids nor of weights are gathered on a heap."""
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 6)), 1) * size
    vectors[200:] = vectors[:100]
    vectors[:, 3] = np.where(rng.random(300) < 0.9, 0.0, vectors[:, 3])
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") % 7 == 0, k=5, per_candidates=40, per_queries=6)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    weights = np.floor(vectors * 256).astype(np.int64)
    want = set()
    for q in range(0, 300, 7):
        scores = weights @ weights[q]
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:5]
        want |= {(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in found.collect()} == want


def test_top_k_reads_all_queries_for_a_bounded_number_of_blocks():
    assert [topk._block_count(n, 8192) for n in (0, 8192, 8193, 786_432)] == [1, 1, 2, 96]
    assert topk._block_count(3_000_000, 8192) == 96 and topk._block_count(1 << 30, 8192) == 8192
