"""Benchmark decontamination with a broadcast set of normalised n-grams.

Every benchmark item gives its windows of ``size`` neighbouring normalised words
(an item of fewer words is one window as a whole). The set of distinct windows
is broadcast: words as numbers, a hash per window, the numbers themselves for
verification and the items of each window. Training texts are scanned whole:
their words become numbers, all their windows are hashed at once, those in the
set are verified number by number, and hit words and items are gathered per row.
Rows without a word of the benchmark cost one look-up a word and no more.

What is broadcast is bounded: (window, item) pairs are dealt by a hash into as
many slices as their bytes need at ``SLICE_BYTES`` a slice, whatever window or
item they come from, and the texts are scanned once per slice, each scan going
on from the last one's written rows. A benchmark within the bound, as all usual
ones are, is one slice and one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import with_columns, written
from tabwright.llm.words import ALPHANUMERIC, raw_of, word_lists

#: Words of a window.
SIZE = 10
#: Bytes of window and item texts that are broadcast at once.
SLICE_BYTES = 32 << 20
#: Words that are scanned at once in a task, but for a text that has more.
CHUNK = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^ ]+")
FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): windows as words joined by a space, items as strings (null where the item has no id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, whole in zip(batch["item"], batch["text"]):
                words = [w.decode("utf-8", "surrogatepass") for some in word_lists(raw_of(whole), ALPHANUMERIC) for w in some]
                starts = range(max(1, len(words) - size + 1)) if words else ()
                yield pd.DataFrame({"window": [" ".join(words[i : i + size]) for i in starts], "item": item}, dtype=object)

    base = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    return base.mapInPandas(run, "window string, item string").distinct()


class NgramSet:
    """Windows of the benchmark as numbers, found by their hash."""

    def __init__(self, windows: list[str], items: list[str | None]):
        self.names = sorted({i for i in items if i is not None})
        place = {name: n for n, name in enumerate(self.names)}
        of: dict[bytes, list[int]] = {}
        for window, item in zip(windows, items):
            of.setdefault(raw_of(window), []).extend([] if item is None else [place[item]])
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, list[tuple[list[int], list[int]]]] = {}
        for window, held in of.items():
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.split(b" ")]
            by_size.setdefault(len(numbers), []).append((numbers, held))
        self.tables = {size: self._table(rows) for size, rows in sorted(by_size.items())}

    @staticmethod
    def _table(rows: list[tuple[list[int], list[int]]]) -> tuple:
        numbers = np.array([n for n, _ in rows], dtype=np.int32)
        for seed in range(1, 1 << 16):
            hashes = NgramSet.hash_windows(numbers.T, seed)
            if len(np.unique(hashes)) == len(hashes):
                break  # no two windows of the set share a hash
        order = np.argsort(hashes)
        lists = [np.array(rows[i][1], dtype=np.int32) for i in order]
        shift = 64 - max(12, (16 * len(rows)).bit_length())
        known = np.zeros(1 << (64 - shift), dtype=bool)
        known[hashes >> np.uint64(shift)] = True
        bounds = np.append(0, np.cumsum([len(x) for x in lists]))
        return seed, shift, known, hashes[order], numbers[order], bounds, np.concatenate(lists)

    @staticmethod
    def hash_windows(columns, seed: int) -> np.ndarray:
        """A hash of every window, given its first words, its second words and so on."""
        out = np.full(len(columns[0]), seed, dtype=np.uint64)
        for column in columns:
            out ^= column.astype(np.uint64)
            out *= ODD
            out ^= out >> np.uint64(29)
        return out * ODD

    def encode(self, raw: bytes) -> np.ndarray:
        """The numbers of a text's words; 0 for words that the set lacks."""
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, w, repeat(0)), dtype=np.int32, count=len(w)) for w in word_lists(raw, ALPHANUMERIC)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, windows) of every verified occurrence in a sequence of numbers."""
        for size, (seed, shift, known, hashes, own, _, _) in self.tables.items():
            n = len(numbers) - size + 1
            if n <= 0:
                continue
            found = self.hash_windows([numbers[k : n + k] for k in range(size)], seed)
            places = np.flatnonzero(known[found >> np.uint64(shift)])
            at = np.minimum(np.searchsorted(hashes, found[places]), len(hashes) - 1)
            same = hashes[at] == found[places]
            places, at = places[same], at[same]
            same = (numbers[places[:, None] + np.arange(size)] == own[at]).all(axis=1)
            yield size, places[same], at[same]

    def items_of(self, size: int, windows: np.ndarray) -> set[int]:
        bounds, items = self.tables[size][5:]
        return {i for w in np.unique(windows).tolist() for i in items[bounds[w] : bounds[w + 1]].tolist()}


def scan(found: NgramSet, texts: list, spans: list, items: list) -> list[tuple]:
    """(n_words, spans, items) of every text, what earlier slices found (spans, items) included."""
    coded = [found.encode(raw_of(t)) for t in texts]
    bounds = np.cumsum([0, *(len(c) + 1 for c in coded)])
    # A zero stands behind every text: no window of the set holds one, so none reaches over it.
    numbers = np.zeros(bounds[-1], dtype=np.int32)
    steps = np.zeros(bounds[-1] + 1, dtype=np.int64)
    for code, low, old in zip(coded, bounds, spans):
        numbers[low : low + len(code)] = code
        for span in old:
            steps[low + span["first"]] += 1
            steps[low + span["end"]] -= 1
    named: dict[int, set[int]] = {}
    for size, places, windows in found.hits(numbers):
        np.add.at(steps, places, 1)
        np.add.at(steps, places + size, -1)
        rows = np.searchsorted(bounds, places, side="right") - 1
        for row in np.unique(rows).tolist():
            named.setdefault(row, set()).update(found.items_of(size, windows[rows == row] if len(texts) > 1 else windows))
    edges = np.flatnonzero(np.diff(np.cumsum(steps) > 0, prepend=False, append=False)).reshape(-1, 2)
    owner = np.searchsorted(bounds, edges[:, 0], side="right") - 1
    out = [(len(c), [], sorted({*old, *(found.names[i] for i in named.get(k, ()))})) for k, (c, old) in enumerate(zip(coded, items))]
    for row, (first, end) in zip(owner.tolist(), edges.tolist()):
        out[row][1].append((first - int(bounds[row]), end - int(bounds[row])))
    return out


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every row of ``docs`` as ``row``, with n_words, spans and items.

    ``spans`` are the hit words of the whole text as disjoint ascending [first,
    end) word numbers, ``items`` the distinct ids (as strings, ascending) of
    items of which a window occurs. Words are runs of digits, letters and all
    that is not ASCII, A-Z lower-cased.

    A null text has no words; a null or wordless item has no windows, and an
    item without id marks words but is not named. Rows, items and windows may
    repeat; an empty table on either side is no special case. Columns may have
    any names.
    """
    pairs = written(benchmark_windows(benchmark, size, item_id, item_text), "windows")
    weight = F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 8)
    slices = max(1, -(-(pairs.agg(weight).first()[0] or 0) // slice_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    empty = [F.array().cast("array<struct<first:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(row, *empty)
    for part in range(slices):
        if part:
            rows = written(rows.select("row", "spans", "items"), "scanned")
        chosen = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == part)
        held = chosen.toPandas()  # ``slice_bytes`` at most, but for the chance of the hash
        shared = docs.sparkSession.sparkContext.broadcast(NgramSet(held["window"].tolist(), held["item"].tolist()))

        def run(texts: list, spans: list, items: list, shared=shared) -> list[list]:
            found, out, low, size = shared.value, [], 0, 0
            for k, whole in enumerate(texts):
                size += len(whole or "") // 4 + 1  # words at most, about
                if size >= CHUNK or k == len(texts) - 1:
                    out += scan(found, *(x[low : k + 1] for x in (texts, spans, items)))
                    low, size = k + 1, 0
            return [list(column) for column in zip(*out)] or [[], [], []]

        rows = with_columns(rows, run, ["row"], [F.col(f"row.`{text}`"), F.col("spans"), F.col("items")], FOUND)
    return rows


def without_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = raw_of(text)
    places = [m.span() for m in WORD.finditer(raw.translate(ALPHANUMERIC))]
    out, at = [], 0
    for span in spans:
        out.append(raw[at : places[span["first"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without what occurs in the benchmark, all columns kept.

    ``remove="documents"`` drops every row with a hit; ``remove="spans"`` cuts
    the hit words (and what stands between neighbouring ones) out of the text
    and drops a row only where no word is left. Rows without a hit stay as they
    are. Nulls, repeats, empty tables and column names are as in ``find``.
    """
    found = find(docs, benchmark, text=text, **options)
    clean = F.size("spans") == 0
    if remove == "documents":
        return found.where(clean).select("row.*")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, s) if len(s) else t for t, s in zip(texts, spans)], dtype=object)

    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    left = found.where(clean | (hit < F.col("n_words"))).select("row", cut(F.col(f"row.`{text}`"), "spans").alias("left"))
    return left.select(*[F.col("left").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
