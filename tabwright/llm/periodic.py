"""Periodic runs of words by tiles of every scale.

A run is a stretch of words that repeats itself with a smallest period q at
least ``POWERS`` times, as long as it can be. Where a run of period q stands,
the words q apart are equal over an interval of at least (POWERS - 1) q places.

Periods are sorted into octaves: that of step S (2, 4, 8, ...) holds S/2 to
S - 1. Boundaries stand every S/2 words, so every interval of an octave holds a
boundary and S + 1 words that follow it, which must then stand again q words
later; a rolling hash tells which boundaries can be such and for which periods,
in time n for each octave. Boundaries that follow each other with a period in
common are a chain. A document is exploded into overlapping tiles, one for every
stretch of a chain of bounded length that begins with a period which the
boundary before it lacks. Tiles are dealt out on their own, whichever document
they come from, and solved by Z-functions from their boundary to both sides: how
far the words from the boundary agree with those q later, and those before it
with those before q later. What is found are fragments of intervals, cut at the
tile's ends; they are shuffled by document and period and stitched where they
touch. Of several periods of one stretch the smallest counts.

Rows without a boundary to look at, which is most of them, are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import whole_text, with_columns, written
from tabwright.llm.words import BETWEEN_WHITE, Numbering, raw_of

#: Least repetitions and least words of a run.
POWERS = 4
LEAST = 6
#: Words after which a tile ends, but for those of more than a quarter of it in step.
TILE = 1 << 13
#: Tiles that a task solves, beyond as many tasks as there are shuffle partitions.
TILES_PER_TASK = 20_000
#: Words that are searched for boundaries at once in a task, but for a text that has more.
CHUNK = 1 << 18
#: Word pairs compared at once.
COMPARED = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
WHITE = "[\\x09-\\x0D ]+"
TILES = "tiles array<struct<step:int,base:int,bound:int,codes:binary>>"


def gram_of(step: int) -> int:
    """Words after some boundary of every interval of an octave that lie in the interval."""
    gap = step // 2
    return max(LEAST, POWERS * gap) - 2 * gap + 1


def chains(numbers: np.ndarray, step: int, sums: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, last boundaries of their chains) where tiles begin.

    At a boundary the next ``gram_of`` words stand again a period of the octave
    later (or their hashes say so); it is listed where one of its periods is not
    the boundary's before. ``sums`` are the running sums of the words' hashes
    times ``powers``, so that a difference, shifted by a power, is a hash of the
    words between.
    """
    gap, gram = step // 2, gram_of(step)
    periods = np.arange(gap, step)
    last = len(numbers) - gram
    places = np.arange(0, max(0, last - gap + 1), gap)
    new, on = [], []
    before = np.zeros((1, len(periods)), dtype=bool)
    for low in range(0, len(places), max(1, COMPARED // gap)):
        c = places[low : low + max(1, COMPARED // gap)]
        later = c[:, None] + periods
        inside = later <= last
        later = np.minimum(later, last)
        same = inside & ((sums[c + gram] - sums[c])[:, None] * powers[periods] == sums[later + gram] - sums[later])
        before = np.concatenate([before[-1:], same])
        new.append((same & ~before[:-1]).any(axis=1))
        on.append((same & before[:-1]).any(axis=1))
    if not new:
        return places, places
    begins = np.flatnonzero(np.concatenate(new))
    breaks = np.append(np.flatnonzero(~np.concatenate(on)), len(places))
    return places[begins], places[breaks[np.searchsorted(breaks, begins, side="right")] - 1]


def tiles_of(coded: list[np.ndarray]) -> list[list[dict]]:
    """Per text its tiles: step, base (where the tile begins), bound (its boundary, from there), codes (its words)."""
    out: list[list[dict]] = [[] for _ in coded]
    longest = max(map(len, coded), default=0)
    if longest < LEAST:
        return out
    starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
    # A number of its own stands behind every text: nothing that holds it occurs twice.
    numbers = np.concatenate([np.append(c, -1 - k) for k, c in enumerate(coded)])
    mixed = numbers.astype(np.int64).view(np.uint64) * ODD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD
    powers = np.full(len(numbers), ODD, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mixed * powers, dtype=np.uint64))
    step = 2
    while max(LEAST, POWERS * step // 2) <= longest:
        gap, reach = step // 2, step // 2 + gram_of(step)
        wide = max(TILE, 4 * step) // gap * gap
        begins, ends = chains(numbers, step, sums, powers)
        for c, end in zip(begins.tolist(), ends.tolist()):
            k = int(np.searchsorted(starts, c, side="right")) - 1
            first, stop = int(starts[k]), int(starts[k]) + len(coded[k])
            for at in range(c, end + 1, wide):
                low, high = max(first, at - gap), min(stop, min(at + wide - gap, end) + reach + step)
                codes = np.ascontiguousarray(numbers[low:high], dtype="<i4").tobytes()
                out[k].append({"step": step, "base": low - first, "bound": at - low, "codes": codes})
        step *= 2
    return out


def z_function(words: list[int]) -> list[int]:
    """How far the words from every place agree with those from the first."""
    n = len(words)
    z = [n] * n
    low = high = 0
    for i in range(1, n):
        k = min(z[i - low], high - i) if i < high else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def solve(words: list[int], bound: int, step: int) -> list[tuple[int, int, int]]:
    """(period, first, end) of the tile's stretches of places around its boundary that equal those a period later."""
    ahead = z_function(words[bound:])
    before, n = words[:bound][::-1], min(len(words), bound + step)
    behind = z_function([*before, -1, *words[:n][::-1]])
    found = []
    for period in range(step // 2, min(step, len(ahead))):
        if ahead[period] >= gram_of(step):
            back = behind[len(before) + 1 + n - (bound + period)] if before else 0
            found.append((period, bound - back, bound + ahead[period]))
    return found


def _tiles_of_texts(texts: list[str | None]) -> list[list]:
    out, coded, size, numbering = [], [], 0, Numbering()
    for text in texts:
        coded.append(numbering.encode(raw_of(text), BETWEEN_WHITE))
        size += len(coded[-1])
        if size >= CHUNK:
            out += tiles_of(coded)
            coded, size, numbering = [], 0, Numbering()
    return [[*out, *tiles_of(coded)]]


def tiled(docs: DataFrame, text: str) -> DataFrame:
    """Every row of ``docs`` as ``row`` with its tiles."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return with_columns(rows, _tiles_of_texts, ["row"], [F.col(f"row.`{text}`")], TILES)


def stitched(fragments: DataFrame) -> DataFrame:
    """(place, start, length, period) of the runs that fragments (place, period, first, end) make up."""
    order = Window.partitionBy("place", "period").orderBy("first", "end")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") <= past, 0).otherwise(1)
    whole = (
        fragments.withColumn("opens", opens)
        .withColumn("stretch", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("place", "period", "stretch")
        .agg(F.min("first").alias("start"), F.max("end").alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + F.col("period"))
        .where(F.col("length") >= F.greatest(F.lit(LEAST), POWERS * F.col("period")))
    )
    # A stretch of a period that a smaller one divides is the same stretch for both.
    return whole.groupBy("place", "start", "length").agg(F.min("period").alias("period"))


def without_repeats(text: str | None, runs: list) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    spaced = np.frombuffer(raw_of(text).translate(BETWEEN_WHITE) + b" ", dtype=np.uint8)
    edges = np.flatnonzero(np.diff(spaced != 32, prepend=False)).reshape(-1, 2)
    drop = np.zeros(len(edges) + 1, dtype=np.int64)
    for run in runs:
        drop[run["start"] + run["period"]] += 1
        drop[run["start"] + run["length"]] -= 1
    kept = edges[np.cumsum(drop[:-1]) == 0]
    steps = np.zeros(len(spaced) + 1, dtype=np.int8)
    np.add.at(steps, kept[:, 0], 1)
    np.add.at(steps, kept[:, 1] + 1, -1)
    return spaced[np.cumsum(steps[:-1], dtype=np.int8) > 0].tobytes()[:-1].decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row``, with runs and collapsed.

    ``runs`` are (start, length, period) in words, by start and then period: the
    longest stretches with smallest period q of at least 6 and 4 q words; words
    are runs between ASCII white space, compared as they are. ``collapsed`` is
    the text's words joined by one space, without those that a run holds after
    its first q words.

    Null, empty and blank texts have no runs and collapse to an empty text. Rows
    may repeat, each is worked out on its own; an empty table gives an empty
    result. Columns may have any names. A text of any length is cut into tiles;
    its word numbers alone (4 bytes each) are held whole in one task.
    """
    cut = tiled(docs, text)
    some = F.size("tiles") > 0
    # Stored rows have a place that stays the same however often they are read.
    stored = written(cut.where(some).withColumn("place", F.monotonically_increasing_id()), "tiled")
    tiles = stored.select("place", F.explode("tiles").alias("t")).select("place", "t.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.itertuples(index=False):
                words = np.frombuffer(t.codes, dtype="<i4").tolist()
                rows += [(t.place, p, t.base + a, t.base + b) for p, a, b in solve(words, t.bound, t.step)]
            yield pd.DataFrame(rows, columns=["place", "period", "first", "end"])

    # Every tile is dealt out on its own: a long document is many tasks' work.
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(max(least, -(-tiles.count() // TILES_PER_TASK)), "place", "step", "base")
    fragments = dealt.mapInPandas(run, "place long, period int, first int, end int")
    by_start = F.struct(*(F.col(c).cast("long").alias(c) for c in ("start", "period", "length")))
    lists = stitched(fragments).groupBy("place").agg(F.array_sort(F.collect_list(by_start)).alias("found"))

    @F.pandas_udf("string")
    def collapse(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([without_repeats(t, r) for t, r in zip(texts, runs)], dtype=object)

    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    own = F.transform("found", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(kind)
    joined = stored.join(lists, "place", "left").select("row", F.coalesce(own, F.array().cast(kind)).alias("runs"))
    some_runs = joined.select("row", "runs", collapse(F.col(f"row.`{text}`"), "runs").alias("collapsed"))
    none = cut.where(~some).select(
        "row", F.array().cast(kind).alias("runs"), single_spaced(whole_text(f"row.`{text}`")).alias("collapsed")
    )
    return none.unionByName(some_runs)


def single_spaced(text: Column) -> Column:
    """The words joined by one space."""
    return F.trim(F.regexp_replace(text, WHITE, " "))
