"""Exact order statistics of many columns in two scans, without a global sort.

Scan 1 finds, per column and wanted rank, a narrow value bracket around the rank
with mergeable quantile sketches (one result row whatever the table size). Scan 2
counts the rows left of, between and inside the brackets; only values inside a
bracket keep their identity, pre-aggregated per value, so a value repeated on a
third of all rows costs one record per task. The brackets are cut further into
equal-width cells, so the closing rank windows see bounded groups. The bracket
only steers the work: the result is exact for any data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
CELLS = 1024
# Below this size the bracket is the whole value range: a sketch bracket would be
# only a few ranks wide.
WHOLE_RANGE_ROWS = 200_000


@dataclass(frozen=True)
class Bracket:
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    n: int


def _brackets(values: dict[str, Column], df: DataFrame, fractions: list[float]) -> dict[str, Bracket]:
    slack = 3.0 / SKETCH_ACCURACY
    lows = [max(0.0, p - slack) for p in fractions]
    highs = [min(1.0, p + slack) for p in fractions]
    aggregates: list[Column] = []
    for i, value in enumerate(values.values()):
        aggregates.append(F.count(value).alias(f"n{i}"))
        aggregates.append(
            F.percentile_approx(value, [*lows, *highs], SKETCH_ACCURACY).alias(f"q{i}")
        )
        aggregates.append(F.min(value).alias(f"min{i}"))
        aggregates.append(F.max(value).alias(f"max{i}"))
    row = df.agg(*aggregates).first()
    found: dict[str, Bracket] = {}
    edge = 2 * slack
    k = len(fractions)
    for i, name in enumerate(values):
        if not row[f"n{i}"]:
            continue
        points = [float(x) for x in row[f"q{i}"]]
        n = row[f"n{i}"]
        whole = n < WHOLE_RANGE_ROWS
        # Near the ends the clamped rank may fall outside the sketch bracket.
        low = [row[f"min{i}"] if p <= edge or whole else x for p, x in zip(fractions, points[:k])]
        high = [row[f"max{i}"] if p >= 1 - edge or whole else x for p, x in zip(fractions, points[k:])]
        found[name] = Bracket(tuple(low), tuple(high), n)
    return found


def order_statistics(
    df: DataFrame, values: dict[str, Column], ranks, fractions: list[float]
) -> DataFrame:
    """Values at exact 1-based ranks: (column, n, rank, value).

    ``ranks(n)`` gives the wanted ranks for a column with ``n`` values and
    ``fractions`` the quantile positions those ranks lie next to.
    """
    spark = df.sparkSession
    df = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values.values())))
    values = {name: F.col(f"v{i}") for i, name in enumerate(values)}
    brackets = _brackets(values, df, fractions)
    schema = "column string, n bigint, rank bigint, value double"
    if not brackets:
        return spark.createDataFrame([], schema)
    wanted = [(c, b.n, int(r)) for c, b in brackets.items() for r in sorted(set(ranks(b.n)))]
    targets = spark.createDataFrame(wanted, "column string, n bigint, rank bigint")

    names = list(brackets)
    entries = [F.struct(F.lit(c).alias("c"), values[name].alias("value")) for c, name in enumerate(names)]
    long = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())

    def known(numbers: list[float]) -> Column:
        """The entry of a per-column constant list for the current row's column."""
        return F.get(F.array(*(F.lit(float(x)) for x in numbers)), F.col("c"))

    # Monotone segment number: odd inside a bracket, even between brackets.
    value, segment = F.col("value"), None
    for i in range(len(fractions)):
        below = value < known([b.lows[i] for b in brackets.values()])
        segment = F.when(below, 2 * i) if segment is None else segment.when(below, 2 * i)
        segment = segment.when(value <= known([b.highs[i] for b in brackets.values()]), 2 * i + 1)
    placed = long.withColumn("segment", segment.otherwise(2 * len(fractions)))
    cell = None
    for i in range(len(fractions)):
        widths = [(b.highs[i] - b.lows[i]) / CELLS for b in brackets.values()]
        usable = [w if 0 < w < float("inf") else float("inf") for w in widths]
        offset = (value - known([b.lows[i] for b in brackets.values()])) / known(usable)
        own = F.least(F.floor(offset), F.lit(CELLS - 1))
        at = F.col("segment") == 2 * i + 1
        cell = F.when(at, own) if cell is None else cell.when(at, own)
    inside = F.col("segment") % 2 == 1
    counted = (
        placed.select(
            "c",
            "segment",
            F.coalesce(cell, F.lit(0).cast("bigint")).alias("cell"),
            F.when(inside, value).alias("value"),
        )
        .groupBy("c", "segment", "cell", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("column", F.get(F.array(*(F.lit(n) for n in names)), F.col("c")))
        .drop("c")
    )
    before = Window.partitionBy("column").orderBy("segment", "cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = counted.groupBy("column", "segment", "cell").agg(F.sum("copies").alias("size"))
    offsets = cells.select(
        "*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    picked = F.broadcast(
        offsets.join(F.broadcast(targets), "column")
        .filter((F.col("offset") < F.col("rank")) & (F.col("rank") <= F.col("offset") + F.col("size")))
        .groupBy("column", "segment", "cell", "offset", "n")
        .agg(F.collect_list("rank").alias("ranks"))
    )  # at most one row per wanted rank
    running = Window.partitionBy("column", "segment", "cell").orderBy("value")
    upto = F.col("offset") + F.sum("copies").over(running)
    return (
        counted.join(picked, ["column", "segment", "cell"])
        .withColumn("upto", upto)
        .select("column", "n", "value", "upto", (F.col("upto") - F.col("copies")).alias("from"), F.explode("ranks").alias("rank"))
        .filter((F.col("from") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
        .select("column", "n", "rank", "value")
    )


def _exclusive_ranks(n: int) -> list[int]:
    """The two ranks around each exclusive quartile, and the middle of the data."""
    if n == 1:
        return [1]
    ranks = [(n + 1) // 2, n // 2 + 1]
    for i in (1, 2, 3):
        j = min(max(i * (n + 1) // 4, 1), n - 1)
        ranks += [j, j + 1]
    return ranks


def quartiles_exclusive(df: DataFrame, values: dict[str, Column], places: int = 4) -> DataFrame:
    """Per column: n, q25, median, q75 by the exclusive method (position i(n+1)/4)."""
    stats = order_statistics(df, values, _exclusive_ranks, [0.25, 0.5, 0.75])
    n = F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    def quartile(i: int) -> Column:
        j = F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 4), F.lit(1)), n - 1)
        delta = F.lit(i) * (n + 1) - j * 4
        spread = (at(j) * (4 - F.max(delta)) + at(j + 1) * F.max(delta)) / 4
        return F.round(F.when(F.max(n) == 1, F.max("value")).otherwise(spread), places)

    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    return stats.groupBy("column").agg(
        F.max("n").alias("n"),
        quartile(1).alias("q25"),
        F.round(middle, places).alias("median"),
        quartile(3).alias("q75"),
    )


def percentile_linear(df: DataFrame, value: Column, fraction: float) -> DataFrame:
    """One row: the percentile with linear interpolation at (n-1)*fraction."""

    def ranks(n: int) -> list[int]:
        low = int((n - 1) * fraction)
        return [low + 1, min(low + 2, n)]

    stats = order_statistics(df, {"v": value}, ranks, [fraction])
    position = (F.col("n") - 1) * F.lit(fraction)
    low = F.floor(position) + 1
    high = F.least(low + 1, F.col("n"))
    at_low = F.max(F.when(F.col("rank") == low, F.col("value")))
    at_high = F.max(F.when(F.col("rank") == high, F.col("value")))
    share = F.max(position - F.floor(position))
    return stats.agg((at_low + (at_high - at_low) * share).alias("percentile"))
