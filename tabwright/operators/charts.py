"""Data behind the profile charts: histogram, correlation, scatter, line."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import cells

# Chart sizes. A drawing shows 200 points; the operators return all unless asked for ``n``.
HISTOGRAM_BINS = 8
CHART_POINTS = 200
SCATTER_LEFT_COLUMNS = 3
SCATTER_COLUMNS = 4
SCATTER_PLOTS = 3
LINE_VALUE_COLUMNS = 2


def histogram(df: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, start, end, count): equal-width bins, the last one closed.

    A constant column gives one bin. The value ranges are a scalar subquery, so
    the second scan has nothing to join; only (column, bin) counts are shuffled.
    """
    narrow = df.select(*(cells.number_of(cells.field_of(df, c)).alias(f"v{i}") for i, c in enumerate(columns)))
    axes = range(len(columns))
    ranges = narrow.agg(
        F.struct(
            F.array(*(F.min(f"v{i}") for i in axes)).alias("lo"), F.array(*(F.max(f"v{i}") for i in axes)).alias("hi")
        )
    ).scalar()
    entries = [F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in axes]
    long = narrow.select(F.inline(F.array(*entries))).filter(F.col("v").isNotNull())
    lo, hi = F.get(ranges["lo"], F.col("c")), F.get(ranges["hi"], F.col("c"))
    scaled = (F.col("v") - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))
    index = F.when(hi > lo, F.least(F.floor(scaled), F.lit(bins - 1))).otherwise(0).cast("int")
    name = F.get(F.array(*(F.lit(c) for c in columns)), F.col("c"))
    counts = (
        long.groupBy("c", index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(name.alias("column"), "bin", "count")
    )
    axes = [
        F.struct(F.lit(c).alias("column"), F.get(ranges["lo"], F.lit(i)).alias("lo"), F.get(ranges["hi"], F.lit(i)).alias("hi"))
        for i, c in enumerate(columns)
    ]
    axis = (
        df.sparkSession.range(1)
        .select(F.inline(F.array(*axes)))
        .filter(F.col("lo").isNotNull())
        .select(
            "*",
            F.explode(
                F.when(F.col("lo") == F.col("hi"), F.array(F.lit(0))).otherwise(
                    F.sequence(F.lit(0), F.lit(bins - 1))
                )
            ).alias("bin"),
        )
    )
    width = (F.col("hi") - F.col("lo")) / bins
    constant = F.col("lo") == F.col("hi")
    start = F.when(constant, F.col("lo")).otherwise(F.round(F.col("lo") + F.col("bin") * width, 4))
    end = F.when(constant, F.col("hi")).otherwise(
        F.round(F.col("lo") + (F.col("bin") + 1) * width, 4)
    )
    # Both sides hold at most ``bins`` rows per column.
    return axis.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column",
        "bin",
        start.alias("start"),
        end.alias("end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    spread_x = F.stddev_pop(F.when(both, x))
    spread_y = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread_x * spread_y, F.lit(0.0)))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, correlation): the full Pearson matrix in long form, 4 places.

    Pairs use their own complete rows, so values of one row always meet.
    """
    if len(columns) < 2:
        raise ValueError("Correlation needs at least two numeric columns")
    values = {c: cells.number_of(cells.field_of(df, c)) for c in columns}
    pairs = [
        F.struct(
            F.lit(a).alias("left"),
            F.lit(b).alias("right"),
            F.round(_pearson(values[a], values[b]), 4).alias("correlation"),
        )
        for a, b in combinations(columns, 2)
    ]
    ones = [
        F.struct(
            F.lit(c).alias("left"),
            F.lit(c).alias("right"),
            F.when(F.stddev_pop(values[c]) > 0, F.lit(1.0)).alias("correlation"),
        )
        for c in columns
    ]
    upper = df.agg(F.array(*pairs, *ones).alias("m")).select(F.explode("m").alias("e"))
    mirrored = F.when(
        F.col("e.left") == F.col("e.right"), F.array(F.col("e"))
    ).otherwise(
        F.array(
            F.col("e"),
            F.struct(
                F.col("e.right").alias("left"),
                F.col("e.left").alias("right"),
                F.col("e.correlation").alias("correlation"),
            ),
        )
    )
    return upper.select(F.inline(mirrored))


def scatter_points(
    df: DataFrame, x: str, y: str, order_by: list[str], n: int | None = None
) -> DataFrame:
    """The points of a pair with both coordinates present; the first ``n`` of them, where given."""
    xv = cells.number_of(cells.field_of(df, x))
    yv = cells.number_of(cells.field_of(df, y))
    points = df.select(*order_by, xv.alias("x"), yv.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if n is not None:
        points = points.orderBy(*order_by).limit(n)
    return (
        points.select(F.lit(x).alias("x_column"), F.lit(y).alias("y_column"), "x", "y")
    )


def scatter_pairs(numeric_columns: list[str]) -> list[tuple[str, str]]:
    """Candidate pairs in plotting order."""
    left = numeric_columns[:SCATTER_LEFT_COLUMNS]
    return [
        (left[i], numeric_columns[j])
        for i in range(len(left))
        for j in range(i + 1, min(len(numeric_columns), SCATTER_COLUMNS))
    ]


def scatter_plots(df: DataFrame, numeric_columns: list[str], order_by: list[str], n: int | None = None) -> DataFrame:
    """Points of the first three pairs that have at least two points."""
    plots = None
    for rank, (x, y) in enumerate(scatter_pairs(numeric_columns)):
        points = scatter_points(df, x, y, order_by, n).withColumn("rank", F.lit(rank))
        plots = points if plots is None else plots.unionByName(points)
    if plots is None:
        raise ValueError("Scatter plots need at least two numeric columns")
    usable = (
        plots.groupBy("rank").count().filter("count >= 2").orderBy("rank").limit(SCATTER_PLOTS)
    )
    return plots.join(F.broadcast(usable.select("rank")), "rank", "left_semi")


def daily_line(df: DataFrame, date: str, value: str, n: int | None = None) -> DataFrame:
    """(x, y): daily sums of one column; of the ``n`` oldest days, where given.

    Series of a single day give no points.
    """
    at = cells.timestamp_of(cells.field_of(df, date))
    amount = cells.number_of(cells.field_of(df, value))
    days = (
        df.select(at.alias("at"), amount.alias("v"))
        .filter(F.col("at").isNotNull() & F.col("v").isNotNull())
        .groupBy(F.to_date("at").alias("day"))
        .agg(F.sum("v").alias("v"))
    )
    line = days.select(cells.day_label(F.col("day")).alias("x"), F.round("v", 4).alias("y"))
    enough = days.limit(2).agg(F.count(F.lit(1))).scalar() >= 2
    line = line.filter(enough)
    if n is not None:
        line = line.orderBy("x").limit(n)
    return (
        line.select(F.lit(date).alias("x_column"), F.lit(value).alias("y_column"), "x", "y")
    )


def line_charts(df: DataFrame, date_columns: list[str], numeric_columns: list[str]) -> DataFrame | None:
    """Daily lines of the first date column and the first two numeric columns."""
    if not date_columns or not numeric_columns:
        return None
    lines = [daily_line(df, date_columns[0], c) for c in numeric_columns[:LINE_VALUE_COLUMNS]]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def bar_values(top_values: DataFrame) -> DataFrame:
    """Bar chart data: the top values of each text column."""
    return top_values.select("column", "value", F.col("copies").alias("count"))
