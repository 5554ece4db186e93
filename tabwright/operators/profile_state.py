"""Mergeable column states: profiles of appended data without reading what was profiled before.

A state is one row per column of a table: exact counts, extremes and moments, and
sketches of the distinct cells, the quantiles and the frequent cells. States of
parts of a table combine into the state of the whole, so a store of states keyed
by content hash answers for any set of its files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.plans.parallel import spread

#: Registers of the distinct sketch, as a power of two: a standard error of 1.04 / sqrt(2 ** 12), or 1.6 %.
DISTINCT_BITS = 12
#: Size of the quantile sketch: a rank is off by less than 0.7 % of the rows with 99 % confidence.
QUANTILE_SIZE = 400
#: Cells that the frequency sketch follows: counts are exact while a column has at most three quarters as many values.
FOLLOWED_CELLS = 1024
#: Characters from which a cell stands among the frequent ones by its beginning and hash.
LONG_CELL = 200


def _short(text: Column) -> Column:
    named = F.concat(F.left(text, F.lit(LONG_CELL)), F.lit("… "), F.hex(F.xxhash64(text)))
    return F.when(F.length(text) <= LONG_CELL, text).otherwise(named)


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: its state, from one aggregation that is combined before any shuffle.

    Missing cells are those of ``cells``; cells that are no finite number count
    in no moment, extreme or quantile. Columns may have any names; an empty
    table gives states of zero rows.
    """
    names = list(df.columns if columns is None else columns)
    fields = [cells.field_of(df, name) for name in names]
    # A cell is read once for all its sketches: an aggregate works its argument out by itself.
    read = spread(df.select(*(cells.column_ref(name) for name in dict.fromkeys(f.name for f in fields)))).select(
        *(cells.text_of(f).alias(f"t{i}") for i, f in enumerate(fields)), *(cells.number_of(f).alias(f"n{i}") for i, f in enumerate(fields))
    )
    states = []
    for i, name in enumerate(names):
        text, number = F.col(f"t{i}"), F.col(f"n{i}")
        number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
        followed = F.call_function("approx_top_k_accumulate", _short(text), F.lit(FOLLOWED_CELLS))
        states.append(
            F.struct(
                F.lit(name).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count(text).alias("present"),
                F.count(number).alias("n"), F.avg(number).alias("mean"),
                (F.var_pop(number) * F.count(number)).alias("spread"), F.min(number).alias("min"), F.max(number).alias("max"),
                F.hll_sketch_agg(text, DISTINCT_BITS).alias("distinct"),
                F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias("quantiles"), followed.alias("frequent"),
            )
        )
    return read.agg(F.array(*states).alias("states")).select(F.inline("states"))


def merge_states(states: DataFrame) -> DataFrame:
    """The states of the same column as one; what ``profile_state`` would give for all their rows, up to the sketches' bounds."""
    # The spread around the common mean is that within the parts and that of their means.
    common = F.sum(F.col("mean") * F.col("n")).over(Window.partitionBy("column")) / F.nullif(
        F.sum("n").over(Window.partitionBy("column")), F.lit(0)
    )
    shift = F.col("mean") - F.col("common")
    followed = F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(FOLLOWED_CELLS))
    return states.withColumn("common", common).groupBy("column").agg(
        F.sum("row_count").alias("row_count"), F.sum("present").alias("present"), F.sum("n").alias("n"),
        F.first("common").alias("mean"), F.sum(F.col("spread") + F.col("n") * shift * shift).alias("spread"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("quantiles"), followed.alias("frequent"),
    )


def profile_of(states: DataFrame, n: int = 5, places: int = 4) -> DataFrame:
    """The profile that states tell, one row per column.

    Exact: row_count, missing_count, missing_percent, n, min, max, mean, std
    (population). Within the bounds of the sketches: unique_estimate, q25,
    median, q75 and top_values (value, count), the most frequent ones first and
    ties by value; a cell that cannot be told from less frequent ones is not listed.
    """
    missing = F.col("row_count") - F.col("present")
    has = F.col("n") > 0
    ranks = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    # Missing cells are followed as well, as one value.
    top = F.filter(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(n + 1)), lambda x: x["item"].isNotNull())
    ranked = F.array_sort(F.transform(F.slice(top, 1, n), lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("value"))))
    return states.select(
        "column", "row_count", missing.alias("missing_count"),
        F.round(F.try_divide(missing, F.col("row_count")) * 100, 2).alias("missing_percent"),
        F.hll_sketch_estimate("distinct").alias("unique_estimate"), "n", "min", "max", F.round("mean", places).alias("mean"),
        F.round(F.sqrt(F.try_divide("spread", F.when(has, F.col("n")))), places).alias("std"),
        *(F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(r))).alias(name) for name, r in ranks.items()),
        F.when(F.col("present") > 0, F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("count")))).alias("top_values"),
    )


def store_state(df: DataFrame, content_hash: str, folder: str, columns: list[str] | None = None) -> None:
    """Keep the state of a file's rows below ``folder`` under its content hash; a hash that is there is replaced."""
    profile_state(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/content={content_hash}")


def stored_states(spark: SparkSession, folder: str, contents: list[str]) -> DataFrame:
    """The kept states of the named contents: a content named twice counts twice, one that is not there is an error."""
    parts = [spark.read.parquet(f"{folder}/content={content}") for content in contents]
    return reduce(DataFrame.unionByName, parts)
