"""Dense positions and lags over ordered rows without a single-task window.

A plain ``row_number() over (order by ...)`` moves the whole table into one task.
Here positions are offsets of bounded chunks plus a rank inside each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

CHUNK = 1 << 20
LAG_BLOCK = 1 << 16


def positions_by_label(
    df: DataFrame,
    keys: list[str],
    label: str,
    index: str,
    name: str = "pos",
    chunk: int = CHUNK,
) -> DataFrame:
    """0-based position of each row of a series ordered by (label, index).

    ``label`` has a bounded number of values (calendar days, files) and ``index``
    is a unique integer. A label holding any share of the rows is split by index
    range, so no window group exceeds ``chunk`` rows.
    """
    piece = F.floor(F.col(index) / F.lit(chunk))
    parts = [*keys, label, "_piece"]
    chunked = df.withColumn("_piece", piece)
    before = Window.partitionBy(*keys).orderBy(label, "_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        chunked.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*parts).orderBy(index)
    ranked = chunked.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        _null_safe_join(ranked, offsets, parts)
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank", "_piece")
    )


def positions_by_range(
    df: DataFrame, order: list[str], name: str = "pos", keys: list[str] | None = None
) -> DataFrame:
    """0-based position of each row ordered by ``order`` (unique within ``keys``).

    Works for any sort key. Rows are range partitioned, the partition number is
    written down once with a reliable checkpoint so that offsets and ranks see
    the same partitions, then counts per partition give the offsets.
    """
    keys = keys or []
    spread = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    parts = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        spread.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        _null_safe_join(ranked, offsets, parts)
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank", "_part")
    )


def file_order(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan 0, 1, ... in scan order."""
    tagged = df.withColumn("_seq", F.monotonically_increasing_id())
    return positions_by_range(tagged, ["_seq"], name=name).drop("_seq")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(
        *(F.col(k).alias(f"_r_{k}") for k in keys),
        *(c for c in right.columns if c not in keys),
    )
    condition: Column | None = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, "inner").drop(*(f"_r_{k}" for k in keys))


def with_lags(
    df: DataFrame,
    keys: list[str],
    pos: str,
    values: dict[str, tuple[str, int]],
    block: int = LAG_BLOCK,
) -> DataFrame:
    """Add ``alias -> lag(column, k)`` for every entry of ``values``.

    Rows are cut into position blocks; the last rows of a block are also sent to
    the next one, so each lag window is a bounded group whatever the length of
    the series.
    """
    reach = max(k for _, k in values.values())
    block = max(block, reach + 1)
    own = F.floor(F.col(pos) / F.lit(block))
    spill = F.col(pos) % F.lit(block) >= F.lit(block - reach)
    copies = df.withColumn(
        "_block", F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    lagged = copies.select(
        "*", *(F.lag(column, k).over(window).alias(alias) for alias, (column, k) in values.items())
    )
    return lagged.filter(F.col("_block") == own).drop("_block")
