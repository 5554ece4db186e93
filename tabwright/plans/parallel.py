"""Spreading small inputs over all cores before CPU-heavy row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that is smaller than one file split per core.

    Such an input arrives in fewer tasks than there are cores. Anything larger
    already has enough splits and is left alone, so the extra shuffle is bounded
    by cores x split size. Rows that were dealt out before, and have only been
    projected or filtered since, are not dealt out again.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName().startswith("Repartition"):
        return df
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
