"""Audit-log and request-log queries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOW_REQUEST_MS = 2000


def audit_filter(
    log: DataFrame, event_type: str | None = None, user_id: int | None = None, from_time=None, to_time=None,
    at: str = "created_at",
) -> DataFrame:
    """The rows that meet every condition asked for, as one predicate that reaches the scan."""
    tests = (
        (F.col("event_type").__eq__, event_type or None), (F.col("user_id").__eq__, user_id),
        (F.col(at).__ge__, from_time), (F.col(at).__le__, to_time),
    )
    conditions = [test(F.lit(value)) for test, value in tests if value is not None]
    return log.filter(reduce(and_, conditions, F.lit(True)))


def audit_page(
    log: DataFrame, page: int = 1, page_size: int = 50, at: str = "created_at", key: str = "id"
) -> DataFrame:
    """One page of an already filtered log, newest first, with the total count."""
    total = log.agg(F.count(F.lit(1))).scalar()
    rows = log.orderBy(F.desc(at), F.desc(key)).offset((page - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total)


def audit_for_file(log: DataFrame, file_id: int, file_hash: str) -> DataFrame:
    """Rows about a file by id or by content hash."""
    return log.filter((F.col("file_id") == file_id) | (F.col("file_hash") == file_hash))


def audit_count(log: DataFrame, event_type: str, action: str) -> DataFrame:
    return log.filter((F.col("event_type") == event_type) & (F.col("action") == action)).agg(
        F.count(F.lit(1)).alias("entries")
    )


def request_metrics(
    requests: DataFrame, status: Column, path: Column, duration_ms: Column, slow_ms: float = SLOW_REQUEST_MS
) -> DataFrame:
    """(metric, key, requests): total, slow, by status and by path.

    The log is reduced to (status, path) once; the metrics are grouping sets over
    that table.
    """
    base = requests.groupBy(status.cast("string").alias("status"), path.alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(duration_ms >= slow_ms).alias("slow")
    )
    keys = F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("n").alias("n")),
        F.struct(F.lit("slow").alias("metric"), F.lit("").alias("key"), F.col("slow").alias("n")),
        F.struct(F.lit("status").alias("metric"), F.col("status").alias("key"), F.col("n").alias("n")),
        F.struct(F.lit("path").alias("metric"), F.col("path").alias("key"), F.col("n").alias("n")),
    )
    return base.select(F.inline(keys)).groupBy("metric", "key").agg(F.sum("n").alias("requests"))
