"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwright.plans import registry  # noqa: E402
from tabwright.session import local_session, pin_utc  # noqa: E402

HEADLINE = (
    "kpi_summary",
    "kpi_summary_lines",
    "profile_numeric",
    "profile_quartiles_exclusive",
    "profile_types",
    "profile_full",
    "profile_duplicates_keys",
    "histogram8",
    "correlation_long",
    "daily_line",
    "scan_documents",
    "scan_pages",
    "dedup_by_hash",
    "manifest_diff",
    "version_numbers",
    "event_metrics",
    "sql_window_rank",
    "sql_left_join",
    "preset_group_count",
    "moving_average_by_user",
    "ar_forecast",
    "zscore_flags",
    "similar_top_pairs",
    "column_cosine",
    "knn_vote",
    "class_report",
    "regression_linear",
    "pca_components",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tabwright-bench")
    pin_utc(spark)
    queries, _ = registry.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
