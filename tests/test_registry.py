"""Registered queries against their SQL on the smallest tables.

``TABWRIGHT_ALL=1`` compares every query; by default one of each kind.
"""

import importlib
import os
from pathlib import Path

import oracle
import pytest

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
SQL = entry.oracle_sql()
SAMPLE = [
    "kpi_summary", "kpi_summary_text", "profile_types_text", "profile_quartiles_text", "profile_full", "histogram8",
    "correlation_long", "scan_documents", "scan_pages", "dedup_marks", "manifest_diff", "version_append", "event_metrics",
    "sql_recursive_cte", "sql_cube", "preset_join_shared", "row_selection_semi", "moving_average_by_user",
    "ar_forecast_by_user", "zscore_flags", "stream_event_windows", "similar_top_pairs", "knn_vote", "silhouette_labels",
    "class_report", "split_stratified", "features_standardised", "report_rows",
]
NAMES = sorted(SQL) if os.environ.get("TABWRIGHT_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_names():
    queries = entry.queries()
    assert set(SQL) <= set(queries) and len(queries) > 140


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 15
