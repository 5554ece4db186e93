import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabwright.operators import charts, profile
from tabwright.operators import quantiles
from tabwright.operators.quantiles import percentile_linear, quartiles_exclusive

BEDS = """bed,crop,plants,season,remark
A,bean,4,spring,
B,leek,10,spring,NA
C,bean,7,autumn,"""


def test_profile_literal(text_table):
    rows = {r["column"]: r for r in profile.profile(text_table(BEDS), order_by="i").collect()}
    assert [r["inferred_type"] for r in sorted(rows.values(), key=lambda r: r["ordinal"])] == [
        "categorical", "categorical", "integer", "categorical", "string",
    ]
    n = rows["plants"]
    assert (n["min"], n["q25"], n["median"], n["q75"], n["max"], n["mean"], n["std"]) == (4, 4, 7, 10, 10, 7.0, 2.4495)
    assert rows["crop"]["unique_count"] == 2 and rows["remark"]["missing_count"] == 3
    assert [tuple(t) for t in rows["crop"]["top_values"]] == [("bean", 2), ("leek", 1)]
    assert rows["bed"]["samples"] == ["A", "B", "C"]


def test_warnings(text_table):
    df = text_table(BEDS + "\nC,bean,7,autumn,").drop("i")
    types = profile.column_types(df)
    got = {r["warning"] for r in profile.quality_warnings(types, profile.duplicate_rows(df), sampled_rows=100000).collect()}
    assert got == {
        "1 duplicate rows detected", "Column 'remark' is more than 50% missing", "Column 'remark' appears constant",
        "Large dataset sampled to first 100,000 rows for EDA",
    }


def test_suggestions(text_table):
    df = text_table("day,kilos,bed\n2023-05-02,4.5,N\n2023-05-09,6.25,S\n2023-05-16,7.5,N\n2023-05-23,5.75,N").drop("i")
    row = profile.suggestions(profile.column_types(df)).first()
    assert row["date_columns"] == ["day"] and row["feature_columns"] == ["kilos"] and row["target_columns"] == ["bed"]
    assert "time_series" in row["suggested_analyses"]


def test_boolean_rule_comes_first(text_table):
    types = {r["column"]: r["inferred_type"] for r in profile.column_types(text_table("a,b,c\n1,0,1.0\n1,1,2").drop("i")).collect()}
    assert types == {"a": "boolean", "b": "boolean", "c": "integer"}


def test_charts_literal(text_table):
    df = text_table(
        "job_date,revenue,cost,incidents\n2024-01-03,240,95,2\n2024-02-02,260,105,3\n2024-03-04,190,75,1"
    )
    corr = {(r["left"], r["right"]): r["correlation"] for r in charts.correlation(df, ["revenue", "cost", "incidents"]).collect()}
    assert corr[("revenue", "cost")] == 0.9986 and corr[("incidents", "revenue")] == 0.9707 and corr[("cost", "incidents")] == 0.982
    assert corr[("cost", "cost")] == 1.0
    assert charts.scatter_plots(df, ["revenue", "cost", "incidents"], ["i"]).count() == 9
    lines = charts.line_charts(df, ["job_date"], ["revenue", "cost"]).collect()
    assert len(lines) == 6 and ("2024-01-03", 240.0) in {(r["x"], r["y"]) for r in lines}


def test_constant_correlation_is_null(text_table):
    df = text_table("a,b\n1,5\n2,5\n3,5")
    got = {(r["left"], r["right"]): r["correlation"] for r in charts.correlation(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None and got[("a", "a")] == 1.0


def test_histogram_literal(text_table):
    df = text_table("units,flat\n" + "\n".join(f"{v},7" for v in range(8, 16)))
    got = charts.histogram(df, ["units", "flat"]).orderBy("column", "bin").collect()
    units = [r for r in got if r["column"] == "units"]
    assert [r["count"] for r in units] == [1] * 8 and units[0]["start"] == 8 and units[0]["end"] == 8.875
    flat = [r for r in got if r["column"] == "flat"]
    assert [(r["start"], r["end"], r["count"]) for r in flat] == [(7.0, 7.0, 8)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 1001, 5000])
@pytest.mark.parametrize("whole", [0, 10**9])
def test_quartiles_match_statistics(spark, monkeypatch, n, whole):
    """Both the whole-range and the sketch-bracket path are exact, ties included."""
    if whole == 0 and n < 1000:
        pytest.skip("sketch brackets need enough rows")
    monkeypatch.setattr(quantiles, "WHOLE_RANGE_ROWS", whole)
    if whole == 0:
        monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    rng = random.Random(n)
    values = [rng.choice([1.0, 2.0, rng.random() * 9, rng.expovariate(1) ** 4]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    row = quartiles_exclusive(df, {"v": F.col("v")}, 9).first()
    want = statistics.quantiles(values, n=4) if n > 1 else [values[0]] * 3
    assert row["q25"] == pytest.approx(want[0], abs=1e-8) and row["q75"] == pytest.approx(want[2], abs=1e-8)
    assert row["median"] == pytest.approx(statistics.median(values), abs=1e-8)


def test_percentile_linear(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert percentile_linear(df, F.col("v"), 0.9).first()[0] == pytest.approx(9.0)
    assert percentile_linear(df.limit(10), F.col("v"), 0.25).first()[0] == pytest.approx(2.25)


def test_cached_profile(spark, text_table, tmp_path):
    df = text_table(BEDS)
    first = profile.cached_profile(df, "abc", str(tmp_path), order_by="i")
    again = profile.cached_profile(df, "abc", str(tmp_path), order_by="i")
    assert not first.first()["cached"] and again.first()["cached"] and again.count() == 5
    assert not profile.cached_profile(df, "abc", str(tmp_path), force=True, order_by="i").first()["cached"]
