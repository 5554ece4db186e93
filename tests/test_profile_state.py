"""Profiles from merged column states against the profile of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import profile, profile_state

EXACT = ["column", "row_count", "missing_count", "missing_percent", "n", "min", "max", "mean", "std"]


def exact(df):
    return sorted(tuple(r) for r in df.select(EXACT).collect())


def test_merged_parts_tell_what_the_whole_table_does(spark, tmp_path):
    """Parts of very different size and mean, one of them empty: exact fields are equal, the others within their bounds."""
    rng = random.Random(3)
    rows = [(i, rng.gauss(1e6 * (i % 3), 5), None if i % 7 == 0 else f"v{rng.randint(0, 3000)}", "abc"[min(i % 10, 2)]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i int, x double, word string, kind string")
    parts = [df.where("i < 3"), df.where("i >= 3 and i % 3 = 0"), df.where("i >= 3 and i % 3 > 0"), df.limit(0)]
    for k, part in enumerate(parts):
        profile_state.store_state(part, f"h{k}", str(tmp_path))
    merged = profile_state.merge_states(profile_state.stored_states(spark, str(tmp_path), ["h0", "h1", "h2", "h3"]))
    told = profile_state.profile_of(merged)
    assert exact(told) == exact(profile_state.profile_of(profile_state.profile_state(df)))
    by = {r["column"]: r for r in told.collect()}
    direct = {r["column"]: r for r in profile.numeric_stats(df, ["i", "x"]).collect()}
    for c in ("i", "x"):
        assert [by[c][f] for f in ("n", "min", "max", "mean", "std")] == [direct[c][f] for f in ("n", "min", "max", "mean", "std")]
        values = sorted(r[0 if c == "i" else 1] for r in rows)
        for name, rank in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            at = sum(v <= by[c][name] for v in values) / len(values)
            assert abs(at - rank) < 0.015, (c, name)
    for c, cells in (("word", {r[2] for r in rows} - {None}), ("x", {r[1] for r in rows}), ("kind", set("abc"))):
        assert abs(by[c]["unique_estimate"] / len(cells) - 1) < 4 * 1.04 / math.sqrt(2**profile_state.DISTINCT_BITS)
    assert [tuple(t) for t in by["kind"]["top_values"]] == [("c", 16_000), ("a", 2000), ("b", 2000)]


def test_merging_is_the_same_in_any_order(spark):
    df = spark.range(500).select((F.col("id") % 13).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    states = [profile_state.profile_state(df.where(F.col("a") % 4 == k)) for k in range(4)]
    left = profile_state.merge_states(states[0].unionByName(states[1]))
    right = profile_state.merge_states(states[3].unionByName(states[2]))
    nested = profile_state.profile_of(profile_state.merge_states(right.unionByName(left)))
    flat = profile_state.profile_of(profile_state.merge_states(states[2].unionByName(states[0]).unionByName(states[3]).unionByName(states[1])))
    assert exact(nested) == exact(flat) == exact(profile_state.profile_of(profile_state.profile_state(df)))


def test_awkward_cells(spark, tmp_path):
    long = "z" * 5000
    rows = [("1", "nan", long, None), (" NA ", "inf", long, None), ("", "-2.5", "z" * 4999, None), ("1", "2.5", "short", None)]
    df = spark.createDataFrame(rows, "`row_count` string, `a.b` string, `mean` string, n string")
    profile_state.store_state(df, "x", str(tmp_path))
    twice = profile_state.merge_states(profile_state.stored_states(spark, str(tmp_path), ["x", "x"]))
    by = {r["column"]: r for r in profile_state.profile_of(twice).collect()}
    assert set(by) == {"row_count", "a.b", "mean", "n"} and all(r["row_count"] == 8 for r in by.values())
    assert by["row_count"]["missing_count"] == 4 and [tuple(t) for t in by["row_count"]["top_values"]] == [("1", 4)]
    assert (by["a.b"]["n"], by["a.b"]["min"], by["a.b"]["max"], by["a.b"]["mean"], by["a.b"]["std"]) == (4, -2.5, 2.5, 0.0, 2.5)
    assert by["n"]["top_values"] is None and by["n"]["missing_percent"] == 100.0 and by["n"]["median"] is None
    assert [t["count"] for t in by["mean"]["top_values"]] == [4, 2, 2] and max(len(t["value"]) for t in by["mean"]["top_values"]) < 250
    none = profile_state.profile_of(profile_state.merge_states(profile_state.profile_state(df.limit(0)))).collect()
    assert len(none) == 4 and all(r["row_count"] == 0 and r["mean"] is None for r in none)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        profile_state.stored_states(spark, str(tmp_path), ["x", "unknown"]).count()


def test_cells_are_read_once_and_by_all_cores(spark, tmp_path):
    """One file comes as one task; its cells are dealt out, and no sketch works a cell out again."""
    spark.createDataFrame([(i, f" {i} ") for i in range(50)], "i int, word string").coalesce(1).write.parquet(f"{tmp_path}/rows")
    states = profile_state.profile_state(spark.read.parquet(f"{tmp_path}/rows"))
    lines = str(states._jdf.queryExecution().optimizedPlan().toString()).split("\n")
    assert any("Repartition" in line for line in lines)
    assert not any("trim(" in line for line in lines if "Aggregate" in line)
    assert {r["column"]: r["n"] for r in states.collect()} == {"i": 50, "word": 50}
