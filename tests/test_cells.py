import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwright.functions import cells, sql_cells


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c"))).collect()]


def test_normalise_and_missing(spark):
    assert run(spark, cells.normalize_cell, [None, " a\t", " b "]) == ["", "a", "b"]
    assert run(spark, cells.is_missing, ["", None, " NA ", "n/A", "Null", "none", "-", "0", "x"]) == [True] * 7 + [False] * 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("1", 1.0), ("1,000", 1000.0), (" 2.5 ", 2.5), ("1e5", 1e5), ("+.5", 0.5), ("1.", 1.0), ("1_000", 1000.0),
        ("1.0d", None), ("0x1p3", None), ("1__0", None), ("abc", None), ("", None), ("-", None), ("-3", -3.0), (",", None),
    ],
)
def test_float(spark, text, want):
    assert run(spark, cells.coerce_float, [text]) == [want]


def test_float_specials(spark):
    got = run(spark, cells.coerce_float, ["inf", "-Infinity", "NaN"])
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2]


def test_int(spark):
    assert run(spark, cells.coerce_int, ["1.0", "1,000", "1.5", "x", "inf", "nan"]) == [1, 1000, None, None, None, None]


def test_dates(spark):
    d = dt.datetime
    values = [
        "2024-1-5", "2024-01-05 1:02:03", "2024-01-05T01:02:03Z", "13/01/2024", "01/13/2024", "05/06/2024", "5-1-2024",
        "January 5, 2024", "jan 5, 2024", "february 2024", "Feb 2024", "2024-02-30", "2024/01/05", "hello", "5",
    ]
    want = [
        d(2024, 1, 5), d(2024, 1, 5, 1, 2, 3), d(2024, 1, 5, 1, 2, 3), d(2024, 1, 13), d(2024, 1, 13), d(2024, 6, 5),
        d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), d(2024, 2, 1), d(2024, 2, 1), None, None, None, None,
    ]
    assert run(spark, cells.parse_date, values) == want


def test_business_dates(spark):
    d = dt.datetime
    assert run(spark, cells.parse_business_date, ["2024/01/05", "2024-03", "31/12/2023", "12/31/2023", "Jan 2024"]) == [
        d(2024, 1, 5), d(2024, 3, 1), d(2023, 12, 31), d(2023, 12, 31), None,
    ]


def test_sql_functions_follow_the_column_rules(spark):
    texts = [
        None, "", " na ", "1,234.5", "1_000", "1e3", "0x10", "\u2003 12 ", "1.0d", "inf", "nan", "-", "12.5", "-7", "9999999999999999999",
        "2024-01-03", "2024-01-03T01:02:03Z", "31/12/2023", "12/31/2023", "March 5, 2024", "Mar 2024", "2024-02-30", " 2024-1-3   4:5:6 ", "it's",
    ]
    session = spark.newSession()
    sql_cells.register(session)
    session.createDataFrame(list(enumerate(texts)), "i int, cell string").createOrReplaceTempView("raw")
    rules = {
        "cell_text": cells.normalize_cell, "cell_missing": cells.is_missing, "cell_number": cells.coerce_float,
        "cell_whole": cells.coerce_int, "cell_date": cells.parse_date,
    }
    raw = session.table("raw")
    own = raw.select("i", *(rule(F.col("cell")).cast("string").alias(name) for name, rule in rules.items())).orderBy("i").collect()
    called = ", ".join(f"CAST({name}(cell) AS STRING) AS {name}" for name in rules)
    assert session.sql(f"SELECT i, {called} FROM raw ORDER BY i").collect() == own
