"""Profile and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.operators import charts, profile, profile_state
from tabwright.session import shared_folder
from tabwright.sources.tables import table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def lineitem(spark, folder):
    return table(spark, folder, "lineitem")


def messy_customer(spark, folder):
    """Customers as text, with missing tokens, padded cells and mixed date spellings."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    signup = F.date_add(F.lit("2020-01-01").cast("date"), (key % 700).cast("int"))
    return table(spark, folder, "customer").select(
        key.cast("string").alias("id"),
        F.when(balance < 0, "N/A").otherwise(F.format_number(balance, 2)).alias("balance"),
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("segment"),
        F.when(key % 10 == 0, " - ")
        .when(key % 2 == 0, F.date_format(signup, "dd/MM/yyyy"))
        .otherwise(F.date_format(signup, "MMMM d, yyyy"))
        .alias("signup"),
        F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "no").otherwise("").alias("active"),
        F.col("c_name").alias("name"),
        F.lit("x").alias("constant"),
        F.when(key % 2 == 0, "").otherwise((key % 7).cast("string")).alias("half"),
    )


def _warnings(spark, folder):
    df = messy_customer(spark, folder)
    return profile.quality_warnings(profile.column_types(df), profile.duplicate_rows(df))


def _suggest(spark, folder):
    df = messy_customer(spark, folder)
    order = df.columns
    types = profile.column_types(df)
    ordinal = F.array_position(F.lit(order), F.col("column"))
    row = profile.suggestions(types.withColumn("ordinal", ordinal), profile.duplicate_rows(df))
    return row.select(*(F.array_join(c, ",").alias(c) for c in row.columns))


def _merged(df, part):
    """A table's profile from the stored states of three parts of it."""
    store = shared_folder(df.sparkSession, "profile-states")
    for k in range(3):
        profile_state.store_state(df.where(part % 3 == k), str(k), store)
    states = profile_state.stored_states(df.sparkSession, store, ["0", "1", "2"])
    return profile_state.profile_of(profile_state.merge_states(states))


def _merged_lines(spark, folder):
    return _merged(lineitem(spark, folder), F.col("l_orderkey"))


def _merged_customers(spark, folder):
    return _merged(messy_customer(spark, folder), F.col("id").cast("long"))


def _coerced(spark, folder):
    """Cell coercions, summed up per kind."""
    df = messy_customer(spark, folder)
    number = cells.coerce_float(F.col("balance"))
    return df.select(
        number.alias("n"),
        cells.coerce_int(F.col("half")).alias("i"),
        cells.parse_date(F.col("signup")).alias("t"),
        cells.is_missing(F.col("signup")).alias("m"),
    ).agg(
        F.count("n").alias("numbers"),
        F.round(F.sum("n"), 2).alias("total"),
        F.count("i").alias("integers"),
        F.sum("i").alias("integer_total"),
        F.count("t").alias("dates"),
        F.date_format(F.min("t"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("t"), "yyyy-MM-dd").alias("last_day"),
        F.count_if("m").alias("missing"),
    )


QUERIES = {
    "cell_coercion": _coerced,
    "profile_merged_missing": lambda s, d: _merged_customers(s, d).select(
        "column", "row_count", "missing_count", "missing_percent"
    ),
    "profile_merged_numbers": lambda s, d: _merged_lines(s, d).where(F.col("column").isin(LINE_NUMBERS)).select(
        "column", "n", "min", "max", "mean", "std"
    ),
    "profile_merged_top": lambda s, d: _merged_lines(s, d).where(F.col("column").isin("l_returnflag", "l_linestatus")).select(
        "column", F.inline("top_values")
    ),
    "profile_numeric": lambda s, d: profile.numeric_stats(
        lineitem(s, d), LINE_NUMBERS, quartiles=False
    ),
    "profile_quartiles_exclusive": lambda s, d: profile.numeric_stats(
        lineitem(s, d), LINE_NUMBERS
    ).select("column", "n", "q25", "median", "q75"),
    "profile_quartiles_text": lambda s, d: profile.numeric_stats(
        messy_customer(s, d), ["balance", "half"]
    ),
    "profile_types": lambda s, d: profile.column_types(table(s, d, "part"), PART_COLUMNS),
    "profile_types_text": lambda s, d: profile.column_types(messy_customer(s, d)),
    "profile_missing": lambda s, d: profile.missing_cells(messy_customer(s, d)),
    "profile_missing_summary": lambda s, d: profile.missing_summary(messy_customer(s, d)),
    "profile_missing_ranking": lambda s, d: profile.missing_ranking(
        profile.missing_cells(messy_customer(s, d))
    ),
    "profile_duplicates": lambda s, d: profile.duplicate_rows(
        table(s, d, "documents").select("text", "lang")
    ),
    "profile_duplicates_keys": lambda s, d: profile.duplicate_rows(
        lineitem(s, d).select("l_orderkey", "l_linenumber")
    ),
    "profile_top_values": lambda s, d: profile.top_values(
        table(s, d, "part"), ["p_brand", "p_type", "p_size"]
    ),
    "profile_top_values_first_seen": lambda s, d: profile.top_values(
        table(s, d, "orders"), ["o_custkey", "o_orderpriority"], order_by="o_orderkey"
    ),
    "profile_samples": lambda s, d: profile.sample_values(table(s, d, "part"), "p_partkey").select(
        "column", F.array_join("samples", "|").alias("samples")
    ),
    "profile_warnings": _warnings,
    "profile_suggestions": _suggest,
    "profile_first_rows": lambda s, d: profile.numeric_stats(
        profile.first_rows(table(s, d, "orders"), 100_000, "o_orderkey"), ["o_totalprice"], quartiles=False
    ),
    "profile_full": lambda s, d: profile.profile(table(s, d, "part"), order_by="p_partkey").select(
        "ordinal", "column", "inferred_type", "row_count", "missing_count", "unique_count",
        "min", "max", "mean", "median", "std", "q25", "q75",
        F.element_at("top_values", 1)["value"].alias("top_value"),
        F.element_at("top_values", 1)["count"].alias("top_count"),
    ),
    "histogram8": lambda s, d: charts.histogram(lineitem(s, d), LINE_NUMBERS),
    "correlation_long": lambda s, d: charts.correlation(lineitem(s, d), LINE_NUMBERS),
    "scatter_points": lambda s, d: charts.scatter_points(
        table(s, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"]
    ),
    "scatter_plots": lambda s, d: charts.scatter_plots(
        table(s, d, "part"), ["p_size", "p_retailprice", "p_partkey"], ["p_partkey"]
    ),
    "daily_line": lambda s, d: charts.daily_line(table(s, d, "events"), "ts", "value"),
    "line_charts": lambda s, d: charts.line_charts(
        table(s, d, "orders"), ["o_orderdate"], ["o_totalprice", "o_custkey", "o_orderkey"]
    ),
    "bar_values": lambda s, d: charts.bar_values(
        profile.top_values(messy_customer(s, d), ["segment", "active"])
    ),
}

MISSING = "('', 'na', 'n/a', 'null', 'none', '-')"
MESSY = """messy AS (SELECT CAST(c_custkey AS VARCHAR) AS id,
 CASE WHEN c_acctbal < 0 THEN 'N/A' ELSE printf('%.2f', round(c_acctbal, 2)) END AS balance,
 trim(c_mktsegment) AS segment,
 CASE WHEN c_custkey % 10 = 0 THEN '-'
      WHEN c_custkey % 2 = 0 THEN strftime(DATE '2020-01-01' + CAST(c_custkey % 700 AS INTEGER), '%d/%m/%Y')
      ELSE strftime(DATE '2020-01-01' + CAST(c_custkey % 700 AS INTEGER), '%B %-d, %Y') END AS signup,
 CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '' END AS active,
 c_name AS name, 'x' AS constant,
 CASE WHEN c_custkey % 2 = 0 THEN '' ELSE CAST(c_custkey % 7 AS VARCHAR) END AS half FROM customer)"""
MESSY_COLUMNS = ["id", "balance", "segment", "signup", "active", "name", "constant", "half"]
FORMATS = (
    "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%m-%d-%Y', "
    "'%B %d, %Y', '%b %d, %Y', '%B %Y', '%b %Y']"
)


def _types_sql(source: str, columns: list[str]) -> str:
    cells_sql = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CASE WHEN lower(t) IN {MISSING} THEN NULL ELSE t END AS v "
        f"FROM (SELECT CAST({c} AS VARCHAR) AS t FROM {source})"
        for c in columns
    )
    return f"""u AS ({cells_sql}),
f AS (SELECT col, v, lower(v) IN ('true','yes','y','1','false','no','n','0') AS b,
      CASE WHEN try_cast(v AS DOUBLE) IS NULL AND length(v) >= 8 THEN try_strptime(v, {FORMATS}) END AS dt,
      try_cast(replace(v, ',', '') AS DOUBLE) AS num FROM u),
a AS (SELECT col, count(*) AS n, count(*) - count(v) AS miss, count(DISTINCT v) AS dist, count(v) AS filled,
      count(dt) AS dates, coalesce(bool_and(b), false) AS ab,
      coalesce(bool_and(CASE WHEN v IS NOT NULL THEN num IS NOT NULL END), false) AS af,
      coalesce(bool_and(CASE WHEN v IS NOT NULL THEN coalesce(num = floor(num), false) END), false) AS ai
      FROM f GROUP BY col),
types AS (SELECT col AS "column", n AS row_count, miss AS missing_count, round(miss / n * 100, 2) AS missing_percent,
 dist AS unique_count,
 CASE WHEN filled = 0 THEN 'string' WHEN ab THEN 'boolean' WHEN dates / filled >= 0.8 THEN 'datetime'
      WHEN ai THEN 'integer' WHEN af THEN 'float' WHEN dist / n <= 0.2 OR dist <= 20 THEN 'categorical'
      ELSE 'string' END AS inferred_type FROM a)"""


def _unpivot(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, try_cast({c} AS DOUBLE) AS v FROM {source}" for c in columns
    )


_STATS = """SELECT col AS "column", count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean,
 round(stddev_pop(v), 4) AS std FROM u GROUP BY col HAVING count(v) > 0"""
_QUART = """q AS (SELECT col, max(n) AS n,
 CASE WHEN max(n) = 1 THEN max(v) ELSE (max(CASE WHEN rn = j1 THEN v END) * (4 - max(d1)) + max(CASE WHEN rn = j1 + 1 THEN v END) * max(d1)) / 4 END AS q25,
 (max(CASE WHEN rn = (n + 1) // 2 THEN v END) + max(CASE WHEN rn = n // 2 + 1 THEN v END)) / 2 AS median,
 CASE WHEN max(n) = 1 THEN max(v) ELSE (max(CASE WHEN rn = j3 THEN v END) * (4 - max(d3)) + max(CASE WHEN rn = j3 + 1 THEN v END) * max(d3)) / 4 END AS q75
 FROM (SELECT *, (n + 1) - j1 * 4 AS d1, 3 * (n + 1) - j3 * 4 AS d3 FROM (
   SELECT *, least(greatest((n + 1) // 4, 1), n - 1) AS j1, least(greatest(3 * (n + 1) // 4, 1), n - 1) AS j3 FROM (
   SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS rn, count(*) OVER (PARTITION BY col) AS n
   FROM u WHERE v IS NOT NULL))) GROUP BY col)"""
_TOP = """SELECT col AS "column", CAST(position AS INTEGER) AS position, v AS value, copies FROM (
 SELECT *, row_number() OVER (PARTITION BY col ORDER BY copies DESC, first_seen, v) AS position FROM (
  SELECT col, v, count(*) AS copies, min(ord) AS first_seen FROM u GROUP BY col, v)) WHERE position <= 5"""


def _top_sql(table_name: str, columns: list[str], at: str = "0") -> str:
    u = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, {at} AS ord FROM {table_name}" for c in columns
    )
    return f"WITH u AS ({u}) {_TOP}"


def _corr_sql() -> str:
    pairs = [
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 4) AS correlation FROM lineitem"
        if a != b
        else f"SELECT '{a}', '{b}', 1.0::DOUBLE"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    ]
    pairs.sort(key=lambda p: "corr(" not in p)
    return " UNION ALL ".join(pairs)


def _hist_sql() -> str:
    return f"""WITH u AS ({_unpivot('lineitem', LINE_NUMBERS)}),
r AS (SELECT col, min(v) AS lo, max(v) AS hi FROM u GROUP BY col),
c AS (SELECT col, CAST(least(floor((v - lo) / ((hi - lo) / 8)), 7) AS INTEGER) AS bin, count(*) AS n FROM u JOIN r USING (col) GROUP BY 1, 2)
SELECT r.col AS "column", CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 8), 4) AS start,
 round(lo + (b.bin + 1) * ((hi - lo) / 8), 4) AS "end", coalesce(c.n, 0) AS count
FROM r CROSS JOIN (SELECT unnest(range(8)) AS bin) b LEFT JOIN c ON c.col = r.col AND c.bin = b.bin"""


def _line_sql(table_name: str, at: str, value: str) -> str:
    return f"""SELECT * FROM (SELECT '{at}' AS x_column, '{value}' AS y_column, strftime({at}, '%Y-%m-%d') AS x,
 round(CAST(sum({value}) AS DOUBLE), 4) AS y FROM {table_name} GROUP BY ALL)"""


def _scatter_sql(table_name: str, x: str, y: str, key: str, rank: str = "") -> str:
    return f"""SELECT * FROM (SELECT {rank}'{x}' AS x_column, '{y}' AS y_column, CAST({x} AS DOUBLE) AS x,
 CAST({y} AS DOUBLE) AS y FROM {table_name})"""


SQL = {
    "cell_coercion": f"""WITH {MESSY}
SELECT count(try_cast(balance AS DOUBLE)) AS numbers, round(sum(try_cast(balance AS DOUBLE)), 2) AS total,
 count(try_cast(half AS BIGINT)) AS integers, CAST(sum(try_cast(half AS BIGINT)) AS BIGINT) AS integer_total,
 count(d) AS dates, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day,
 count(*) FILTER (signup = '-') AS missing
FROM (SELECT *, try_strptime(signup, ['%d/%m/%Y', '%B %d, %Y']) AS d FROM messy)""",
    "profile_numeric": f"WITH u AS ({_unpivot('lineitem', LINE_NUMBERS)}) {_STATS}",
    "profile_quartiles_exclusive": f"""WITH u AS ({_unpivot('lineitem', LINE_NUMBERS)}), {_QUART}
SELECT col AS "column", n, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75 FROM q""",
    "profile_quartiles_text": f"""WITH {MESSY}, u AS ({_unpivot('messy', ['balance', 'half'])}), {_QUART}, s AS ({_STATS})
SELECT s.*, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75 FROM s JOIN q ON s."column" = q.col""",
    "profile_types": f"WITH {_types_sql('part', PART_COLUMNS)} SELECT * FROM types",
    "profile_types_text": f"WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)} SELECT * FROM types",
    "profile_missing": f"""WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)}
SELECT "column", row_count, missing_count, missing_percent FROM types""",
    "profile_missing_summary": f"""WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)}
SELECT max(row_count) AS row_count, CAST(8 AS BIGINT) AS column_count, CAST(sum(missing_count) AS BIGINT) AS missing_cells,
 round(CAST(sum(missing_count) AS DOUBLE) / (max(row_count) * 8) * 100, 2) AS missing_percent FROM types""",
    "profile_missing_ranking": f"""WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)}
SELECT "column", missing_count, missing_percent FROM types WHERE missing_count > 0""",
    "profile_duplicates": """SELECT CAST(count(*) - count(DISTINCT (regexp_replace(text, '^\\s+|\\s+$', '', 'g'), lang)) AS BIGINT)
 AS duplicate_row_count FROM documents""",
    "profile_duplicates_keys": """SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT)
 AS duplicate_row_count FROM lineitem""",
    "profile_top_values": _top_sql("part", ["p_brand", "p_type", "p_size"]),
    "profile_top_values_first_seen": _top_sql("orders", ["o_custkey", "o_orderpriority"], "o_orderkey"),
    "profile_samples": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT string_agg(v, '|' ORDER BY k) FROM
 (SELECT CAST({c} AS VARCHAR) AS v, p_partkey AS k FROM part ORDER BY p_partkey LIMIT 5)) AS samples"""
        for c in PART_COLUMNS
        if c != "p_partkey"
    ),
    "profile_warnings": f"""WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)},
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS dup FROM messy)
SELECT "column", 'Column ''' || "column" || ''' is more than 50% missing' AS warning FROM types WHERE missing_percent >= 50
UNION ALL SELECT "column", 'Column ''' || "column" || ''' appears constant' FROM types WHERE unique_count <= 1 AND row_count > 1
UNION ALL SELECT NULL, CAST(dup AS VARCHAR) || ' duplicate rows detected' FROM d WHERE dup > 0""",
    "profile_suggestions": f"""WITH {MESSY}, {_types_sql('messy', MESSY_COLUMNS)},
t AS (SELECT *, list_position({MESSY_COLUMNS}, "column") AS o,
 unique_count BETWEEN 2 AND 12 AND (inferred_type IN ('categorical','boolean') OR (inferred_type IN ('integer','float') AND unique_count < row_count)) AS tgt FROM types),
g AS (SELECT string_agg("column", ',' ORDER BY o) FILTER (tgt) AS target_columns,
 string_agg("column", ',' ORDER BY o) FILTER (NOT tgt AND inferred_type IN ('integer','float','categorical','boolean')) AS feature_columns,
 string_agg("column", ',' ORDER BY o) FILTER (inferred_type = 'datetime') AS date_columns,
 count(*) FILTER (tgt) AS nt, count(*) FILTER (inferred_type = 'datetime') AS nd,
 count(*) FILTER (NOT tgt AND inferred_type IN ('integer','float','categorical','boolean')) AS nf,
 count(*) FILTER (inferred_type IN ('integer','float')) AS nn,
 (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS dup FROM t)
SELECT coalesce(target_columns, '') AS target_columns, coalesce(feature_columns, '') AS feature_columns,
 coalesce(date_columns, '') AS date_columns,
 concat_ws(',', CASE WHEN nd > 0 AND nn > 0 THEN 'time_series' END, CASE WHEN nf >= 2 AND nt > 0 THEN 'regression' END,
  CASE WHEN nt > 0 THEN 'classification' END, CASE WHEN nf >= 2 THEN 'clustering' END,
  CASE WHEN dup > 0 THEN 'deduplication_review' END) AS suggested_analyses FROM g""",
    "profile_first_rows": """SELECT 'o_totalprice' AS "column", count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean,
 round(stddev_pop(v), 4) AS std FROM (SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 100000)""",
    "profile_full": f"""WITH {_types_sql('part', PART_COLUMNS[1:])}, u2 AS (SELECT col, try_cast(v AS DOUBLE) AS v FROM u),
q AS (SELECT * FROM (WITH u AS (SELECT * FROM u2), {_QUART} SELECT * FROM q)),
s AS (SELECT col, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std FROM u2 GROUP BY col),
top AS (SELECT * FROM ({_top_sql('part', PART_COLUMNS[1:], 'p_partkey')}) WHERE position = 1)
SELECT CAST(list_position({PART_COLUMNS[1:]}, t."column") - 1 AS INTEGER) AS ordinal, t."column", inferred_type, row_count, missing_count, unique_count,
 CASE WHEN isn THEN min END AS min, CASE WHEN isn THEN max END AS max, CASE WHEN isn THEN round(mean, 4) END AS mean,
 CASE WHEN isn THEN round(median, 4) END AS median, CASE WHEN isn THEN round(std, 4) END AS std,
 CASE WHEN isn THEN round(q25, 4) END AS q25, CASE WHEN isn THEN round(q75, 4) END AS q75,
 CASE WHEN ist THEN top.value END AS top_value, CASE WHEN ist THEN top.copies END AS top_count
FROM (SELECT *, inferred_type IN ('integer','float') AS isn, inferred_type IN ('categorical','boolean','string') AS ist FROM types) t
LEFT JOIN s ON s.col = t."column" LEFT JOIN q ON q.col = t."column" LEFT JOIN top ON top."column" = t."column" """,
    "histogram8": _hist_sql(),
    "correlation_long": _corr_sql(),
    "scatter_points": _scatter_sql("orders", "o_custkey", "o_totalprice", "o_orderkey"),
    "scatter_plots": " UNION ALL ".join(
        _scatter_sql("part", x, y, "p_partkey", f"{i} AS rank, ")
        for i, (x, y) in enumerate(charts.scatter_pairs(["p_size", "p_retailprice", "p_partkey"]))
    ),
    "daily_line": _line_sql("events", "ts", "value"),
    "line_charts": _line_sql("orders", "o_orderdate", "o_totalprice")
    + " UNION ALL "
    + _line_sql("orders", "o_orderdate", "o_custkey"),
    "bar_values": f"""WITH {MESSY}, u AS (SELECT 'segment' AS col, segment AS v FROM messy UNION ALL
 SELECT 'active', active FROM messy WHERE active <> '')
SELECT col AS "column", v AS value, n AS count FROM (SELECT col, v, count(*) AS n,
 row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS k FROM u GROUP BY col, v) WHERE k <= 5""",
}
# The state of merged parts tells exactly what the profile of the whole table does.
SQL["profile_merged_missing"] = SQL["profile_missing"]
SQL["profile_merged_numbers"] = SQL["profile_numeric"]
SQL["profile_merged_top"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM lineitem GROUP BY {c}""" for c in ("l_returnflag", "l_linestatus")
)
