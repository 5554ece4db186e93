"""SQL workspace queries: presets, selections and one query per SQL family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import workspace as ws
from tabwright.plans.registry import profile
from tabwright.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _typed(spark, folder) -> ws.Workspace:
    space = ws.Workspace(spark)
    for name in TABLES:
        space.register(name, table(spark, folder, name), as_text=False)
    return space


def _text(spark, folder, name: str) -> ws.Workspace:
    space = ws.Workspace(spark)
    space.register(name, table(spark, folder, name))
    return space


def _sql(statement: str, params: dict | None = None):
    return lambda s, d: _typed(s, d).query(statement, params)


def _selection(spark, folder):
    part = table(spark, folder, "part")
    blanked = part.withColumn("p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")))
    chosen = (
        blanked.filter(F.col("p_retailprice") > 950)
        .select(F.coalesce("p_brand", F.lit("")).alias("p_brand"), "p_size")
    )
    return ws.selected_rows(blanked, chosen).select("p_partkey")


def _group_import(spark, folder):
    members = {n: table(spark, folder, n) for n in ("nation", "region", "supplier")}
    return ws.Workspace(spark).register_group(members)


def _join_preset(spark, folder):
    """Orders and customers under a shared column name, joined by the preset."""
    space = ws.Workspace(spark)
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = table(spark, folder, "customer").withColumnRenamed("c_custkey", "CustKey")
    names = {
        "orders": space.register("orders", orders, as_text=False),
        "customer": space.register("customer", customer, as_text=False),
    }
    joined = space.query(ws.group_presets(names)["join_shared_column"])
    return joined.select("o_orderkey", "c_name", "c_mktsegment")


def _cell_functions(spark, folder):
    """The cell rules called from a statement over raw text, as ``cell_coercion`` calls them from Python."""
    space = ws.Workspace(spark).with_cell_functions()
    space.register("messy", profile.messy_customer(spark, folder), as_text=False)
    return space.query(
        "SELECT count(cell_number(balance)) AS numbers, round(sum(cell_number(balance)), 2) AS total, "
        "count(cell_whole(half)) AS integers, sum(cell_whole(half)) AS integer_total, count(cell_date(signup)) AS dates, "
        "date_format(min(cell_date(signup)), 'yyyy-MM-dd') AS first_day, "
        "date_format(max(cell_date(signup)), 'yyyy-MM-dd') AS last_day, count_if(cell_missing(signup)) AS missing FROM messy"
    )


def _typed_text_sum(spark, folder):
    """All-text import: numbers must be cast in the statement."""
    return _text(spark, folder, "part").query(
        "SELECT p_brand, COUNT(*) AS n, ROUND(SUM(CAST(p_retailprice AS DOUBLE)), 2) AS total, MIN(p_size) AS least "
        "FROM part GROUP BY p_brand"
    )


# Statement text shared by the workspace and the oracle where both dialects agree.
BOTH = {
    "sql_projection_filter": """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS class
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#13') OR (p_retailprice IS NOT NULL AND p_type LIKE '%A%')""",
    "sql_inner_join": """
SELECT n_name, COUNT(*) AS customers, ROUND(SUM(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_left_join": """
SELECT c_custkey, COUNT(o_orderkey) AS orders_placed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "sql_right_join": """
SELECT n_name, COUNT(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "sql_full_join": """
SELECT COALESCE(c.nk, s.nk) AS nationkey, c.n AS customers, s.n AS suppliers
FROM (SELECT c_nationkey AS nk, COUNT(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c
FULL JOIN (SELECT s_nationkey AS nk, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.nk = s.nk""",
    "sql_theta_join": """
SELECT a.r_name AS lower_region, b.r_name AS higher_region, COUNT(n_nationkey) AS nations
FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey LEFT JOIN nation ON n_regionkey = b.r_regionkey
GROUP BY a.r_name, b.r_name""",
    "sql_semi_join": """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    "sql_in_subquery": """
SELECT COUNT(*) AS lines_of_small_parts FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)""",
    "sql_anti_join": """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "sql_having": """
SELECT o_custkey, COUNT(*) AS n, COUNT(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12""",
    "sql_correlated": """
SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "sql_scalar_subquery": """
SELECT p_brand, COUNT(*) AS above FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part) GROUP BY p_brand""",
    "sql_cte": """
WITH totals AS (SELECT l_suppkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey),
best AS (SELECT MAX(qty) AS top FROM totals)
SELECT l_suppkey, qty FROM totals JOIN best ON qty >= top * 0.9""",
    "sql_recursive_cte": """
WITH RECURSIVE steps(k, n) AS (SELECT CAST(1 AS BIGINT), COUNT(*) FROM part UNION ALL SELECT k + 1, n FROM steps WHERE k < 12)
SELECT k, n * k AS scaled FROM steps""",
    "sql_union": """
SELECT c_nationkey AS nk FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""",
    "sql_union_all": """
SELECT kind, COUNT(*) AS n FROM (SELECT 'c' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier) u GROUP BY kind""",
    "sql_intersect": """
SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size > 40""",
    "sql_except": """
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""",
    "sql_window_rank": """
SELECT o_orderkey, CAST(rk AS BIGINT) AS rk, CAST(dr AS BIGINT) AS dr, CAST(rn AS BIGINT) AS rn FROM (SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk,
 DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr,
 ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t""",
    "sql_window_lag": """
SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_key,
 LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_two,
 FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_key,
 CAST(NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders""",
    "sql_window_frame": """
SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
 MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max FROM orders""",
    "sql_order_limit_offset": """
SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10""",
    "sql_string_functions": """
SELECT c_custkey, UPPER(SUBSTRING(c_name, 1, 8)) AS head, CAST(LENGTH(c_mktsegment) AS BIGINT) AS len, CONCAT(LOWER(c_mktsegment), '-', CAST(c_nationkey AS VARCHAR(10))) AS tag,
 TRIM(c_mktsegment) AS seg FROM customer""",
    "sql_math_functions": """
SELECT p_partkey, ROUND(ABS(p_retailprice - 1000), 2) AS gap, FLOOR(p_retailprice) AS down, p_size % 7 AS rest, ROUND(SQRT(p_size), 4) AS root,
 COALESCE(NULLIF(p_size, 1), 0) AS size_or_zero FROM part""",
    "sql_rollup": """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
}
_FLOOR = {"sql_math_functions": ("FLOOR(p_retailprice) AS down", "CAST(FLOOR(p_retailprice) AS BIGINT) AS down")}

# (statement, whether the guard lets it pass over the tables' keys).
GUARDED = [
    ("SELECT COUNT(*) FROM orders", True),
    ("WITH few AS (SELECT * FROM nation) SELECT n_name FROM few", True),
    ("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", True),
    ("EXPLAIN SELECT * FROM part", True),
    ("PRAGMA table_info('part')", True),
    ("SELECT s.id FROM default.secret_t s, orders", False),
    ("SELECT id AS orders FROM secret_t", False),
    ("SELECT * FROM orders WHERE o_orderkey IN (SELECT id FROM secret_t)", False),
    ("SELECT * FROM (WITH secret_t AS (SELECT 1) SELECT * FROM secret_t) a, secret_t, orders", False),
    ("SELECT s.id FROM IDENTIFIER('secret_t') s, orders", False),
    ("SELECT s.id FROM IDENTIFIER('sec' || 'ret_t') s, orders", False),
    ("SELECT s.id FROM IDENTIFIER(lower('SECRET_T')) s, orders", False),
    ("SELECT COUNT(*) FROM orders WHERE o_orderkey = (SELECT MAX(id) FROM IDENTIFIER('secret_t'))", False),
    ("SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'nanoTime') FROM region", False),
    ("SELECT * FROM range(3), region", False),
    ("SELECT n_name, v FROM nation, LATERAL (SELECT n_regionkey AS v) WHERE v > 1", True),
    ("SELECT 1", False),
    ("SHOW TABLES", False),
    ("DELETE FROM orders", False),
    ("SELECT * FROM orders; SELECT * FROM part", False),
    ("PRAGMA table_info('secret_t')", False),
]


def _guarded(spark, folder):
    """Each statement with the guard's answer and, where it is a query that passes, its number of rows."""
    space = _typed(spark, folder)
    out = None
    for text, _ in GUARDED:
        try:
            rows = space.query(text)
        except ws.QueryRefused:
            rows = None
        counted = F.count(F.lit(1)) if rows is not None and text.startswith(("SELECT", "WITH")) else F.lit(None).cast("long")
        source = rows if rows is not None else space.session.range(1)
        one = source.agg(counted.alias("result_rows")).select(
            F.lit(text).alias("statement"), F.lit(rows is not None).alias("allowed"), "result_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "sql_cell_functions": _cell_functions,
    "guard_statements": _guarded,
    **{name: _sql(text) for name, text in BOTH.items()},
    "sql_date_functions": _sql(
        "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, datediff(o_orderdate, DATE '1995-01-01') AS days, "
        "EXTRACT(YEAR FROM o_orderdate) AS y FROM orders"
    ),
    "sql_json_functions": _sql(
        "SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, COUNT(*) AS n FROM events GROUP BY 1"
    ),
    "sql_group_concat": _sql(
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
    ),
    "sql_ilike": _sql("SELECT COUNT(*) AS n FROM part WHERE p_name ILIKE '%A%' AND p_brand ILIKE 'brand#1%'"),
    "sql_named_parameters": _sql(
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > :low AND o_orderstatus = :state GROUP BY o_orderpriority",
        {"low": 100000.0, "state": "F"},
    ),
    "sql_text_import": _typed_text_sum,
    "preset_all_rows": lambda s, d: _typed(s, d).preset("supplier", "view_all_rows", None),
    "preset_row_count": lambda s, d: _typed(s, d).preset("lineitem", "row_count", None),
    "preset_group_count": lambda s, d: _typed(s, d).preset("part", "group_by_count", "p_brand"),
    "preset_top5": lambda s, d: _typed(s, d).preset("part", "top_values", "p_type"),
    "preset_join_shared": _join_preset,
    "pick_group_column": lambda s, d: ws.group_count(
        table(s, d, "part").drop("p_name"),
        ws.pick_group_column(ws.import_table(table(s, d, "part").drop("p_name"))),
    ),
    "import_max_rows": lambda s, d: ws.import_table(
        table(s, d, "orders").select("o_orderkey", "o_orderstatus"), max_rows=50, order_by="o_orderkey"
    ),
    "import_group": _group_import,
    "select_distinct": lambda s, d: ws.run_command(
        table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), "distinct"
    ),
    "command_order_by": lambda s, d: ws.run_command(table(s, d, "supplier"), "order", "s_name"),
    "row_selection_semi": _selection,
    "join_shared": lambda s, d: ws.join_shared(
        table(s, d, "nation").withColumnRenamed("n_regionkey", "regionkey"),
        table(s, d, "region").withColumnRenamed("r_regionkey", "regionkey"),
    ),
}

def _answer(text: str, passes: bool) -> str:
    rows = f"(SELECT count(*) FROM ({text}) q)" if passes and text.startswith(("SELECT", "WITH")) else "NULL::BIGINT"
    return "SELECT '" + text.replace("'", "''") + f"' AS statement, {str(passes).lower()} AS allowed, {rows} AS result_rows"


SQL = {
    "sql_cell_functions": profile.SQL["cell_coercion"],
    "guard_statements": " UNION ALL ".join(_answer(*g) for g in GUARDED),
    **BOTH,
    "sql_math_functions": BOTH["sql_math_functions"].replace(*_FLOOR["sql_math_functions"]),
    "sql_date_functions": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""",
    "sql_json_functions": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, COUNT(*) AS n FROM events GROUP BY 1",
    "sql_group_concat": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "sql_ilike": "SELECT COUNT(*) AS n FROM part WHERE p_name ILIKE '%A%' AND p_brand ILIKE 'brand#1%'",
    "sql_named_parameters": "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_orderpriority",
    "sql_text_import": """SELECT p_brand, COUNT(*) AS n, ROUND(SUM(p_retailprice), 2) AS total, MIN(CAST(p_size AS VARCHAR)) AS least FROM part GROUP BY p_brand""",
    "preset_all_rows": "SELECT * FROM supplier",
    "preset_row_count": "SELECT COUNT(*) AS row_count FROM lineitem",
    "preset_group_count": "SELECT p_brand, COUNT(*) AS row_count FROM part GROUP BY p_brand",
    "preset_top5": "SELECT p_type, COUNT(*) AS row_count FROM part GROUP BY p_type ORDER BY row_count DESC, p_type LIMIT 5",
    "preset_join_shared": "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "pick_group_column": "SELECT p_type, COUNT(*) AS row_count FROM part GROUP BY p_type",
    "import_max_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 50",
    "import_group": """SELECT 'nation' AS table_name, 'n_nationkey,n_name,n_regionkey' AS columns, count(*) AS imported_rows FROM nation
 UNION ALL SELECT 'region', 'r_regionkey,r_name', count(*) FROM region
 UNION ALL SELECT 'supplier', 's_suppkey,s_name,s_nationkey,s_acctbal', count(*) FROM supplier""",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "command_order_by": "SELECT * FROM supplier ORDER BY s_name",
    "row_selection_semi": """WITH b AS (SELECT p_partkey, p_retailprice, p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS brand FROM part)
SELECT p_partkey FROM b WHERE EXISTS (SELECT 1 FROM b c WHERE c.p_retailprice > 950 AND c.brand = b.brand AND c.p_size = b.p_size)""",
    "join_shared": "SELECT n_regionkey AS regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
}
