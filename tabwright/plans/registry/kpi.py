"""KPI queries over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import kpi
from tabwright.sources.tables import table

ROLES = kpi.KpiRoles(
    revenue="o_totalprice",
    date="o_orderdate",
    location="o_orderpriority",
    customer="o_custkey",
    service="o_orderstatus",
)
LINE_ROLES = kpi.KpiRoles(
    revenue="l_extendedprice",
    cost="l_cost",
    date="l_shipdate",
    technician="l_suppkey",
    category="l_returnflag",
    location="l_linestatus",
    customer="l_partkey",
)


def orders(spark, folder):
    return table(spark, folder, "orders")


def base(spark, folder):
    return kpi.kpi_base(orders(spark, folder), ROLES)


def messy_orders(spark, folder):
    """Orders as text with missing and odd revenue cells."""
    key = F.col("o_orderkey")
    revenue = (
        F.when(key % 11 == 0, F.lit("N/A"))
        .when(key % 13 == 0, F.lit("unknown"))
        .otherwise(F.format_number("o_totalprice", 2))
    )
    day = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return orders(spark, folder).select(
        day.alias("order_date"),
        revenue.alias("total_revenue"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("client"),
        F.col("o_orderpriority").alias("city"),
    )


def lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn(
        "l_cost", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4)
    )


QUERIES = {
    "kpi_summary": lambda s, d: kpi.kpi_summary(orders(s, d), ROLES),
    "kpi_summary_text": lambda s, d: kpi.kpi_summary(messy_orders(s, d)),
    "kpi_summary_lines": lambda s, d: kpi.kpi_summary(lines(s, d), LINE_ROLES),
    "kpi_totals": lambda s, d: kpi.kpi_totals(base(s, d)),
    "kpi_revenue_by_month": lambda s, d: kpi.revenue_by_month(base(s, d)),
    "kpi_revenue_by_period": lambda s, d: kpi.revenue_by_period(base(s, d)),
    "kpi_growth_forecast": lambda s, d: kpi.growth_and_forecast(base(s, d)),
    "kpi_repeat_customers": lambda s, d: kpi.repeat_customers(base(s, d)),
    "kpi_top_dimension": lambda s, d: kpi.top_dimension(base(s, d), "location"),
    "kpi_top_customers": lambda s, d: kpi.top_dimension(base(s, d), "customer"),
    "kpi_best_service": lambda s, d: kpi.best_service(base(s, d)).select(
        "service", F.round("revenue", 2).alias("revenue")
    ),
    "kpi_busiest_month": lambda s, d: kpi.busiest_month(base(s, d)).select(
        F.date_format("month", "MMMM yyyy").alias("month"), F.round("revenue", 2).alias("revenue")
    ),
    "kpi_suitability": lambda s, d: kpi.suitability(messy_orders(s, d)),
}


def _summary_sql(source: str) -> str:
    """KPI cards over a CTE with columns rev, cost, day, cust, svc."""
    return f"""
WITH b AS ({source}),
m AS (SELECT date_trunc('month', day) AS mo, sum(rev) AS r FROM b WHERE day IS NOT NULL GROUP BY 1),
t AS (SELECT round(sum(rev), 2) AS tr, round(sum(cost), 2) AS tc, count(*) AS n FROM b),
l AS (SELECT max(CASE WHEN k = 1 THEN r END) AS cur, max(CASE WHEN k = 2 THEN r END) AS prev
      FROM (SELECT r, row_number() OVER (ORDER BY mo DESC) AS k FROM m)),
c AS (SELECT count(*) AS rep FROM (SELECT cust FROM b WHERE cust IS NOT NULL GROUP BY cust HAVING count(*) > 1)),
bm AS (SELECT strftime(mo, '%B %Y') AS txt FROM m ORDER BY r DESC, mo LIMIT 1),
bs AS (SELECT svc || ' (' || regexp_replace(CAST(CAST(round(r, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '') || ')' AS txt
       FROM (SELECT svc, sum(rev) AS r FROM b WHERE svc IS NOT NULL GROUP BY svc) ORDER BY r DESC, svc LIMIT 1),
g AS (SELECT CASE WHEN prev <> 0 THEN round((cur - prev) / prev * 100, 2) END AS growth,
             round(cur + (cur - prev), 2) AS nxt FROM l),
pct AS (SELECT CASE WHEN tr = 0 THEN 0.0 ELSE round(round(tr - tc, 2) / tr * 100, 2) END AS p FROM t),
u AS (
 SELECT 0 AS position, 'Total revenue' AS label, (SELECT tr FROM t) AS amount, NULL AS text, 'currency' AS unit
 UNION ALL SELECT 1, 'Total cost', (SELECT tc FROM t), NULL, 'currency'
 UNION ALL SELECT 2, 'Gross margin', (SELECT round(tr - tc, 2) FROM t), NULL, 'currency'
 UNION ALL SELECT 3, 'Profit', (SELECT round(tr - tc, 2) FROM t), NULL, 'currency'
 UNION ALL SELECT 4, 'Margin %', (SELECT p FROM pct), NULL, 'percent'
 UNION ALL SELECT 5, 'Profit margin %', (SELECT p FROM pct), NULL, 'percent'
 UNION ALL SELECT 6, 'Average revenue', (SELECT round(tr / n, 2) FROM t), NULL, NULL
 UNION ALL SELECT 7, 'Average job value', (SELECT round(tr / n, 2) FROM t), NULL, 'currency'
 UNION ALL SELECT 8, 'Total jobs', (SELECT CAST(n AS DOUBLE) FROM t), NULL, NULL
 UNION ALL SELECT 9, 'January sales', (SELECT round(coalesce(sum(CASE WHEN month(mo) = 1 THEN r END), 0), 2) FROM m), NULL, 'currency'
 UNION ALL SELECT 10, 'Repeat customers', (SELECT CAST(rep AS DOUBLE) FROM c), NULL, NULL
 UNION ALL SELECT 11, 'Busiest month', NULL, coalesce((SELECT txt FROM bm), 'n/a'), NULL
 UNION ALL SELECT 12, 'Best performing service', NULL, coalesce((SELECT txt FROM bs), 'n/a'), NULL
 UNION ALL SELECT 13, 'Month-over-month growth', (SELECT growth FROM g), (SELECT CASE WHEN growth IS NULL THEN 'n/a' END FROM g), (SELECT CASE WHEN growth IS NOT NULL THEN 'percent' END FROM g)
 UNION ALL SELECT 14, 'Next month forecast', (SELECT nxt FROM g), (SELECT CASE WHEN nxt IS NULL THEN 'n/a' END FROM g), (SELECT CASE WHEN nxt IS NOT NULL THEN 'currency' END FROM g)
)
SELECT CAST(position AS INTEGER) AS position, label, CAST(amount AS DOUBLE) AS amount,
       CAST(text AS VARCHAR) AS text, CAST(unit AS VARCHAR) AS unit FROM u
"""


_ORDERS_CTE = """SELECT o_totalprice AS rev, 0.0::DOUBLE AS cost, o_orderdate AS day,
 CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS svc FROM orders"""
_MONTHS = "SELECT date_trunc('month', o_orderdate) AS mo, sum(o_totalprice) AS r FROM orders GROUP BY 1"

SQL = {
    "kpi_summary": _summary_sql(_ORDERS_CTE),
    "kpi_summary_text": _summary_sql(
        """SELECT round(o_totalprice, 2) AS rev, 0.0::DOUBLE AS cost, o_orderdate AS day,
 CAST(o_custkey AS VARCHAR) AS cust, CAST(NULL AS VARCHAR) AS svc
 FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"""
    ),
    "kpi_summary_lines": _summary_sql(
        """SELECT l_extendedprice AS rev, round(l_extendedprice * l_discount, 4) AS cost, l_shipdate AS day,
 CAST(l_partkey AS VARCHAR) AS cust, l_returnflag AS svc FROM lineitem"""
    ),
    "kpi_totals": """
SELECT tr AS total_revenue, tc AS total_cost, n AS total_jobs, round(tr - tc, 2) AS gross_margin,
       round(round(tr - tc, 2) / tr * 100, 2) AS margin_pct, round(tr / n, 2) AS average_revenue
FROM (SELECT round(sum(o_totalprice), 2) AS tr, 0.0::DOUBLE AS tc, count(*) AS n FROM orders)""",
    "kpi_revenue_by_month": f"SELECT strftime(mo, '%Y-%m') AS label, round(r, 2) AS revenue FROM ({_MONTHS})",
    "kpi_revenue_by_period": f"""
WITH m AS ({_MONTHS})
SELECT 'month' AS period, strftime(mo, '%Y-%m') AS label, 0 AS position, round(r, 2) AS revenue FROM m
UNION ALL SELECT 'year', strftime(mo, '%Y'), 0, round(sum(r), 2) FROM m GROUP BY ALL
UNION ALL SELECT 'named_month', strftime(mo, '%B'), CAST(month(mo) AS INTEGER), round(sum(r), 2) FROM m GROUP BY ALL""",
    "kpi_growth_forecast": f"""
WITH m AS ({_MONTHS}), l AS (
 SELECT max(CASE WHEN k = 1 THEN r END) AS cur, max(CASE WHEN k = 2 THEN r END) AS prev
 FROM (SELECT r, row_number() OVER (ORDER BY mo DESC) AS k FROM m))
SELECT round((cur - prev) / prev * 100, 2) AS growth_pct, round(cur + (cur - prev), 2) AS next_month FROM l""",
    "kpi_repeat_customers": """
SELECT count(*) AS repeat_customers FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""",
    "kpi_top_dimension": """
SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS jobs FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "kpi_top_customers": """
SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS jobs FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "kpi_best_service": """
SELECT o_orderstatus AS service, round(sum(o_totalprice), 2) AS revenue FROM orders
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 1""",
    "kpi_busiest_month": f"SELECT strftime(mo, '%B %Y') AS month, round(r, 2) AS revenue FROM ({_MONTHS}) ORDER BY r DESC, mo LIMIT 1",
    "kpi_suitability": """
SELECT count(*) AS row_count, 'total_revenue' AS revenue_column, CAST(NULL AS VARCHAR) AS cost_column,
 'order_date' AS date_column, 'Business KPIs calculated successfully.' AS suitability_note FROM orders""",
}
