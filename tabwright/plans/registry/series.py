"""Time-series, plugin and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.operators import forecast as fc
from tabwright.operators import plugins
from tabwright.operators.likelihood import Orders
from tabwright.plans.ordering import positions_by_label, positions_by_range, with_lags
from tabwright.sources.tables import table
from tabwright.streaming import events as ev

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def orders(spark, folder):
    return table(spark, folder, "orders")


def events(spark, folder):
    return table(spark, folder, "events")


def _by_user(spark, folder, spec=fc.ForecastSpec()):
    return fc.forecast(events(spark, folder), "ts", "value", "event_id", spec, ["user_id"])


def _whole(spark, folder, spec=fc.ForecastSpec()):
    return fc.forecast(orders(spark, folder), "o_orderdate", "o_totalprice", "o_orderkey", spec)


def daily_types(spark, folder):
    """Daily value per event type as a dated table with a unique order column."""
    days = events(spark, folder).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    order = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint") * 1000 + F.length("event_type")
    return days.withColumn("k", order)


def _stream_windows(spark, folder):
    """The hourly metrics of the event stream, run to the end into a parquet sink."""
    from tabwright.session import shared_folder

    source = events(spark, folder)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = shared_folder(spark, "stream_windows")
    counted = ev.windowed_metrics(stream, "ts", F.col("event_type"), F.col("value") * 50)
    query = (
        counted.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    closed = spark.read.schema(counted.schema).parquet(f"{out}/rows")
    return ev.with_open_windows(closed, source, "ts", F.col("event_type"), F.col("value") * 50).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "key", "requests", "slow"
    )


QUERIES = {
    "series_load": lambda s, d: fc.load_series(orders(s, d), "o_orderdate", "o_totalprice", "o_orderkey"),
    "series_positions": lambda s, d: positions_by_label(
        fc.load_series(orders(s, d), "o_orderdate", "o_totalprice", "o_orderkey"), [], "label", "o_orderkey", chunk=4096
    ).select("o_orderkey", "pos"),
    "series_positions_range": lambda s, d: positions_by_range(
        events(s, d).select("event_type", "ts", "event_id"), ["ts", "event_id"], keys=["event_type"]
    ).select("event_id", "pos"),
    "series_lags": lambda s, d: with_lags(
        positions_by_label(
            fc.load_series(orders(s, d), "o_orderdate", "o_totalprice", "o_orderkey"), [], "label", "o_orderkey"
        ),
        [], "pos", {"lag1": ("value", 1), "lag7": ("value", 7)}, block=1000,
    ).select("o_orderkey", "lag1", "lag7"),
    "series_split": lambda s, d: fc.split_sizes(
        fc.load_series(events(s, d), "ts", "value", "event_id", ["user_id"]), ["user_id"], 0.75
    ),
    "moving_average_forecast": lambda s, d: _whole(s, d).future.select("label", "forecast"),
    "moving_average_history": lambda s, d: _whole(s, d).history,
    "moving_average_by_user": lambda s, d: _by_user(s, d).future.select("user_id", "step", "forecast"),
    "forecast_metrics": lambda s, d: _by_user(s, d).metrics.select(
        "user_id", "row_count", "train_rows", "test_rows",
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 1).alias("mape"),
    ),
    "ar_forecast": lambda s, d: _whole(s, d, fc.ForecastSpec("autoregressive", ar_lags=1)).future.select(
        "step", F.round("forecast", 2).alias("forecast")
    ),
    "ar_forecast_by_user": lambda s, d: _by_user(s, d, fc.ForecastSpec("autoregressive", ar_lags=1)).future.select(
        "user_id", "step", F.round("forecast", 3).alias("forecast")
    ),
    "arima_forecast": lambda s, d: fc.forecast(
        daily_types(s, d), "day", "total", "k", fc.ForecastSpec("arima", order=(1, 1, 1)), ["event_type"]
    ).future,
    "sarimax_forecast": lambda s, d: fc.forecast(
        daily_types(s, d), "day", "total", "k", fc.ForecastSpec("sarimax", order=(1, 0, 1), seasonal_period=7), ["event_type"]
    ).future,
    "arima_110_fits": lambda s, d: fc.arima_fits(
        daily_types(s, d), "day", "total", "k", Orders(1, 1, 0), ["event_type"]
    ).select(
        "event_type", "rows", F.round(F.get("ar", F.lit(0)), 5).alias("ar"), F.round(F.log("variance"), 5).alias("log_variance"),
        F.round("loglik", 4).alias("loglik"), "converged",
    ),
    "arima_110_forecast": lambda s, d: fc.forecast(
        daily_types(s, d), "day", "total", "k", fc.ForecastSpec("arima", order=(1, 1, 0)), ["event_type"]
    ).future.select("event_type", "step", F.round("forecast", 2).alias("forecast")),
    "sarima_fits": lambda s, d: fc.arima_fits(
        daily_types(s, d), "day", "total", "k", Orders(1, 0, 1, seasonal_p=1, season=7), ["event_type"]
    ),
    "sarima_seasonal_fits": lambda s, d: fc.arima_fits(
        daily_types(s, d), "day", "total", "k", Orders(0, 0, 0, seasonal_p=1, seasonal_d=1, season=7), ["event_type"]
    ).select(
        "event_type", "rows", F.round(F.get("ar", F.lit(6)), 4).alias("ar7"), F.round("loglik", 3).alias("loglik"), "converged"
    ),
    "zscore_flags": lambda s, d: plugins.fraud_summary(table(s, d, "lineitem"), LINE_NUMBERS, "l_orderkey"),
    "zscore_rows": lambda s, d: plugins.fraud_flags(orders(s, d), ["o_totalprice", "o_custkey"], "o_orderkey").select(
        "o_orderkey", F.round("max_abs_z", 6).alias("max_abs_z"), "flagged"
    ),
    "demand_last3": lambda s, d: plugins.demand_forecast(orders(s, d), "o_totalprice", "o_orderkey"),
    "plugin_applicability": lambda s, d: plugins.list_plugins(table(s, d, "part"), "p_partkey").select(
        "name", "applicable", "reason"
    ),
    "plugin_fraud": lambda s, d: plugins.run_plugin(
        orders(s, d), "fraud_detection", "o_orderkey"
    ).select("summary"),
    "plugin_demand": lambda s, d: plugins.run_plugin(
        orders(s, d), "demand_forecast", "o_orderkey", {"value_column": "o_totalprice"}
    ).select("summary"),
    "plugin_churn": lambda s, d: plugins.churn_accuracy(table(s, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]),
    "anomaly_isolation_forest": lambda s, d: plugins.anomaly_summary(orders(s, d), ["o_totalprice", "o_custkey"], "o_orderkey"),
    "event_windows": lambda s, d: ev.windowed_metrics(
        events(s, d), "ts", F.col("event_type"), F.col("value") * 50
    ).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "key", "requests", "slow"),
    "stream_event_windows": _stream_windows,
}

SERIES = """s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, o_totalprice AS value, o_orderkey,
 row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"""
USERS = """s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) - 1 AS pos,
 count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT *, greatest(6, CAST(floor(n * 0.75) AS BIGINT)) AS tr FROM s)"""
USABLE = "n >= 12 AND tr < n - 2"
_TAIL = """max(CASE WHEN pos = e - 3 THEN value END) AS a, max(CASE WHEN pos = e - 2 THEN value END) AS b,
 max(CASE WHEN pos = e - 1 THEN value END) AS c"""
HOLDOUT = f"""{SERIES}, t AS (SELECT *, greatest(6, CAST(floor(n * 0.75) AS BIGINT)) AS e FROM s),
h AS (SELECT 0 AS k, {_TAIL}, max(n - e) AS steps FROM t),
r AS (SELECT k, a, b, c, steps FROM h),
w AS (WITH RECURSIVE g(k, a, b, c, steps) AS (SELECT * FROM r UNION ALL SELECT k + 1, b, c, (a + b + c) / 3, steps FROM g WHERE k < steps)
 SELECT k, c AS f FROM g WHERE k > 0)"""

# A stationary first-order autoregression's likelihood has one maximum, where g changes its sign: halve [-1, 1] 60 times.
_HALVED = """WITH RECURSIVE days AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY ALL),
r AS (SELECT event_type, total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM days),
x AS (SELECT *, total - lag(total, {lag}) OVER (PARTITION BY event_type ORDER BY pos) AS w FROM r),
y AS (SELECT *, lag(w, {lag}) OVER (PARTITION BY event_type ORDER BY pos) AS v FROM x WHERE w IS NOT NULL),
a AS (SELECT event_type, count(*) AS m, sum(w * w) AS s0, coalesce(sum(w * v), 0) AS s1,
 coalesce(sum(w * w) FILTER (v IS NOT NULL AND pos <= n - {lag}), 0) AS s2, {last} AS y0, {former} AS y1 FROM y WHERE n >= {least} GROUP BY event_type),
h(event_type, k, lo, hi) AS (SELECT event_type, 0, -1.0::DOUBLE, 1.0::DOUBLE FROM a UNION ALL
 SELECT h.event_type, k + 1, CASE WHEN g > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN g > 0 THEN (lo + hi) / 2 ELSE hi END
 FROM (SELECT h.*, m * (p * s2 - s1) * (1 - p * p) + {lag} * p * (s0 - 2 * p * s1 + p * p * s2) AS g
  FROM (SELECT *, (lo + hi) / 2 AS p FROM h) h JOIN a USING (event_type)) h WHERE k < 60),
f AS (SELECT a.*, lo AS phi, (s0 - 2 * lo * s1 + lo * lo * s2) / m AS var FROM h JOIN a USING (event_type) WHERE k = 60),
l AS (SELECT *, -m / 2.0 * (ln(2 * pi()) + 1 + ln(var)) + {lag} / 2.0 * ln(1 - phi * phi) AS loglik FROM f)
"""
_FIRST = _HALVED.format(
    lag=1, least=12, last="max(CASE WHEN pos = n THEN total END)", former="max(CASE WHEN pos = n - 1 THEN total END)"
)

SQL = {
    "arima_110_fits": _FIRST + """SELECT event_type, m AS rows, round(phi, 5) AS ar, round(ln(var), 5) AS log_variance, round(loglik, 4) AS loglik,
 true AS converged FROM l""",
    "arima_110_forecast": _FIRST + """, g(event_type, phi, k, b, c) AS (SELECT event_type, phi, CAST(0 AS BIGINT), y1, y0 FROM f
 UNION ALL SELECT event_type, phi, k + 1, c, c + phi * (c - b) FROM g WHERE k < 5)
SELECT event_type, k AS step, round(round(c, 4), 2) AS forecast FROM g WHERE k > 0""",
    "sarima_seasonal_fits": _HALVED.format(lag=7, least=14, last="0", former="0")
    + "SELECT event_type, m AS rows, round(phi, 4) AS ar7, round(loglik, 3) AS loglik, true AS converged FROM l",
    "series_load": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, o_totalprice AS value, o_orderkey FROM orders",
    "series_positions": f"WITH {SERIES} SELECT o_orderkey, pos FROM s",
    "series_positions_range": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events",
    "series_lags": f"WITH {SERIES} SELECT o_orderkey, lag(value) OVER (ORDER BY pos) AS lag1, lag(value, 7) OVER (ORDER BY pos) AS lag7 FROM s",
    "series_split": f"""WITH {USERS} SELECT DISTINCT user_id, n, tr AS train_rows,
 CASE WHEN n < 12 THEN 'Need at least 12 dated rows for time series forecasting' WHEN tr >= n - 2 THEN 'Not enough rows after train/test split' END AS issue FROM t""",
    "moving_average_forecast": f"""WITH RECURSIVE {SERIES}, h AS (SELECT {_TAIL.replace('= e -', '= n -')} FROM s),
g(k, a, b, c) AS (SELECT 0, a, b, c FROM h UNION ALL SELECT k + 1, b, c, (a + b + c) / 3 FROM g WHERE k < 5)
SELECT 'F+' || k AS label, round(c, 4) AS forecast FROM g WHERE k > 0""",
    "moving_average_history": f"""WITH {HOLDOUT} SELECT pos, label, value AS actual, round(f, 4) AS forecast FROM t LEFT JOIN w ON w.k = pos - e + 1""",
    "moving_average_by_user": f"""WITH RECURSIVE {USERS}, h AS (SELECT user_id, {_TAIL.replace('= e -', '= n -')} FROM t WHERE {USABLE} GROUP BY user_id),
g(user_id, k, a, b, c) AS (SELECT user_id, CAST(0 AS BIGINT), a, b, c FROM h UNION ALL SELECT user_id, k + 1, b, c, (a + b + c) / 3 FROM g WHERE k < 5)
SELECT user_id, k AS step, round(c, 4) AS forecast FROM g WHERE k > 0""",
    "forecast_metrics": f"""WITH RECURSIVE {USERS}, h AS (SELECT user_id, {_TAIL.replace('= e -', '= tr -')}, max(n - tr) AS steps FROM t WHERE {USABLE} GROUP BY user_id),
g(user_id, k, a, b, c, steps) AS (SELECT user_id, CAST(0 AS BIGINT), a, b, c, steps FROM h UNION ALL SELECT user_id, k + 1, b, c, (a + b + c) / 3, steps FROM g WHERE k < steps)
SELECT t.user_id, max(n) AS row_count, max(tr) AS train_rows, max(n - tr) AS test_rows, round(round(avg(abs(value - c)), 4), 2) AS mae,
 round(round(sqrt(avg((value - c) * (value - c))), 4), 2) AS rmse, round(round(avg(CASE WHEN value <> 0 THEN abs((value - c) / value) END) * 100, 4), 1) AS mape
FROM t JOIN g ON t.user_id = g.user_id AND g.k = pos - tr + 1 AND g.k > 0 GROUP BY t.user_id""",
    "ar_forecast": f"""WITH RECURSIVE {SERIES}, l AS (SELECT *, lag(value) OVER (ORDER BY pos) AS x FROM s),
m AS (SELECT regr_slope(value, x) AS phi, regr_intercept(value, x) AS c, max(CASE WHEN pos = n - 1 THEN value END) AS y FROM l),
g(k, phi, c, y) AS (SELECT CAST(0 AS BIGINT), phi, c, y FROM m UNION ALL SELECT k + 1, phi, c, c + phi * y FROM g WHERE k < 5)
SELECT k AS step, round(round(y, 4), 2) AS forecast FROM g WHERE k > 0""",
    "ar_forecast_by_user": f"""WITH RECURSIVE {USERS}, l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS x FROM t WHERE {USABLE}),
m AS (SELECT user_id, regr_slope(value, x) AS phi, regr_intercept(value, x) AS c, max(CASE WHEN pos = n - 1 THEN value END) AS y FROM l GROUP BY user_id),
g(user_id, k, phi, c, y) AS (SELECT user_id, CAST(0 AS BIGINT), phi, c, y FROM m UNION ALL SELECT user_id, k + 1, phi, c, c + phi * y FROM g WHERE k < 5)
SELECT user_id, k AS step, round(round(y, 4), 3) AS forecast FROM g WHERE k > 0""",
    "zscore_flags": "WITH m AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUMBERS)
    + " FROM lineitem) SELECT count(*) FILTER (greatest("
    + ", ".join(f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in LINE_NUMBERS)
    + ") > 3) AS flagged_rows, count(*) AS row_count FROM lineitem, m",
    "zscore_rows": """WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b, avg(o_custkey) AS c, stddev_pop(o_custkey) AS d FROM orders),
z AS (SELECT o_orderkey, greatest(abs((o_totalprice - a) / b), abs((o_custkey - c) / d)) AS z FROM orders, m)
SELECT o_orderkey, round(z, 6) AS max_abs_z, z > 3 AS flagged FROM z""",
    "demand_last3": "SELECT round(avg(v), 4) AS forecast, count(*) AS observations FROM (SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey DESC LIMIT 3)",
    "plugin_applicability": """SELECT * FROM (VALUES ('anomaly_detection', true, NULL), ('customer_churn', (SELECT count(DISTINCT p_brand) <= 12 OR count(DISTINCT p_type) <= 12 OR count(DISTINCT p_name) <= 12 FROM part), NULL),
 ('fraud_detection', true, NULL), ('demand_forecast', false, 'Needs a date or time column.')) v(name, applicable, reason)""",
    "plugin_fraud": """WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b, avg(o_custkey) AS c, stddev_pop(o_custkey) AS d FROM orders)
SELECT 'Flagged ' || count(*) FILTER (greatest(abs((o_totalprice - a) / b), abs((o_custkey - c) / d)) > 3) || ' high-risk rows using z-score thresholds.' AS summary FROM orders, m""",
    "plugin_demand": """SELECT '3-period moving average forecast for o_totalprice: ' || printf('%.2f', round(avg(v), 4)) || '.' AS summary
 FROM (SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey DESC LIMIT 3)""",
    "event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS key, count(*) AS requests,
 count(*) FILTER (value * 50 >= 2000) AS slow FROM events GROUP BY ALL""",
    "stream_event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS key, count(*) AS requests,
 count(*) FILTER (value * 50 >= 2000) AS slow FROM events GROUP BY ALL""",
}
