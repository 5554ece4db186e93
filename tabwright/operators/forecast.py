"""Forecasts of dated series: moving average, AR, ARIMA and seasonal ARIMA.

Every algorithm ends in a linear recurrence: lag weights, an intercept and the
last observed values. Autoregressions are fitted with Spark aggregates (lag
windows over bounded blocks and sums of products), ARIMA and seasonal ARIMA by
exact likelihood over blocks (``likelihood``). A forecast of any length is cut
into blocks of steps that run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import cells
from tabwright.operators import likelihood
from tabwright.plans.ordering import positions_by_label, positions_by_range, with_lags
from tabwright.session import cut_lineage

MIN_SERIES = 12
STEP_BLOCK = 2048
ALGORITHMS = {
    "moving_average": ("Moving average", "Rolling mean forecast over recent observations."),
    "autoregressive": ("Autoregressive (AR)", "Linear autoregression on recent lags."),
    "arima": ("ARIMA", "AutoRegressive Integrated Moving Average model."),
    "sarimax": ("SARIMAX", "Seasonal ARIMA when a seasonal period is supplied."),
}
FIT_NOTES = {
    "moving_average": "exact recursive mean",
    "autoregressive": "conditional least squares",
    "arima": "exact Gaussian likelihood",
    "sarimax": "exact Gaussian likelihood with a multiplicative seasonal lag",
}


@dataclass(frozen=True)
class ForecastSpec:
    algorithm: str = "moving_average"
    window: int = 3
    ar_lags: int = 3
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal_period: int | None = None
    train_ratio: float = 0.75
    periods: int = 5


@dataclass(frozen=True)
class ForecastResult:
    """history: position, label, actual, forecast; future: label, forecast; metrics: one row per series."""

    history: DataFrame
    future: DataFrame
    metrics: DataFrame


def load_series(
    df: DataFrame, date: str, value: str, order_by: str, keys: list[str] | None = None
) -> DataFrame:
    """(keys, label, value, order_by): dated numeric rows; the label is the ISO day
    when the date parses and the raw text otherwise. Equal dates stay separate."""
    keys = keys or []
    field = cells.field_of(df, date)
    text = cells.text_of(field)
    label = F.coalesce(cells.day_label(cells.timestamp_of(field)), text)
    return df.select(
        *keys,
        label.alias("label"),
        cells.number_of(cells.field_of(df, value)).alias("value"),
        F.col(order_by),
    ).filter(F.col("label").isNotNull() & F.col("value").isNotNull())


def positioned(series: DataFrame, order_by: str, keys: list[str], calendar_labels: bool) -> DataFrame:
    """Add ``pos``, the 0-based place by (label, order_by) within each series."""
    if calendar_labels:
        return positions_by_label(series, keys, "label", order_by)
    return positions_by_range(series, ["label", order_by], keys=keys)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-series facts; the single unkeyed series joins on a constant."""
    if keys:
        return left.join(right, keys, how)
    tagged = left.withColumn("_one", F.lit(1)).join(
        F.broadcast(right.withColumn("_one", F.lit(1))), "_one", how
    )
    return tagged.drop("_one")


def split_sizes(series: DataFrame, keys: list[str], train_ratio: float) -> DataFrame:
    """(keys, n, train_rows, issue): chronological split sizes per series."""
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    train = F.greatest(F.lit(MIN_SERIES // 2), F.floor(F.col("n") * F.lit(train_ratio)))
    issue = F.when(
        F.col("n") < MIN_SERIES,
        f"Need at least {MIN_SERIES} dated rows for time series forecasting",
    ).when(train >= F.col("n") - 2, "Not enough rows after train/test split")
    return sizes.select(*keys, "n", train.alias("train_rows"), issue.alias("issue"))


def _scoped(series: DataFrame, sizes: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """Each series twice: its train part (holdout) and the whole (future)."""
    joined = _join(series, sizes, keys)
    scope = F.explode(
        F.when(F.col("pos") < F.col("train_rows"), F.array(F.lit("holdout"), F.lit("future"))).otherwise(
            F.array(F.lit("future"))
        )
    )
    holdout = F.col("scope") == "holdout"
    return joined.withColumn("scope", scope).select(
        *keys,
        "scope",
        "pos",
        "value",
        F.when(holdout, F.col("train_rows")).otherwise(F.col("n")).alias("size"),
        F.when(holdout, F.col("n") - F.col("train_rows")).otherwise(F.lit(periods)).alias("steps"),
    )


def _tails(rows: DataFrame, ids: list[str], column: str, length: int, name: str) -> DataFrame:
    """The last ``length`` values of a column per series, oldest first."""
    last = rows.filter(F.col("pos") >= F.col("size") - length)
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col(column).alias("v"))))
    return last.groupBy(*ids).agg(F.transform(ordered, lambda x: x["v"]).alias(name))


def _products(rows: DataFrame, ids: list[str], columns: list[str], target: str) -> DataFrame:
    """Normal-equation sums per series: upper triangle of X'X and X'y."""
    sums = [
        F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]
    ]
    return rows.groupBy(*ids).agg(
        F.array(*sums).alias("xx"),
        F.array(*(F.sum(F.col(a) * F.col(target)) for a in columns)).alias("xy"),
    )


def _solve(sums: DataFrame, ids: list[str], width: int) -> DataFrame:
    """Least-squares coefficients from normal-equation sums, one row per series."""
    schema = T.StructType(
        [sums.schema[i] for i in ids] + [T.StructField("beta", T.ArrayType(T.DoubleType()))]
    )

    def solve(batches):
        upper = np.triu_indices(width)
        for batch in batches:
            betas = []
            for xx, xy in zip(batch["xx"], batch["xy"]):
                normal = np.zeros((width, width))
                normal[upper] = xx
                normal = normal + normal.T - np.diag(np.diag(normal))
                scale = np.sqrt(np.where(np.diag(normal) > 0, np.diag(normal), 1.0))
                solved = np.linalg.pinv(normal / np.outer(scale, scale), rcond=1e-11) @ (
                    np.asarray(xy, dtype=float) / scale
                )
                betas.append((solved / scale).tolist())
            yield batch[ids].assign(beta=betas)

    return sums.mapInPandas(solve, schema)


def _recurrence(weights, intercept, tail, impulses, start, count):
    """Steps start+1 .. start+count of a linear recurrence, jumping to ``start``."""
    weights = np.asarray(weights, dtype=float)
    history = list(np.asarray(tail, dtype=float))
    reach = len(weights)
    done = []
    for extra in impulses:
        value = intercept + float(weights @ np.asarray(history[-1 : -reach - 1 : -1])) + extra
        history.append(value)
        done.append(value)
    out = done[start : start + count]
    skip = max(0, start - len(done))
    state = np.asarray(history[-1 : -reach - 1 : -1] + [1.0])
    if skip:
        step = np.zeros((reach + 1, reach + 1))
        step[0, :reach] = weights
        step[0, reach] = intercept
        step[1:reach, : reach - 1] += np.eye(reach - 1)
        step[reach, reach] = 1.0
        state = np.linalg.matrix_power(step, skip) @ state
    while len(out) < count:
        value = float(state[:reach] @ weights) + intercept
        state = np.concatenate(([value], state[: reach - 1], [1.0]))
        out.append(value)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _extend(
    weights: pd.Series, intercept: pd.Series, tail: pd.Series, impulses: pd.Series, start: pd.Series, count: pd.Series
) -> pd.Series:
    rows = zip(weights, intercept, tail, impulses, start, count)
    return pd.Series([_recurrence(w, c, t, i, int(s), int(k)) for w, c, t, i, s, k in rows])


def _run(models: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, step, forecast) with step 1, 2, ... from fitted recurrences.

    ``models`` has one row per series: weights, intercept, tail, impulses, steps.
    """
    blocks = models.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("steps") - 1) / STEP_BLOCK)))
    )
    start = F.col("block") * STEP_BLOCK
    count = F.least(F.lit(STEP_BLOCK), F.col("steps") - start)
    values = _extend("weights", "intercept", "tail", "impulses", start, count)
    return blocks.select(*ids, start.alias("start"), F.posexplode(values).alias("i", "forecast")).select(
        *ids, (F.col("start") + F.col("i") + 1).alias("step"), "forecast"
    )


def _moving_average(scoped: DataFrame, ids: list[str], window: int) -> DataFrame:
    facts = scoped.groupBy(*ids).agg(F.max("steps").alias("steps"))
    tails = _tails(scoped, ids, "value", window, "tail")
    size = F.size("tail")
    return facts.join(tails, ids).select(
        *ids,
        "steps",
        F.transform("tail", lambda _: F.lit(1.0) / size).alias("weights"),
        F.lit(0.0).alias("intercept"),
        "tail",
        F.array().cast("array<double>").alias("impulses"),
    )


def _lag_regression(rows: DataFrame, ids: list[str], value: str, lags: list[int], use: Column, intercept: bool, extra: list[str]) -> DataFrame:
    """Regress ``value`` on its lags and extra columns over the rows in ``use``."""
    names = [f"x{k}" for k in lags]
    columns = (["one"] if intercept else []) + names + extra
    ready = rows.filter(use).withColumn("one", F.lit(1.0))
    ready = ready.select(*ids, value, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    return _solve(_products(ready, ids, columns, value), ids, len(columns))


def _autoregressive(scoped: DataFrame, ids: list[str], lags: int) -> DataFrame:
    """AR(p) with intercept by conditional least squares on centred values.

    A short series uses fewer lags: at most its length minus two.
    """
    facts = scoped.groupBy(*ids).agg(
        F.max("steps").alias("steps"), F.max("size").alias("size"), F.avg("value").alias("mean")
    ).withColumn("p", F.least(F.lit(lags), F.greatest(F.lit(1), F.col("size") - 2)))
    # The two scopes of one series would put half of its rows into one task of a shuffled join.
    few = facts if len(ids) > 1 else F.broadcast(facts)
    centred = scoped.drop("steps", "size").join(few, ids).withColumn("c", F.col("value") - F.col("mean"))
    lagged = with_lags(centred, ids, "pos", {f"x{k}": ("c", k) for k in range(1, lags + 1)})
    for k in range(1, lags + 1):
        lagged = lagged.withColumn(f"x{k}", F.when(F.col("p") >= k, F.col(f"x{k}")))
    fitted = _lag_regression(
        lagged, ids, "c", list(range(1, lags + 1)), F.col("pos") >= F.col("p"), True, []
    )
    tails = _tails(centred, ids, "value", lags, "tail")
    weights = F.slice("beta", F.lit(2), F.size("tail"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return facts.join(fitted, ids).join(tails, ids).select(
        *ids,
        "steps",
        weights.alias("weights"),
        (F.get("beta", F.lit(0)) + F.col("mean") * (1 - total)).alias("intercept"),
        "tail",
        F.array().cast("array<double>").alias("impulses"),
    )


def _arima(scoped: DataFrame, ids: list[str], order: tuple[int, int, int], season: int | None) -> DataFrame:
    """ARIMA(p,d,q), with one multiplicative seasonal AR lag where there is a season, by exact likelihood."""
    orders = arima_orders(order, season)
    facts = scoped.groupBy(*ids).agg(F.max("steps").alias("steps"))
    tails = _tails(scoped, ids, "value", orders.width + orders.lost, "tail")
    fits = likelihood.fit(scoped.select(*ids, "pos", "value"), ids, orders)
    return facts.join(likelihood.recurrences(fits, tails, ids, orders), ids).select(
        *ids, "steps", "weights", "intercept", "tail", "impulses"
    )


def arima_orders(order: tuple[int, int, int], season: int | None = None) -> likelihood.Orders:
    """Orders of ARIMA, or of seasonal ARIMA with one seasonal AR lag."""
    return likelihood.Orders(*order, seasonal_p=1, season=season) if season else likelihood.Orders(*order)


def arima_fits(
    df: DataFrame, date: str, value: str, order_by: str, orders: likelihood.Orders, keys: list[str]
) -> DataFrame:
    """Parameters, likelihood and AIC of every series with enough rows to forecast (``likelihood.parameters``)."""
    calendar = cells.is_time_field(cells.field_of(df, date))
    series = positioned(load_series(df, date, value, order_by, keys), order_by, keys, calendar)
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(MIN_SERIES, 2 * orders.season))
    fits = likelihood.fit(series.join(sizes, keys).select(*keys, "pos", "value"), keys, orders)
    return likelihood.parameters(fits, keys, orders)


def _models(scoped: DataFrame, ids: list[str], spec: ForecastSpec) -> DataFrame:
    if spec.algorithm == "moving_average":
        return _moving_average(scoped, ids, spec.window)
    if spec.algorithm == "autoregressive":
        return _autoregressive(scoped, ids, spec.ar_lags)
    if spec.algorithm == "arima":
        return _arima(scoped, ids, spec.order, None)
    if spec.algorithm == "sarimax":
        return _arima(scoped, ids, spec.order, spec.seasonal_period)
    raise ValueError(f"Unsupported algorithm: {spec.algorithm}")


def forecast_metrics(scored: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "forecast") -> DataFrame:
    """MAE, RMSE and MAPE (non-zero actuals only) per series, 4 places."""
    error = F.col(actual) - F.col(predicted)
    share = F.when(F.col(actual) != 0, F.abs(F.try_divide(error, F.nullif(F.col(actual), F.lit(0.0)))))
    return (
        scored.filter(F.col(predicted).isNotNull())
        .groupBy(*keys)
        .agg(
            F.round(F.avg(F.abs(error)), 4).alias("mae"),
            F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
            F.round(F.avg(share) * 100, 4).alias("mape"),
        )
    )


def forecast(
    df: DataFrame, date: str, value: str, order_by: str, spec: ForecastSpec = ForecastSpec(), keys: list[str] | None = None
) -> ForecastResult:
    """Hold-out forecast, its metrics and the future values of one or many series.

    The unkeyed series raises when it is too short; with keys, short series are
    left out (see ``split_sizes`` for the reason per series).
    """
    keys = keys or []
    if spec.algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm: {spec.algorithm}")
    if spec.algorithm == "sarimax" and spec.seasonal_period is None:
        raise ValueError("seasonal_period is required for SARIMAX")
    calendar = cells.is_time_field(cells.field_of(df, date))
    series = positioned(load_series(df, date, value, order_by, keys), order_by, keys, calendar)
    sizes = split_sizes(series, keys, spec.train_ratio)
    if spec.algorithm == "sarimax":
        need = 2 * spec.seasonal_period
        sizes = sizes.withColumn(
            "issue",
            F.coalesce(
                "issue",
                F.when(
                    F.col("train_rows") < need,
                    f"Need at least {need} rows for SARIMAX with seasonal period {spec.seasonal_period}",
                ),
            ),
        )
    if not keys:
        row = sizes.first()
        if row is None or row["n"] == 0:
            raise ValueError("No valid dated numeric rows found")
        if row["issue"] is not None:
            raise ValueError(row["issue"])
    usable = sizes.filter(F.col("issue").isNull()).drop("issue")
    ids = [*keys, "scope"]
    # One small row per series, kept so that the three outputs share one fit.
    models = cut_lineage(_models(_scoped(series, usable, keys, spec.periods), ids, spec))
    predicted = _run(models, ids)
    holdout = predicted.filter("scope = 'holdout'").drop("scope")
    dated = _join(series, usable, keys).withColumn("step", F.col("pos") - F.col("train_rows") + 1)
    history = dated.join(holdout, [*keys, "step"], "left").select(
        *keys, "pos", "label", F.col("value").alias("actual"), F.round("forecast", 4).alias("forecast")
    )
    # Metrics use unrounded predictions.
    scored = dated.join(holdout, [*keys, "step"]).select(*keys, F.col("value").alias("actual"), "forecast")
    metrics = _join(
        usable.select(
            *keys,
            F.col("n").alias("row_count"),
            "train_rows",
            (F.col("n") - F.col("train_rows")).alias("test_rows"),
        ),
        forecast_metrics(scored, keys),
        keys,
    ).withColumn("fit", F.lit(FIT_NOTES[spec.algorithm]))
    future = predicted.filter("scope = 'future'").select(
        *keys, "step", F.concat(F.lit("F+"), F.col("step").cast("string")).alias("label"), F.round("forecast", 4).alias("forecast")
    )
    return ForecastResult(history, future, metrics)
