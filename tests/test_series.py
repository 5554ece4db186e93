import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import forecast as fc
from tabwright.operators import likelihood, plugins, similarity
from tabwright.plans import blocks, split
from tabwright.plans.ordering import positions_by_label, positions_by_range, with_lags
from tabwright.plans.split import allocate, mark_test_rows, split_rows, stratifiable


@pytest.fixture(scope="module")
def sales(text_table):
    return text_table("date,sales\n" + "\n".join(f"2024-{k:02d}-01,{100 + 5 * k}" for k in range(1, 13)))


def test_moving_average_literal(sales):
    got = fc.forecast(sales, "date", "sales", "i", fc.ForecastSpec(periods=4))
    m = got.metrics.first()
    assert (m["mae"], m["rmse"], m["mape"], m["train_rows"], m["test_rows"]) == (13.7037, 14.0692, 8.7933, 9, 3)
    history = got.history.orderBy("pos").collect()
    assert [r["forecast"] for r in history[-3:]] == [140, 141.6667, 142.2222] and history[0]["forecast"] is None
    future = got.future.orderBy("step").collect()
    assert [(r["label"], r["forecast"]) for r in future] == [("F+1", 155), ("F+2", 156.6667), ("F+3", 157.2222), ("F+4", 156.2963)]


@pytest.mark.parametrize("algorithm", list(fc.ALGORITHMS))
def test_sweep(sales, algorithm):
    spec = fc.ForecastSpec(algorithm, order=(1, 1, 1), seasonal_period=4, periods=3)
    got = fc.forecast(sales, "date", "sales", "i", spec)
    assert got.history.count() == 12 and got.future.count() == 3 and got.metrics.first()["mae"] >= 0


def test_errors(sales, text_table):
    with pytest.raises(ValueError, match="at least 12"):
        fc.forecast(sales.limit(8), "date", "sales", "i")
    with pytest.raises(ValueError, match="seasonal_period"):
        fc.forecast(sales, "date", "sales", "i", fc.ForecastSpec("sarimax"))
    with pytest.raises(ValueError, match="SARIMAX with seasonal"):
        fc.forecast(sales, "date", "sales", "i", fc.ForecastSpec("sarimax", seasonal_period=6))
    with pytest.raises(ValueError, match="not found"):
        fc.forecast(sales, "nope", "sales", "i")


def test_ar_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for key in ("a", "b"):
        y = np.cumsum(rng.normal(size=120)) + 40
        rows += [(key, len(rows) + i, dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(y)]
        x = np.column_stack([np.ones(117)] + [y[3 - k : 120 - k] for k in (1, 2, 3)])
        beta = np.linalg.lstsq(x, y[3:], rcond=None)[0]
        h = list(y)
        for _ in range(4):
            h.append(beta[0] + sum(beta[k] * h[-k] for k in (1, 2, 3)))
        want[key] = h[-4:]
    df = spark.createDataFrame(rows, "k string, i long, day date, v double")
    got = fc.forecast(df, "day", "v", "i", fc.ForecastSpec("autoregressive", periods=4), ["k"])
    for key in want:
        values = [r["forecast"] for r in got.future.filter(F.col("k") == key).orderBy("step").collect()]
        assert values == pytest.approx(want[key], abs=1e-3)


def test_arima_recovers_process(spark):
    """An ARMA(1,1) process: the fitted one-step weights are near the true ones."""
    rng = np.random.default_rng(2)
    e, y = rng.normal(size=4000), np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "pos long, value double").select(
        F.lit("future").alias("scope"), "pos", "value", F.lit(4000).alias("size"), F.lit(3).alias("steps")
    )
    row = fc._arima(df, ["scope"], (1, 0, 1), None).first()
    assert row["weights"][0] == pytest.approx(0.7, abs=0.05) and abs(row["impulses"][0]) > 0
    assert row["impulses"][0] == pytest.approx(0.4 * e[-1], abs=0.15)


def _dense(z, free, orders):
    """The criterion by the covariance matrix of all values."""
    phi, theta, mean = (x[0] for x in likelihood.coefficients(np.asarray(free, dtype=float)[None], orders))
    reach, n = 4000, len(z)
    psi = np.zeros(reach)
    psi[0] = 1
    for t in range(1, reach):
        back = psi[max(0, t - len(phi)) : t][::-1]
        psi[t] = phi[: len(back)] @ back + (theta[t - 1] if t <= len(theta) else 0)
    cov = np.array([psi[: reach - k] @ psi[k:] for k in range(n)])[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    x = np.asarray(z) - mean
    return np.log(x @ np.linalg.solve(cov, x) / n) + np.linalg.slogdet(cov)[1] / n


@pytest.mark.parametrize("orders", [
    likelihood.Orders(1, 0, 1, 1, 0, 1, 4), likelihood.Orders(2, 1, 0), likelihood.Orders(0, 1, 2, 1, 1, 0, 3), likelihood.Orders(0, 0, 0),
])
def test_likelihood_of_blocks_is_dense_likelihood(orders):
    rng = np.random.default_rng(3)
    z, free = rng.normal(size=37), rng.normal(size=(2, orders.free))
    cuts, rows = [0, 10, 20, 30, 37], []
    for i in (2, 0, 3, 1):
        s, b, last = likelihood.follow([z[cuts[i] : cuts[i + 1]]], free[None], orders)
        rows.append({"block": i, "length": cuts[i + 1] - cuts[i], "size": 2, "trials": free.ravel(), "s": s.ravel(), "b": b.ravel(), "last": last.ravel()})
    value, _, _ = likelihood.criterion(free, *likelihood.combined(pd.DataFrame(rows), "block", orders), orders)
    assert value == pytest.approx([_dense(z, f, orders) for f in free], abs=1e-9)


def _seasonal(rng, n, phi, seasonal, season):
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(season + 1, n + 200):
        y[t] = phi * y[t - 1] + seasonal * y[t - season] - phi * seasonal * y[t - season - 1] + e[t]
    return y[200:]


def test_seasonal_fit_is_multiplicative_and_a_maximum(spark):
    """Parameters near the true ones, lag 5 the product of lags 1 and 4, no neighbour better; the cut into blocks is irrelevant."""
    rng = np.random.default_rng(5)
    series = {"a": _seasonal(rng, 1500, 0.5, 0.6, 4), "b": _seasonal(rng, 40, -0.4, 0.3, 4)}
    df = spark.createDataFrame([(k, i, float(v)) for k, ys in series.items() for i, v in enumerate(ys)], "k string, pos long, value double")
    orders = likelihood.Orders(1, 0, 0, seasonal_p=1, season=4)
    fits = {r["k"]: r for r in likelihood.fit(df, ["k"], orders, block=300, run=4).collect()}
    whole = {r["k"]: r for r in likelihood.fit(df, ["k"], orders).collect()}
    told = {r["k"]: r for r in likelihood.parameters(spark.createDataFrame(list(fits.values())), ["k"], orders).collect()}
    assert all(r["converged"] for r in fits.values())
    for k in fits:
        assert fits[k]["free"] == pytest.approx(whole[k]["free"], abs=1e-6)
        ar = told[k]["ar"]
        assert ar[4] == pytest.approx(-ar[0] * ar[3]) and ar[1:3] == pytest.approx([0, 0])
    assert told["a"]["ar"][0] == pytest.approx(0.5, abs=0.08) and told["a"]["ar"][3] == pytest.approx(0.6, abs=0.08)
    assert abs(told["a"]["ar"][4]) > 0.2 and told["a"]["variance"] == pytest.approx(1, abs=0.1)
    r = fits["b"]
    z = (series["b"] - r["centre"]) / r["scale"]
    best = _dense(z, r["free"], orders)
    for i in range(3):
        for step in (-1e-2, 1e-2):
            moved = list(r["free"])
            moved[i] += step
            assert _dense(z, moved, orders) > best
    assert r["loglik"] == pytest.approx(-20 * (best + 1 + np.log(2 * np.pi)) - 40 * np.log(r["scale"]), abs=1e-6)


def test_fit_of_odd_series(spark):
    """A constant series, a very short one, no difference left to model, and an empty table."""
    rows = [("flat", i, 7.0) for i in range(20)] + [("short", i, float(i * i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, pos long, value double")
    got = {r["k"]: r for r in likelihood.fit(df, ["k"], likelihood.Orders(1, 1, 1)).collect()}
    assert got["flat"]["rows"] == 19 and got["short"]["rows"] == 2 and got["flat"]["scale"] == 1
    walk = likelihood.fit(df.where("k = 'short'"), ["k"], likelihood.Orders(0, 1, 0)).first()
    assert walk["converged"] and walk["variance"] == pytest.approx((1 + 9) / 2)
    assert likelihood.fit(df.where("false"), ["k"], likelihood.Orders(1, 0, 0)).count() == 0


def test_forecast_follows_from_likelihood(spark):
    """Differenced twice over and seasonal: the recurrence gives the conditional expectation."""
    rng = np.random.default_rng(8)
    y = np.cumsum(_seasonal(rng, 60, 0.4, 0.5, 4)) + 100
    orders = likelihood.Orders(1, 1, 1, seasonal_p=1, season=4)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "k int, pos long, value double")
    fits = likelihood.fit(df, ["k"], orders, block=16)
    tails = spark.createDataFrame([(0, [float(v) for v in y[-7:]])], "k int, tail array<double>")
    r = likelihood.recurrences(fits, tails, ["k"], orders).first()
    got = fc._recurrence(r["weights"], r["intercept"], r["tail"], r["impulses"], 0, 6)
    fit = fits.first()
    phi, theta, _ = (x[0] for x in likelihood.coefficients(np.asarray(fit["free"])[None], orders))
    w, n = np.diff(y), 59
    psi = np.zeros(4000)
    psi[0] = 1
    for t in range(1, 4000):
        back = psi[max(0, t - len(phi)) : t][::-1]
        psi[t] = phi[: len(back)] @ back + (theta[t - 1] if t <= len(theta) else 0)
    auto = np.array([psi[: 4000 - k] @ psi[k:] for k in range(n + 6)])
    cov = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    solved = np.linalg.solve(cov, w)
    want = y[-1] + np.cumsum([auto[n + h - np.arange(n)] @ solved for h in range(6)])
    assert got == pytest.approx(want, abs=1e-6)


def test_recurrence_blocks():
    weights, tail, impulses = [0.5, 0.3, 0.1], [1.0, 2.0, 3.0], [0.1, 0.2]
    whole = fc._recurrence(weights, 0.2, tail, impulses, 0, 50)
    pieces = [v for s in range(0, 50, 7) for v in fc._recurrence(weights, 0.2, tail, impulses, s, min(7, 50 - s))]
    assert np.allclose(whole, pieces)


def test_positions_and_lags_with_hot_label(spark):
    """Half of the rows share one label; groups stay bounded by the chunk size."""
    rows = spark.range(500).withColumn("d", F.when(F.col("id") % 2 == 0, "2024-01-05").otherwise(F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string"))))
    want = {r["id"]: k for k, r in enumerate(sorted(rows.collect(), key=lambda r: (r["d"], r["id"])))}
    for got in (positions_by_label(rows, [], "d", "id", chunk=32), positions_by_range(rows, ["d", "id"])):
        assert {r["id"]: r["pos"] for r in got.collect()} == want
    lagged = with_lags(spark.range(100).withColumn("k", F.col("id") % 2).withColumn("p", F.floor(F.col("id") / 2)), ["k"], "p", {"l": ("id", 3)}, block=5)
    assert all(r["l"] == (r["id"] - 6 if r["p"] >= 3 else None) for r in lagged.collect()) and lagged.count() == 100


@pytest.mark.parametrize("bucket_rows", [100_000, 10])
def test_split(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(split, "BUCKET_ROWS", bucket_rows)
    rows = spark.range(1000).withColumn("c", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    sizes = {"a": 334, "b": 666}
    got = split_rows(rows, ["id"], 0.2, 1, 1000, sizes, "c")
    counts = {(r["c"], r["is_test"]): r["count"] for r in got.groupBy("c", "is_test").count().collect()}
    assert counts == {("a", True): 67, ("b", True): 133, ("a", False): 267, ("b", False): 533}
    again = split_rows(rows.repartition(7), ["id"], 0.2, 1, 1000, sizes, "c")
    pick = lambda d: {r["id"] for r in d.filter("is_test").collect()}
    assert pick(got) == pick(again) != pick(split_rows(rows, ["id"], 0.2, 2, 1000, sizes, "c"))
    assert not stratifiable({"a": 1, "b": 9}, 0.3) and not stratifiable({"a": 9}, 0.3) and stratifiable({"a": 5, "b": 5}, 0.3)
    assert allocate({"a": 5, "b": 6}, 3) == {"a": 1, "b": 2}
    assert mark_test_rows(rows, ["id"], 0, 1, 1000).filter("is_test").count() == 0


@pytest.fixture(scope="module")
def items(text_table):
    return text_table("tree,height,width\noak,3,4\nash,4,3\nfir,5,12")


def test_similarity_literal(items):
    """Right-angled triangles: cosines are 24/25, 63/65 and 56/65, of the columns 84 / (13 sqrt 50)."""
    rows = similarity.numeric_rows(items, ["height", "width"], "i", "tree")
    best = similarity.top_pairs(rows, 3).orderBy(F.desc("score")).collect()
    assert [(r["left"], r["right"], r["score"]) for r in best] == [("oak", "fir", 0.9692), ("oak", "ash", 0.96), ("ash", "fir", 0.8615)]
    assert similarity.column_cosine(items, ["height", "width"]).first()["score"] == 0.9138
    assert similarity.matrix_preview(rows).first()["values"][:2] == [1.0, 0.96]
    text = similarity.numeric_rows(items, ["tree"], "i")
    assert not similarity.suitability(text, 1).first()["suitable"]
    assert similarity.numeric_rows(items, ["height"], "i").orderBy("idx").first()["label"] == "row 1"
    assert "two numeric feature" in similarity.suitability(similarity.numeric_rows(items, ["height"], "i"), 1, "item").first()["note"]


@pytest.mark.parametrize("pivot_rows,block", [(2048, 8192), (25, 12)])
def test_top_pairs_exact(spark, monkeypatch, pivot_rows, block):
    """Exact with hot copies: a third of all rows are the same vector."""
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", pivot_rows)
    monkeypatch.setattr(blocks, "MAX_BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[::3] = x[0]
    x[7] = 0
    df = spark.createDataFrame([(i, f"r{i}", v.tolist()) for i, v in enumerate(x)], "idx bigint, label string, vec array<double>")
    norm = np.linalg.norm(x, axis=1)
    u = x / np.where(norm == 0, 1, norm)[:, None]
    score = np.round(np.clip(u @ u.T, -1, 1), 4)
    for n in (5, 500):
        want = sorted(((i, j, score[i, j]) for i in range(90) for j in range(i + 1, 90)), key=lambda p: (-p[2], p[0], p[1]))[:n]
        got = [(r["i"], r["j"], r["score"]) for r in similarity.top_pairs(df, n).orderBy(F.desc("score"), "i", "j").collect()]
        assert got == [(i, j, pytest.approx(s, abs=1e-9)) for i, j, s in want]


def test_plugins_literal(text_table):
    rows = [("2020-05-0%d" % d, 7 * d + 30 * (d % 3 == 0), 90 - d * d, "xy"[d % 2]) for d in range(1, 8)]
    df = text_table("date,revenue,cost,label\n" + "\n".join(",".join(map(str, r)) for r in rows))
    # The last three days bring 35, 72 and 49.
    assert plugins.run_plugin(df, "demand_forecast", "i").first()["metrics"]["forecast"] == "52.0"
    assert plugins.run_plugin(df, "fraud_detection", "i").first()["metrics"]["flagged_rows"] == "0"
    assert plugins.run_plugin(df, "customer_churn", "i").first()["summary"].startswith("Churn classifier trained on label")
    assert {r["name"]: r["applicable"] for r in plugins.list_plugins(df, "i").collect()} == {
        "anomaly_detection": True, "customer_churn": True, "fraud_detection": True, "demand_forecast": True,
    }
    bad = text_table("name,notes\nann,long text\nbob,other")
    with pytest.raises(ValueError, match="numeric column"):
        plugins.run_plugin(bad, "anomaly_detection", "i")
    with pytest.raises(ValueError, match="Unknown plugin"):
        plugins.run_plugin(df, "nope", "i")


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 2))
    x[:5] += 25
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    got = plugins.anomaly_flags(df, ["a", "b"], "i")
    flagged = {r["i"] for r in got.filter("anomaly").collect()}
    assert len(flagged) == 10 and {0, 1, 2, 3, 4} <= flagged


def test_top_pairs_of_equal_scores(spark, monkeypatch):
    """Rows of nearly one direction: all pairs score 1.0, the least ids win, and no blocks of later rows meet."""
    monkeypatch.setattr(similarity, "PROBE", 8)
    monkeypatch.setattr(blocks, "MAX_BLOCK", 16)
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 16)
    met = []
    real = similarity._across_blocks
    monkeypatch.setattr(similarity, "_across_blocks", lambda *a: met.append(real(*a)) or met[-1])
    rows = [(i, f"r{i}", [1.0, 1e-3 + 1e-6 * ((i * 37) % 101)]) for i in range(200)]
    df = spark.createDataFrame(rows, "idx bigint, label string, vec array<double>")
    got = [(r["i"], r["j"], r["score"]) for r in similarity.top_pairs(df, 5).orderBy(F.desc("score"), "i", "j").collect()]
    assert got == [(0, j, 1.0) for j in range(1, 6)] and met == [None]


def test_top_pairs_that_later_rows_win(spark, monkeypatch):
    """The best pairs hold no probed row, and tie."""
    monkeypatch.setattr(similarity, "PROBE", 4)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(blocks, "MAX_BLOCK", 8)
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x[40:44] = x[30:34] * 2 + 1e-9
    df = spark.createDataFrame([(i, f"r{i}", v.tolist()) for i, v in enumerate(x)], "idx bigint, label string, vec array<double>")
    u = x / np.sqrt((x**2).sum(1))[:, None]
    s = np.round(np.clip(u @ u.T, -1, 1), 4)
    want = sorted(((-s[i, j], i, j) for i in range(60) for j in range(i + 1, 60)))[:7]
    got = [(-r["score"], r["i"], r["j"]) for r in similarity.top_pairs(df, 7).orderBy(F.desc("score"), "i", "j").collect()]
    assert got == want


def test_one_series_is_not_dealt_by_scope(spark):
    """Means of an unkeyed series are broadcast: a shuffle by scope has two tasks with rows, whatever its length."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scoped = spark.range(40).selectExpr("IF(id % 2 = 0, 'future', 'holdout') AS scope", "id div 2 AS pos", "id * 1.5D AS value", "20L AS size", "5 AS steps")
        plan = fc._autoregressive(scoped, ["scope"], 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan
