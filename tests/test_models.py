import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import classification, clustering, features, neighbours, pca, profile, regression, results
from tabwright.plans import blocks


@pytest.fixture(scope="module")
def line(text_table):
    return text_table("x,y\n" + "\n".join(f"{k},{2 * k}" for k in range(1, 13)))


@pytest.fixture(scope="module")
def mixed(text_table):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        region = rng.choice(["N", "S", "E"])
        units = rng.randint(1, 50)
        rows.append(f"{region},{units},{units * 3 + {'N': 10, 'S': -5, 'E': 0}[region]}")
    return text_table("region,units,revenue\n" + "\n".join(rows))


def test_linear(line):
    got = regression.run_regression(line, "y", ["x"], "i")
    m = got.metrics.first()
    assert (m["r2"], m["mae"]) == (1.0, 0.0) and (m["train_rows"], m["test_rows"]) == (9, 3)
    assert got.importance.first()["importance"] == 2.0
    assert regression.actual_and_residuals(got.predictions).agg(F.max(F.abs("residual"))).first()[0] == 0.0


@pytest.mark.parametrize("algorithm", list(regression.ALGORITHMS))
def test_regression_sweep(mixed, algorithm):
    got = regression.run_regression(mixed, "revenue", ["region", "units"], "i", algorithm, options={"trees": 5, "max_depth": 6})
    m = got.metrics.first()
    assert m["r2"] > 0.7 and m["rmse"] >= m["mae"] and got.importance.count() >= 1


def test_feature_names_and_errors(mixed, text_table):
    prepared = features.prepare(mixed, ["region", "units"], "i", "revenue")
    assert prepared.names == ["units", "region=E", "region=N", "region=S"] and prepared.n == 60
    with pytest.raises(ValueError, match="must be numeric"):
        features.prepare(mixed, ["units"], "i", "region")
    with pytest.raises(ValueError, match="also be a feature"):
        features.prepare(mixed, ["units"], "i", "units")
    with pytest.raises(ValueError, match="not found"):
        features.prepare(mixed, ["nope"], "i", "units")
    with pytest.raises(ValueError, match="at least 4"):
        features.prepare(text_table("a,b\n1,2\n2,\n3,4\n4,5"), ["b"], "i", "a")


def test_eligible_features(text_table):
    df = text_table("t,a,b,c\n1,1,,x\n2,2,,x\n3,3,5,x").drop("i")
    types = profile.column_types(df)
    chosen, removed = features.eligible_features(types, "t", df.columns)
    assert chosen == ["a"] and removed == {"b": ["67% missing", "constant values"], "c": ["constant values"]}
    assert features.drop_sparsest(["a", "b"], types) == (["a"], ["b"])
    assert features.numeric_targets(types) and "c" not in features.numeric_targets(types)


@pytest.fixture(scope="module")
def classes(text_table):
    rng = random.Random(1)
    rows = []
    for k in range(80):
        g = k % 2
        rows.append(f"{rng.gauss(3 * g, 1):.3f},{rng.gauss(-2 * g, 1):.3f},{'ab'[g]}")
    return text_table("x1,x2,group\n" + "\n".join(rows))


@pytest.mark.parametrize("algorithm", list(classification.ALGORITHMS))
def test_classification_sweep(classes, algorithm):
    got = classification.run_classification(classes, "group", ["x1", "x2"], "i", algorithm, options={"trees": 5, "max_depth": 5, "fourier_features": 32})
    m = got.metrics.first()
    assert m["test_rows"] == 16 and m["accuracy"] > 0.75
    assert {r["actual"] for r in got.confusion.collect()} == {"a", "b"}
    report = got.report.collect()
    assert sum(r["support"] for r in report) == 16 and [r["support"] for r in report] == [8, 8]
    c = results.confidence_summary(got.predictions).first()
    assert c["available"] and 0.4 <= c["minimum"] <= c["average"] <= c["maximum"] <= 1.0


def test_many_classes(text_table):
    df = text_table("f1,f2,label\n" + "\n".join(f"{k},{k % 7},c{k % 15:02d}" for k in range(45)))
    got = classification.run_classification(df, "label", ["f1", "f2"], "i", "naive_bayes")
    assert "15 classes" in got.message and got.report.count() == 0


def test_metrics_by_hand(spark):
    pairs = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 2)], "actual string, predicted string, n bigint")
    m = classification.classification_metrics(pairs).first()
    precision = (4 * 3 / 5 + 2 * 2 / 3 + 0) / 8
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.625, round(precision, 4), 0.625)
    wide = {r["actual"]: (r["a"], r["b"], r["c"]) for r in classification.confusion_matrix(pairs, ["a", "b", "c"]).collect()}
    assert wide == {"a": (3, 1, 0), "b": (0, 2, 0), "c": (2, 0, 0)}


def silhouette_by_hand(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        same = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
        if not same:
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block", [8192, 20])
def test_silhouette_exact(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "MAX_BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    labels = np.asarray([k % 3 for k in range(39)] + [3])
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(40)], "idx bigint, vec array<double>, cluster int")
    assert clustering.silhouette(df).first()[0] == pytest.approx(silhouette_by_hand(x, labels), abs=1e-4)
    one = df.withColumn("cluster", F.lit(0))
    assert clustering.silhouette(one).first()[0] is None


def test_silhouette_copies_a_row_few_times():
    """What is shuffled is rows times pieces: 16 times fewer pieces than blocks of 2048 rows give, but enough for all cores."""
    assert clustering._pieces(600_000, 12) == 19 and clustering._pieces(20_000, 12) == 5 and clustering._pieces(10, 12) == 1


@pytest.mark.parametrize("algorithm", ["kmeans", "hierarchical"])
def test_clustering(text_table, algorithm):
    df = text_table(
        "x,y,group\n1.0,1.1,a\n1.2,0.9,a\n0.8,1.0,a\n8.0,8.1,b\n8.2,7.9,b\n7.9,8.0,b\n15.0,1.0,c\n15.2,1.1,c"
    )
    got = clustering.run_clustering(df, ["x", "y"], "i", algorithm, 3, max_k=5, starts=2)
    labels = {r["idx"]: r["cluster"] for r in got.assignments.collect()}
    assert len(labels) == 8 and set(labels.values()) == {0, 1, 2}
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] == labels[5] and labels[6] == labels[7]
    assert sorted(r["rows"] for r in got.sizes.collect()) == [2, 3, 3]
    elbow = [(r["k"], r["inertia"]) for r in got.elbow.orderBy("k").collect()]
    assert [k for k, _ in elbow] == [1, 2, 3, 4, 5] and elbow[0][1] == pytest.approx(16.0) and got.silhouette.first()[0] > 0.8


def test_ward_condensed(spark):
    """More distinct rows than micro-centres: still finds well separated groups."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, size=(60, 2)) for c in ((0, 0), (9, 9), (0, 9))])
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, v array<double>").select(
        "idx", array_to_vector("v").alias("scaled")
    )
    got = {r["idx"]: r["cluster"] for r in clustering.ward(rows, 3, 1, micro=20).collect()}
    assert [len({got[i] for i in range(a, a + 60)}) for a in (0, 60, 120)] == [1, 1, 1] and len(set(got.values())) == 3


def test_pca(text_table):
    df = text_table("a,b,c\n1,2,3\n2,4,6\n3,6,9\n4,8,12\n5,10,15")
    got = pca.run_pca(df, ["a", "b", "c"], "i", 2)
    assert got.components.first()["explained_variance_ratio"] == 1.0 and got.summary.first()["total_explained_variance"] > 0.9
    rows = got.projections.orderBy("idx").collect()
    assert len(rows) == 5 and len(rows[0]["projection"]) == 2
    assert rows[0]["projection"][0] == pytest.approx(-math.sqrt(6), abs=1e-3)
    weights = [r["weight"] for r in got.loadings.filter("component = 'PC1'").collect()]
    assert weights == [0.5774] * 3


@pytest.mark.parametrize("pivot_rows,block", [(2048, 8192), (30, 16)])
def test_nearest_exact(spark, monkeypatch, pivot_rows, block):
    """A third of the base rows are copies of one vector; the answer stays exact."""
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", pivot_rows)
    monkeypatch.setattr(blocks, "MAX_BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 4))
    base[::3] = base[0]
    asked = rng.normal(size=(50, 4))
    to = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, vec array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in neighbours.nearest(to(asked), to(base), 5).collect()}
    gaps = np.round(np.sqrt(((asked[:, None] - base[None]) ** 2).sum(-1)), 9)
    order = np.argsort(gaps, axis=1, kind="stable")
    assert got == {(q, k + 1): int(order[q, k]) for q in range(50) for k in range(5)}


def test_forests_grow_deep_and_fine_by_default(spark, monkeypatch):
    forest = regression.ALGORITHMS["random_forest"].build(1, {})[-1]
    assert (forest.getMaxDepth(), forest.getMaxBins()) == (16, 256)
    asked = {}
    monkeypatch.setattr(classification, "RandomForestClassifier", lambda **options: asked.update(options))
    monkeypatch.setattr(classification, "_scored", lambda split, stages: None)
    classification._forest(None, {})
    assert (asked["maxDepth"], asked["maxBins"]) == (16, 256)


def test_machines_keep_no_wide_rows(spark, classes):
    """Fourier features are worked out in every pass: what is kept is as wide as the rows, whatever the number of features."""
    sizes = []
    for count in (32, 512):
        kept = spark.sparkContext._jsc.sc().getRDDStorageInfo()
        before = sum(i.memSize() + i.diskSize() for i in kept)
        seen = []
        real = classification.hinge.fit
        try:
            classification.hinge.fit = lambda *a: (real(*a), seen.append(sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())))[0]
            classification.run_classification(classes, "group", ["x1", "x2"], "i", "svm", options={"fourier_features": count})
        finally:
            classification.hinge.fit = real
        sizes.append(seen[0] - before)
    assert sizes[1] < 4 * sizes[0]


def test_descend_finds_the_least_point():
    run = classification.hinge.descend(np.zeros(3), 100)
    scale, centre = np.array([1.0, 10.0, 100.0]), np.array([1.0, -2.0, 3.0])
    x = next(run)
    try:
        while True:
            x = run.send((float(scale @ (x - centre) ** 2), 2 * scale * (x - centre)))
    except StopIteration as end:
        assert np.allclose(end.value, centre, atol=1e-2)


def test_all_starts_share_their_passes(spark, monkeypatch):
    """Nine sizes of ten starts take no more passes than the slowest run; each fit is at rest and costs what its centres say."""
    from pyspark.ml.functions import array_to_vector

    passes = []
    real = clustering.summed
    monkeypatch.setattr(clustering, "summed", lambda *a: passes.append(1) or real(*a))
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in ((0, 0), (9, 9), (0, 9))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, v array<double>").select(
        "idx", array_to_vector("v").alias("scaled")
    )
    fits = clustering.kmeans_fits(rows, list(range(2, 11)), 42, starts=10)
    assert sorted(fits) == list(range(2, 11)) and len(passes) < 60
    for fit in fits.values():
        gaps = ((x[:, None] - fit.centres[None]) ** 2).sum(-1)
        assert fit.cost == pytest.approx(gaps.min(axis=1).sum())
        for c in range(len(fit.centres)):
            assert np.allclose(fit.centres[c], x[gaps.argmin(axis=1) == c].mean(axis=0), atol=1e-3)
    assert fits[3].cost == pytest.approx(sum(((x[k : k + 40] - x[k : k + 40].mean(axis=0)) ** 2).sum() for k in (0, 40, 80)))
    assert sorted(r["count"] for r in fits[3].transform(rows).groupBy("cluster").count().collect()) == [40, 40, 40]


def test_nearest_of_many_equal_rows(spark, monkeypatch):
    """Few distinct rows, each many times: ties go to the least ids, and every copy of a query has its answer; copies are not compared."""
    seen = []
    real = neighbours._nearest_distinct
    monkeypatch.setattr(neighbours, "_nearest_distinct", lambda q, b, k: seen.append((q.count(), b.count())) or real(q, b, k))
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 4)
    x = np.array([(i % 7, i % 3) for i in range(420)], dtype=float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, vec array<double>")
    got = {}
    for r in neighbours.nearest(rows.filter("idx % 5 = 0"), rows.filter("idx % 5 != 0"), 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    base = [j for j in range(420) if j % 5]
    for q in range(0, 420, 5):
        want = sorted(base, key=lambda j: (round(float(np.sqrt(((x[q] - x[j]) ** 2).sum())), 9), j))[:3]
        assert [j for _, j in sorted(got[q])] == want
    assert len(got) == 84 and seen == [(21, 63)]


def _noise(spark, rows: int):
    rng = np.random.default_rng(5)
    made = [(i, float(a), float(b), "xyz"[k], float(a * 3 + b + e)) for i, (a, b, k, e) in enumerate(
        zip(rng.integers(0, 400, rows), rng.normal(size=rows), rng.integers(0, 3, rows), rng.normal(size=rows)))]
    return spark.createDataFrame(made, "i bigint, x1 double, x2 double, group string, y double")


def test_passes_of_a_forest_do_not_grow_with_depth(spark):
    """On noise a deep tree has as many nodes as rows; they are grown where their rows are, not level by level over all rows."""
    df, jobs, context = _noise(spark, 600), [], spark.sparkContext
    for depth in (2, 16):
        context.setJobGroup(f"forest-{depth}", "forest")
        options = {"max_depth": depth, "trees": 8}
        classification.run_classification(df, "group", ["x1", "x2"], "i", "random_forest", options=options).metrics.collect()
        regression.run_regression(df, "y", ["x1", "x2"], "i", "random_forest", options=options).metrics.collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    context.setJobGroup("other", "other")
    # Two fits of 14 more levels; exchanges that are read as broadcasts make a few jobs more.
    assert jobs[1] - jobs[0] < 10


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forest_of_split_roots_is_the_same(spark, monkeypatch, kind):
    """Roots too large for a task are split by added histograms first; the forest stays what it was."""
    from tabwright.operators import forest

    df, seen, kept, real = _noise(spark, 500), [], [], forest._blocks
    # Draws go by block, so both forests read the same ones.
    monkeypatch.setattr(forest, "_blocks", lambda rows: kept[0] if kept else kept.append(real(rows)) or kept[0])
    for size in (forest.NODE_BYTES, 1 << 10):
        monkeypatch.setattr(forest, "NODE_BYTES", size)
        options = {"trees": 5, "max_depth": 7, "bins": 32}
        if kind == "classification":
            got = classification.run_classification(df, "group", ["x1", "x2"], "i", "random_forest", options=options)
        else:
            got = regression.run_regression(df, "y", ["x1", "x2"], "i", "random_forest", options=options)
            assert got.importance.first()["feature"] == "x1" and got.metrics.first()["r2"] > 0.95
        seen.append({r["idx"]: round(r["predicted"], 6) if kind == "regression" else r["predicted"] for r in got.predictions.collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 100


def test_grown_tree_splits_as_brute_force():
    from tabwright.operators import forest

    rng = np.random.default_rng(8)
    cells, sums = rng.integers(0, 9, (60, 2)), rng.integers(0, 4, (60, 3)).astype(float) + [1, 0, 0]
    tree, _ = forest.grown(cells, sums, 3, 1, 2, [0])

    def impurity(part):
        return part.sum() - (part**2).sum() / part.sum()

    cost = {
        (f, b): impurity(sums[cells[:, f] <= b].sum(axis=0)) + impurity(sums[cells[:, f] > b].sum(axis=0))
        for f in range(2) for b in range(8)
    }
    assert cost[tree["feature"][0], tree["bin"][0]] == pytest.approx(min(cost.values()))
    deep, _ = forest.grown(cells, sums, 3, 16, 2, [0])
    for cell in np.unique(cells, axis=0):
        own = sums[(cells == cell).all(axis=1)].sum(axis=0)
        assert deep["value"][forest.route(deep, cell[None])[0]] == pytest.approx(own / own.sum())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_boxes_leave_out_no_neighbour(monkeypatch, width):
    """Ties and equal rows included, the boxes give what all distances give, and most distances are never worked out."""
    monkeypatch.setattr(neighbours, "BOX", 8)
    rng = np.random.default_rng(width)
    base, asked = np.round(rng.normal(size=(600, width)), 1), np.round(rng.normal(size=(90, width)), 1)
    parts = neighbours.boxes(base, 8)
    assert max(map(len, parts)) <= 8 and sorted(np.concatenate(parts).tolist()) == list(range(600))
    count = []
    real = neighbours._gaps
    monkeypatch.setattr(neighbours, "_gaps", lambda a, b: count.append(len(a) * len(b)) or real(a, b))
    row, column, near = neighbours._nearest_in_boxes(asked, base, 4)
    assert width > 2 or sum(count) < 90 * 600 / 2
    gaps = np.round(np.sqrt(((asked[:, None] - base[None]) ** 2).sum(-1)), 9)
    order = np.argsort(gaps, axis=1, kind="stable")[:, :4]
    assert (column.reshape(90, 4) == order).all() and (near.reshape(90, 4) == np.take_along_axis(gaps, order, axis=1)).all()


def test_few_queries_look_over_the_plane_between_two_pivots(spark, monkeypatch):
    """Queries far from a cell's side of the plane between the pivots do not go there, though the cell's ball reaches them."""
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 40)
    rng = np.random.default_rng(5)
    base, asked = rng.random((2000, 2)), rng.random((300, 2))
    to = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, vec array<double>")
    met = []
    real = neighbours._match
    monkeypatch.setattr(neighbours, "_match", lambda q, *rest: met.append(q.count()) or real(q, *rest))
    got = {(r["query"], r["rank"]): r["neighbour"] for r in neighbours.nearest(to(asked), to(base), 3).collect()}
    gaps = np.round(np.sqrt(((asked[:, None] - base[None]) ** 2).sum(-1)), 9)
    order = np.argsort(gaps, axis=1, kind="stable")
    assert got == {(q, k + 1): int(order[q, k]) for q in range(300) for k in range(3)}
    # Balls alone would send a query to some seven other cells.
    assert met[0] == 300 and met[1] < 3 * 300


def test_boxes_of_one_centre_are_added_whole():
    """Sums, counts and cost are those of all rows, on lattices with ties too; most rows are never laid against the centres."""
    rng = np.random.default_rng(4)
    for width, grain in ((2, None), (2, 0), (1, 1), (4, 1)):
        x = rng.normal(size=(20_000, width))
        x = x if grain is None else np.round(x, grain)
        dealt = blocks.boxes(x, 64)
        x, starts = x[np.concatenate(dealt)], np.cumsum([0, *map(len, dealt[:-1])])
        centres = x[rng.choice(len(x), 5, replace=False)]
        total, cost = np.zeros((5, width + 1)), np.zeros(1)
        left = clustering._add_boxes(clustering.Boxes.of(x, starts), clustering.Boxes.of(x, starts[:: clustering.GROUP]), centres, total, cost)
        assert width > 2 or len(left) < len(x) / 2
        clustering._add_rows(left, centres, total, cost)
        gaps = ((x[:, None] - centres[None]) ** 2).sum(-1)
        near = blocks.squared_distances(x, centres).argmin(axis=1)
        assert cost[0] == pytest.approx(gaps.min(axis=1).sum(), rel=1e-9)
        assert total[:, -1].tolist() == np.bincount(near, minlength=5).tolist()
        for axis in range(width):
            assert np.allclose(total[:, axis], np.bincount(near, weights=x[:, axis], minlength=5), atol=1e-7)


def test_k_means_passes_read_rows_in_boxes(spark, monkeypatch):
    """The fits over boxed blocks, small ones too, are those over plain rows; wide rows have no boxes."""
    from pyspark.ml.linalg import Vectors

    from tabwright.plans import packed

    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 2)) + 4 * rng.integers(0, 3, size=(900, 1))
    rows = spark.createDataFrame([(Vectors.dense(v.tolist()),) for v in x], ["scaled"]).coalesce(1)
    monkeypatch.setattr(packed, "BLOCK", 300)
    fits = clustering.kmeans_fits(rows, [2, 3, 4], 42, 2)
    for k, fit in fits.items():
        near = ((x[:, None] - fit.centres[None]) ** 2).sum(-1)
        assert len(fit.centres) == k and fit.cost == pytest.approx(near.min(axis=1).sum(), rel=1e-9)
        assert np.allclose(fit.centres, [x[near.argmin(axis=1) == c].mean(axis=0) for c in range(k)], atol=1e-3)
    made = packed.boxed(rows.selectExpr("array(1d, 2d) AS vec")).collect()
    assert sum(r["n"] for r in made) == 900 and all(len(r["extra"]) for r in made)
    wide = packed.boxed(spark.range(5).selectExpr("array_repeat(cast(id AS double), 9) AS vec")).collect()
    assert sum(r["n"] for r in wide) == 5 and not any(len(r["extra"]) for r in wide)
