"""Model, metric, split and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import classification as cl
from tabwright.operators import clustering, pca, regression, reports
from tabwright.operators.features import prepare, standardise
from tabwright.plans.split import split_rows
from tabwright.plans.registry.profile import PART_COLUMNS, _types_sql
from tabwright.sources.tables import table

def judged(spark, folder):
    """Labels as a prediction table: quality against a guess from the text length."""
    labels, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    guess = F.when(F.col("n_chars") > 2000, "good").when(F.col("n_chars") > 300, "fair").otherwise("bad")
    actual = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("fair")
    return labels.join(docs, "doc_id").select("doc_id", actual.alias("actual"), guess.alias("predicted"))


def predicted_prices(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted")
    )


def lines(spark, folder):
    """Line items with a number made of their own key (an order has at most seven lines)."""
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("line_no")
    return table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag", number)


def _regress(algorithm: str):
    return lambda s, d: regression.run_regression(
        lines(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"], "line_no", algorithm
    ).metrics


def _classify(algorithm: str):
    return lambda s, d: cl.run_classification(
        table(s, d, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey"], "o_orderkey", algorithm
    ).metrics


def _split_counts(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    sizes = {r[0]: r[1] for r in rows.groupBy("o_orderpriority").count().collect()}
    marked = split_rows(rows, ["o_orderkey"], 0.2, 42, sum(sizes.values()), sizes, "o_orderpriority")
    return marked.groupBy("o_orderpriority").agg(
        F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows")
    )


def _plain_split(spark, folder):
    rows = lines(spark, folder).select("line_no")
    marked = split_rows(rows, ["line_no"], 0.25, 7, rows.count())
    return marked.agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


def _scaled(spark, folder):
    """Sums over the standardised, one-hot encoded part table."""
    prepared = prepare(table(spark, folder, "part"), ["p_retailprice", "p_size", "p_type"], "p_partkey")
    from pyspark.ml.functions import vector_to_array

    rows = standardise(prepared).select(F.posexplode(vector_to_array("scaled")).alias("axis", "v"))
    names = F.array(*(F.lit(n) for n in prepared.names))
    return rows.groupBy("axis").agg(
        F.round(F.abs(F.avg("v")), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation")
    ).select(F.element_at(names, F.col("axis") + 1).alias("feature"), "mean", "deviation")


def _cluster(algorithm: str, part: str):
    def run(spark, folder):
        prepared = prepare(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey", minimum=3)
        rows = standardise(prepared).select("idx", "scaled").persist()
        if part == "elbow":
            found = clustering.elbow(rows, prepared.n, 10, 42)
            rows.unpersist()
            return found
        if algorithm == "kmeans":
            assigned = clustering.best_kmeans(rows, 3, 42).transform(rows)
        else:
            assigned = clustering.ward(rows, 3, 42)
        return clustering.cluster_sizes(assigned, 3)

    return run


def _pca(part: str):
    return lambda s, d: getattr(pca.run_pca(lines(s, d), ["l_quantity", "l_extendedprice"], "line_no", 2), part)


def _quick(part: str):
    def run(spark, folder):
        df = table(spark, folder, "orders").select(
            "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"
        )
        return getattr(reports.quick_scan(df, "o_orderkey", 1, "orders.csv"), part)

    return run


def _exact_fit(algorithm: str):
    """A target that the model can fit without error: the metrics are then known."""

    def run(spark, folder):
        q, d = F.col("l_quantity"), F.col("l_discount") * 100
        target = q * 3 - d * 2 + 7 if algorithm == "linear" else q * q + q * d - d * 4 + 1
        rows = lines(spark, folder).withColumns({"tenths": d, "made": target})
        return regression.run_regression(rows, "made", ["l_quantity", "tenths"], "line_no", algorithm).metrics

    return run


def parted(spark, folder):
    """Orders with two columns that tell their status apart: the groups lie far from each other."""
    place = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1000).otherwise(5000)
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", (place + F.col("o_custkey") % 7).alias("first"), (place - F.col("o_custkey") % 5).alias("second")
    )


def _parted_class(algorithm: str):
    return lambda s, d: cl.run_classification(
        parted(s, d), "o_orderstatus", ["first", "second"], "o_orderkey", algorithm
    ).metrics


def _parted_clusters(algorithm: str):
    def run(spark, folder):
        prepared = prepare(parted(spark, folder), ["first", "second"], "o_orderkey", minimum=3)
        rows = standardise(prepared).select("idx", "scaled")
        if algorithm == "kmeans":
            assigned = clustering.best_kmeans(rows, 3, 42).transform(rows)
        else:
            assigned = clustering.ward(rows, 3, 42, method="exact" if algorithm == "exact" else "micro")
        return clustering.cluster_sizes(assigned, 3).select("rows")

    return run


def _loading_sizes(spark, folder):
    return _pca("loadings")(spark, folder).select("component", "feature", F.abs("weight").alias("size"))


def _importance(spark, folder):
    fit = regression.run_regression(
        lines(spark, folder).withColumn("doubled", F.col("l_quantity") * 2 + 3), "doubled", ["l_quantity"], "line_no"
    )
    return fit.importance.select("feature", F.round("importance", 3).alias("importance"))


QUERIES = {
    "confusion_from_labels": lambda s, d: cl.pair_counts(judged(s, d)),
    "confusion_matrix": lambda s, d: cl.confusion_matrix(cl.pair_counts(judged(s, d)), ["bad", "fair", "good"]),
    "class_report": lambda s, d: cl.class_report(cl.pair_counts(judged(s, d))),
    "class_metrics": lambda s, d: cl.classification_metrics(cl.pair_counts(judged(s, d))),
    "regression_metrics": lambda s, d: regression.regression_metrics(predicted_prices(s, d)),
    "split_stratified": _split_counts,
    "split_plain": _plain_split,
    "features_standardised": _scaled,
    "regression_importance": _importance,
    **{f"regression_{a}": _regress(a) for a in regression.ALGORITHMS},
    **{f"classify_{a}": _classify(a) for a in cl.ALGORITHMS},
    "cluster_kmeans_sizes": _cluster("kmeans", "sizes"),
    "cluster_ward_sizes": _cluster("hierarchical", "sizes"),
    "cluster_elbow": _cluster("kmeans", "elbow"),
    **{f"regression_exact_{a}": _exact_fit(a) for a in ("linear", "polynomial")},
    **{f"classify_parted_{a}": _parted_class(a) for a in cl.ALGORITHMS},
    **{f"cluster_parted_{a}": _parted_clusters(a) for a in ("kmeans", "hierarchical", "exact")},
    "pca_loading_sizes": _loading_sizes,
    "pca_components": _pca("components"),
    "pca_loadings": _pca("loadings"),
    "pca_projections": lambda s, d: _pca("projections")(s, d).select(
        "idx", F.element_at("projection", 1).alias("pc1"), F.element_at("projection", 2).alias("pc2")
    ),
    "quick_scan_steps": _quick("steps"),
    "quick_scan_report": _quick("report"),
    "report_rows": lambda s, d: reports.table_report(table(s, d, "part"), "part.csv"),
    "report_json": lambda s, d: reports.json_report(reports.table_report(table(s, d, "part"), "part.csv")),
}

JUDGED = """j AS (SELECT CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE 'fair' END AS actual,
 CASE WHEN n_chars > 2000 THEN 'good' WHEN n_chars > 300 THEN 'fair' ELSE 'bad' END AS predicted FROM labels JOIN documents USING (doc_id))"""
RATES = f"""{JUDGED}, c AS (SELECT DISTINCT actual AS label FROM j UNION SELECT DISTINCT predicted FROM j),
r AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS hits, count(*) FILTER (actual = label) AS support,
 count(*) FILTER (predicted = label) AS claimed FROM c CROSS JOIN j GROUP BY label),
p AS (SELECT *, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM r),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"""
_EXACT = """SELECT '{}' AS algorithm, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS train_rows, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_rows, """
_PAIR = "FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)"

SQL = {
    "confusion_from_labels": f"WITH {JUDGED} SELECT actual, predicted, count(*) AS n FROM j GROUP BY ALL",
    "confusion_matrix": f"""WITH {JUDGED} SELECT v.actual, count(*) FILTER (predicted = 'bad') AS bad, count(*) FILTER (predicted = 'fair') AS fair,
 count(*) FILTER (predicted = 'good') AS good FROM (VALUES ('bad'), ('fair'), ('good')) v(actual) LEFT JOIN j USING (actual) GROUP BY 1""",
    "class_report": f"WITH {RATES} SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM f",
    "class_metrics": f"""WITH {RATES} SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(sum(precision * support) / sum(support), 4) AS precision,
 round(sum(recall * support) / sum(support), 4) AS recall, round(sum(f1 * support) / sum(support), 4) AS f1 FROM f""",
    "regression_metrics": """WITH p AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem)
SELECT round(avg(abs(a - b)), 4) AS mae, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse, round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(a)), 4) AS r2 FROM p""",
    "split_stratified": """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT *, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS want, sum(n) OVER () AS total FROM c),
s AS (SELECT *, n * want / total AS share, CAST(floor(n * want / total) AS BIGINT) AS base FROM t),
r AS (SELECT *, want - sum(base) OVER () AS rest, row_number() OVER (ORDER BY base - share, o_orderpriority) AS k FROM s)
SELECT o_orderpriority, CAST(base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS test_rows,
 CAST(n - base - CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS train_rows FROM r""",
    "split_plain": "SELECT CAST(ceil(count(*) * 0.25) AS BIGINT) AS test_rows, count(*) - CAST(ceil(count(*) * 0.25) AS BIGINT) AS train_rows FROM lineitem",
    "features_standardised": """SELECT 'p_retailprice' AS feature, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation UNION ALL SELECT 'p_size', 0.0, 1.0
 UNION ALL SELECT DISTINCT 'p_type=' || p_type, 0.0, 1.0 FROM part""",
    "regression_importance": "SELECT 'l_quantity' AS feature, round(regr_slope(l_quantity * 2 + 3, l_quantity), 3) AS importance FROM lineitem",
    **{
        f"regression_exact_{a}": _EXACT.format(a) + "0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2 FROM lineitem"
        for a in ("linear", "polynomial")
    },
    **{
        f"classify_parted_{a}": _EXACT.format(a) + "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM orders"
        for a in cl.ALGORITHMS
    },
    **{
        f"cluster_parted_{a}": "SELECT count(*) AS rows FROM orders GROUP BY o_orderstatus"
        for a in ("kmeans", "hierarchical", "exact")
    },
    "pca_loading_sizes": """SELECT component, feature, round(sqrt(count(*) / count(*) / 2.0), 4) AS size
 FROM lineitem, (VALUES ('PC1'), ('PC2')) c(component), (VALUES ('l_quantity'), ('l_extendedprice')) f(feature) GROUP BY component, feature""",
    "pca_components": f"SELECT 'PC1' AS component, round((1 + abs(r)) / 2, 4) AS explained_variance_ratio {_PAIR} UNION ALL SELECT 'PC2', round((1 - abs(r)) / 2, 4) {_PAIR}",
    "report_rows": f"""WITH {_types_sql('part', PART_COLUMNS)}
SELECT 'file' AS section, 'filename' AS name, 'part.csv' AS value UNION ALL SELECT 'file', 'rows', CAST(max(row_count) AS VARCHAR) FROM types
UNION ALL SELECT 'file', 'columns', CAST(count(*) AS VARCHAR) FROM types UNION ALL SELECT 'eda', 'missing_cells', CAST(sum(missing_count) AS VARCHAR) FROM types
UNION ALL SELECT 'eda', 'missing_percent', CAST(round(CAST(sum(missing_count) AS DOUBLE) / (max(row_count) * count(*)) * 100, 2) AS VARCHAR) FROM types
UNION ALL SELECT 'eda', 'duplicate_rows', CAST((SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS VARCHAR)
UNION ALL SELECT 'eda_column', "column", inferred_type FROM types""",
}
