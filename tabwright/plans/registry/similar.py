"""Similarity and neighbour queries over the embeddings and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import clustering, neighbours, similarity
from tabwright.sources.tables import table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TOP = 10


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def part_rows(spark, folder):
    return similarity.numeric_rows(table(spark, folder, "part"), ["p_size", "p_retailprice"], "p_partkey", "p_brand")


def _sides(spark, folder):
    """Queries and base as disjoint parts of the vectors: every fifth id asks, the others answer."""
    v = vectors(spark, folder)
    return v.filter(F.col("idx") % 5 == 0), v.filter(F.col("idx") % 5 != 0)


def _vote(spark, folder):
    queries, base = _sides(spark, folder)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("label"))
    return neighbours.vote(neighbours.nearest(queries, base, 5), labels)


def _nearest(spark, folder):
    queries, base = _sides(spark, folder)
    return neighbours.nearest(queries, base, 5).select("query", "neighbour", F.round("gap", 4).alias("gap"), "rank")


def _silhouette(spark, folder):
    v = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster")
    )
    return clustering.silhouette(v)


QUERIES = {
    "similar_top_pairs": lambda s, d: similarity.top_pairs(vectors(s, d), TOP),
    "similar_top_pairs_rows": lambda s, d: similarity.top_pairs(part_rows(s, d), TOP),
    "similar_matrix_preview": lambda s, d: similarity.matrix_preview(vectors(s, d)).select(
        "label", F.array_join(F.transform("values", lambda x: F.format_number(x, 4)), ";").alias("scores")
    ),
    "similar_suitability": lambda s, d: similarity.suitability(vectors(s, d), 64),
    "similar_numeric_rows": lambda s, d: part_rows(s, d).select("idx", "label", F.element_at("vec", 2).alias("second")),
    "column_cosine": lambda s, d: similarity.column_cosine(table(s, d, "lineitem"), LINE_NUMBERS),
    "knn_neighbours": _nearest,
    "knn_vote": _vote,
    "silhouette_labels": _silhouette,
}

UNIT = """u AS (SELECT vec_id AS idx, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
un AS (SELECT idx, list_transform(v, lambda x: x / n) AS v FROM (SELECT idx, v, sqrt(list_dot_product(v, v)) AS n FROM u))"""
_GAPS = """g AS (SELECT a.idx AS query, b.idx AS neighbour, b.label AS label, round(list_distance(a.v, b.v), 9) AS gap FROM u a CROSS JOIN u b WHERE a.idx % 5 = 0 AND b.idx % 5 <> 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, neighbour) AS rank FROM g QUALIFY rank <= 5)"""


def _cosine_sql() -> str:
    parts = []
    for i, a in enumerate(LINE_NUMBERS):
        for b in LINE_NUMBERS[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(least(1, sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})))), 4) AS score FROM lineitem"
            )
    return " UNION ALL ".join(parts)


SQL = {
    "similar_top_pairs": f"""WITH {UNIT}, p AS (SELECT a.idx AS i, b.idx AS j, round(least(1.0, greatest(-1.0, list_dot_product(a.v, b.v))), 4) AS score FROM un a JOIN un b ON a.idx < b.idx)
SELECT i, j, 'v' || i AS "left", 'v' || j AS "right", score FROM p ORDER BY score DESC, i, j LIMIT {TOP}""",
    "similar_top_pairs_rows": f"""WITH u AS (SELECT p_partkey AS idx, p_brand AS label, p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice) AS x,
 p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice) AS y FROM part),
p AS (SELECT a.idx AS i, b.idx AS j, a.label AS "left", b.label AS "right", round(least(1.0, a.x * b.x + a.y * b.y), 4) AS score FROM u a JOIN u b ON a.idx < b.idx)
SELECT * FROM p ORDER BY score DESC, i, j LIMIT {TOP}""",
    "similar_matrix_preview": f"""WITH {UNIT}, c AS (SELECT * FROM un ORDER BY idx LIMIT 5)
SELECT 'v' || a.idx AS label, string_agg(printf('%.4f', round(least(1.0, list_dot_product(a.v, b.v)), 4)), ';' ORDER BY b.idx) AS scores
FROM c a JOIN c b ON true GROUP BY a.idx""",
    "similar_suitability": """SELECT count(*) AS row_count, true AS suitable,
 'Cosine similarity computed successfully. Higher scores indicate more similar rows or items.' AS note FROM embeddings""",
    "similar_numeric_rows": "SELECT p_partkey AS idx, p_brand AS label, p_retailprice AS second FROM part",
    "column_cosine": _cosine_sql(),
    "knn_neighbours": f"WITH {UNIT}, {_GAPS} SELECT query, neighbour, round(gap, 4) AS gap, CAST(rank AS INTEGER) AS rank FROM nn",
    "knn_vote": f"""WITH {UNIT}, {_GAPS}, c AS (SELECT query, CAST(label AS VARCHAR) AS label, count(*) AS votes FROM nn GROUP BY 1, 2)
SELECT query, label AS predicted, round(votes / 5, 4) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1""",
    "silhouette_labels": f"""WITH {UNIT}, z AS (SELECT label, count(*) AS size FROM u GROUP BY 1),
t AS (SELECT a.idx, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM u a CROSS JOIN u b GROUP BY ALL),
r AS (SELECT idx, max(CASE WHEN own = other THEN total / nullif(size - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b FROM t JOIN z ON z.label = t.other GROUP BY idx)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM r""",
}
