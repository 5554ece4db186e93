"""Principal components of standardised features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.features import prepare, standardise


@dataclass(frozen=True)
class PCAResult:
    components: DataFrame
    loadings: DataFrame
    summary: DataFrame
    projections: DataFrame


def run_pca(df: DataFrame, features: list[str], order_by: str, n_components: int = 2, projected: int | None = None) -> PCAResult:
    """Variance ratios, loadings and the projected rows (the first ``projected`` by order, where given).

    The sign of a component is fixed so that its largest loading is positive.
    """
    prepared = prepare(df, features, order_by, minimum=2, separator="_")
    rows = standardise(prepared).select("idx", "scaled").persist()
    k = min(n_components, len(prepared.names), prepared.n)
    model = PCA(k=k, inputCol="scaled", outputCol="projected").fit(rows)
    axes = np.asarray(model.pc.toArray())
    signs = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    ratios = [float(r) for r in model.explainedVariance]
    spark = df.sparkSession
    components = spark.createDataFrame(
        [(f"PC{i + 1}", round(r, 4)) for i, r in enumerate(ratios)], "component string, explained_variance_ratio double"
    )
    loadings = spark.createDataFrame(
        [
            (f"PC{i + 1}", name, round(float(axes[j, i] * signs[i]), 4))
            for i in range(k)
            for j, name in enumerate(prepared.names)
        ],
        "component string, feature string, weight double",
    )
    summary = spark.createDataFrame(
        [(prepared.n, k, round(sum(ratios), 4))], "row_count bigint, n_components int, total_explained_variance double"
    )
    turned = F.zip_with(
        vector_to_array("projected"), F.array(*(F.lit(float(s)) for s in signs)), lambda x, s: F.round(x * s, 4)
    )
    first = rows if projected is None else rows.orderBy("idx").limit(projected)
    projections = model.transform(first).select("idx", turned.alias("projection"))
    return PCAResult(components, loadings, summary, projections)
