"""Classification models with hold-out evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators import hinge, neighbours
from tabwright.operators.features import prepare, scaler
from tabwright.operators.forest import RandomForestClassifier
from tabwright.plans.packed import matrices, packed
from tabwright.plans.split import split_rows

MAX_DISPLAY_CLASSES = 12
FOURIER_FEATURES = 256


@dataclass(frozen=True)
class Algorithm:
    id: str
    label: str
    description: str
    run: Callable[["Split", dict], DataFrame]


@dataclass(frozen=True)
class Split:
    """Train and test rows (idx, features, label, y) with their sizes."""

    train: DataFrame
    test: DataFrame
    train_rows: int
    width: int
    classes: list[str]


@dataclass(frozen=True)
class ClassificationResult:
    metrics: DataFrame
    predictions: DataFrame
    confusion: DataFrame
    report: DataFrame
    message: str | None
    importance: DataFrame | None = None


def _named(classes: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in classes)), index.cast("int") + 1)


def _scored(split: Split, stages: list) -> DataFrame:
    model = Pipeline(stages=stages).fit(split.train)
    return model.transform(split.test).select(
        "idx",
        F.col("label").alias("actual"),
        _named(split.classes, F.col("prediction")).alias("predicted"),
        F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"),
    )


def _logistic(split: Split, options: dict) -> DataFrame:
    """L2 with C = 1 on standardised features: mean loss plus |w|^2 / (2 n)."""
    estimator = LogisticRegression(
        featuresCol="scaled", labelCol="y", maxIter=options.get("max_iter", 1000),
        regParam=1.0 / split.train_rows, standardization=False,
    )
    return _scored(split, [*scaler(split.train_rows, split.width), estimator])


def _tree(split: Split, options: dict) -> DataFrame:
    return _scored(
        split,
        [DecisionTreeClassifier(labelCol="y", seed=42, maxDepth=options.get("max_depth", 30), maxBins=options.get("bins", 256))],
    )


def _forest(split: Split, options: dict) -> DataFrame:
    return _scored(
        split,
        [
            RandomForestClassifier(
                labelCol="y", seed=42, numTrees=options.get("trees", 100),
                maxDepth=options.get("max_depth", 16), maxBins=options.get("bins", 256),
            )
        ],
    )


def _naive_bayes(split: Split, options: dict) -> DataFrame:
    return _scored(split, [NaiveBayes(labelCol="y", modelType="gaussian")])


def _knn(split: Split, options: dict) -> DataFrame:
    """k nearest train rows by standardised distance; exact, see ``neighbours``."""
    model = Pipeline(stages=scaler(split.train_rows, split.width)).fit(split.train)

    def vectors(rows: DataFrame) -> DataFrame:
        return model.transform(rows).select("idx", vector_to_array("scaled").alias("vec"))

    found = neighbours.nearest(vectors(split.test), vectors(split.train), options.get("k", 5))
    votes = neighbours.vote(found, split.train.select("idx", "label"))
    return split.test.join(votes, F.col("idx") == F.col("query")).select(
        "idx", F.col("label").alias("actual"), "predicted", "confidence"
    )


def _svm(split: Split, options: dict) -> DataFrame:
    """RBF kernel machine on random Fourier features (Rahimi and Recht, 2007).

    A linear SVM per class on the features approximates the kernel SVM; class
    probabilities come from a logistic fit on its margins. Only the scaled rows
    are kept, packed: every pass works the features out anew (``hinge``).
    """
    waves = hinge.Waves.of(split.width, options.get("fourier_features", FOURIER_FEATURES))
    scale = Pipeline(stages=scaler(split.train_rows, split.width)).fit(split.train)

    def scaled(rows: DataFrame) -> DataFrame:
        return scale.transform(rows).select("idx", "label", "y", vector_to_array("scaled").alias("vec"))

    blocks = packed(scaled(split.train), "vec", "y")
    # One machine per class, a single one for two classes.
    targets = [1] if len(split.classes) == 2 else list(range(len(split.classes)))
    machines = hinge.fit(blocks, waves, targets, split.train_rows, options.get("max_iter", 50), 1.0 / split.train_rows)

    def judge(batches):
        for batch in batches:
            for vectors, labels in matrices(batch):
                yield pd.DataFrame({"m": list(hinge.margins(waves, machines, vectors)), "y": labels})

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def judged(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(hinge.margins(waves, machines, np.stack(vectors.to_numpy()))))

    sides = blocks.mapInPandas(judge, "m array<double>, y double").select(array_to_vector("m").alias("margins"), "y")
    platt = LogisticRegression(
        featuresCol="margins", labelCol="y", maxIter=100, predictionCol="_p", rawPredictionCol="_r"
    ).fit(sides)
    blocks.unpersist()
    best = (
        (F.get("m", F.lit(0)) > 0).cast("int")
        if len(targets) == 1
        else F.array_position("m", F.array_max("m")).cast("int") - 1
    )
    test = scaled(split.test).select("idx", "label", judged("vec").alias("m")).withColumn("margins", array_to_vector("m"))
    return platt.transform(test).select(
        "idx",
        F.col("label").alias("actual"),
        _named(split.classes, best).alias("predicted"),
        F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"),
    )


ALGORITHMS: dict[str, Algorithm] = {
    a.id: a
    for a in (
        Algorithm("logistic", "Logistic regression", "Linear classifier for binary and multiclass labels.", _logistic),
        Algorithm("decision_tree", "Decision tree", "Single decision tree classifier.", _tree),
        Algorithm("random_forest", "Random forest", "Ensemble of decision trees for classification.", _forest),
        Algorithm("knn", "K-nearest neighbors", "Distance-based classifier with scaled features.", _knn),
        Algorithm("svm", "Support vector machine", "SVM classifier with probability estimates.", _svm),
        Algorithm("naive_bayes", "Naive Bayes", "Gaussian naive Bayes classifier.", _naive_bayes),
    )
}


def pair_counts(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n): the base of every classification metric."""
    return predictions.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _per_class(pairs: DataFrame) -> DataFrame:
    """(label, hits, support, claimed) over all labels seen on either side."""
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    return (
        pairs.withColumn("hit", hit)
        .select("hit", F.posexplode(sides).alias("side", "s"))
        .groupBy("s.label")
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("hits"),
            F.sum("s.support").alias("support"),
            F.sum("s.claimed").alias("claimed"),
        )
    )


def _rates(per_class: DataFrame) -> DataFrame:
    precision = F.coalesce(F.try_divide(F.col("hits"), F.nullif(F.col("claimed"), F.lit(0))), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.nullif(F.col("support"), F.lit(0))), F.lit(0.0))
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0))
    return per_class.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1, 4 places."""
    rates = _rates(_per_class(pairs))
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.round(F.try_divide(F.sum(F.col(name) * F.col("support")), total), 4).alias(name)

    return rates.agg(
        F.round(F.try_divide(F.sum("hits"), total), 4).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, 4 places."""
    return _rates(_per_class(pairs)).select(
        "label",
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"),
        "support",
    )


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row per actual label, one zero-filled column per predicted label."""
    spark = pairs.sparkSession
    axis = spark.createDataFrame([(c,) for c in labels], "actual string")
    wide = pairs.groupBy(F.col("actual").cast("string").alias("actual")).pivot("predicted", labels).sum("n")
    return axis.join(wide, "actual", "left").na.fill(0)


def _omitted(count: int) -> str:
    return (
        f"Confusion matrix omitted ({count} classes). Use a categorical target with at most "
        f"{MAX_DISPLAY_CLASSES} classes, or use regression for numeric targets."
    )


def run_classification(
    df: DataFrame, target: str, features: list[str], order_by: str, algorithm: str = "logistic",
    test_size: float = 0.2, seed: int = 42, options: dict | None = None,
) -> ClassificationResult:
    """Prepare, split (stratified when possible), fit and evaluate a classifier."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown classification algorithm: {algorithm}")
    prepared = prepare(df, features, order_by, target, target_kind="label")
    sizes = {r["label"]: r["count"] for r in prepared.rows.groupBy("label").count().collect()}
    classes = sorted(sizes)
    numbered = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], "label string, y double")
    rows = prepared.rows.join(numbered, "label")
    marked = split_rows(rows, ["idx"], test_size, seed, prepared.n, sizes, "label")
    # The split is exact, so its sizes are known without a job.
    test_rows = ceil(prepared.n * test_size)
    train_rows = prepared.n - test_rows
    if train_rows < 2 or test_rows < 1:
        raise ValueError("Not enough rows for train/test split")
    split = Split(
        marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test"),
        train_rows, len(prepared.names), classes,
    )
    predictions = ALGORITHMS[algorithm].run(split, options or {})
    pairs = pair_counts(predictions)
    metrics = classification_metrics(pairs).select(
        F.lit(algorithm).alias("algorithm"),
        F.lit(train_rows).cast("bigint").alias("train_rows"),
        F.lit(test_rows).cast("bigint").alias("test_rows"),
        "accuracy", "precision", "recall", "f1",
    )
    shown = len(classes) <= MAX_DISPLAY_CLASSES
    labels = classes if shown else []
    confusion = confusion_matrix(pairs, labels) if shown else pairs.limit(0)
    report = class_report(pairs) if shown else class_report(pairs).limit(0)
    if shown:
        axis = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
        report = axis.join(report, "label", "left").na.fill(0)
    return ClassificationResult(metrics, predictions, confusion, report, None if shown else _omitted(len(classes)))
