"""Stored results: save, load, list, compare, explain and summarise."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = (
    "result_id string, file_id bigint, result_type string, algorithm string, "
    "metrics map<string,string>, payload string, created_at timestamp"
)
#: Payload of a saved fit: fields of fixed size. Predictions are a table of their own, as there is one per row.
FIT_SCHEMA = "model_type string, save_id string, feature_importance array<struct<feature: string, importance: double>>"
PREDICTION_SCHEMA = "idx string, actual string, predicted string, confidence double, result_id string, save_id string"
# The texts that go with an explanation.
EXPLAINED_BY = {
    "regression": (
        "Feature importance is based on model coefficients or tree impurity importance. "
        "SHAP is not computed in this lightweight runtime."
    ),
    "classification": (
        "Classification explainability includes prediction confidence where the selected estimator exposes probabilities."
    ),
}
UNSUPPORTED_SHAP = (
    "SHAP values are not available in this local build. Use feature importance and "
    "confidence summaries as the fallback explanation."
)


def payload_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def latest_results(results: DataFrame, tie: str = "created_at") -> DataFrame:
    """Upsert view: the last saved row of each result id, combined map-side."""
    newest = F.max_by(F.struct(*results.columns), F.struct("created_at", tie))
    return results.groupBy(F.col("result_id").alias("_id")).agg(newest.alias("r")).select("r.*")


def save_results(results: DataFrame, path: str) -> None:
    """Append to the results table; readers take the latest row per id."""
    results.write.mode("append").parquet(path)


def save_fit(fit, folder: str, result_id: str, file_id: int, result_type: str, created_at: dt.datetime | None = None) -> None:
    """Save a fit of ``run_regression`` or ``run_classification`` below ``folder``.

    Its predictions go to ``folder``/predictions, partitioned by result and
    save, and one row with metrics and importance to ``folder``/results, which
    is written last: a save that was broken off is never read, and saving again
    under the same id replaces the former save for readers.
    """
    if result_type not in EXPLAINED_BY:
        raise ValueError(f"Not a fitted model: {result_type}")
    save_id = uuid.uuid4().hex
    given = {"confidence": F.lit(None)} | {c: F.col(c) for c in fit.predictions.columns}
    ids = {"result_id": F.lit(result_id), "save_id": F.lit(save_id)}
    fields = T.StructType.fromDDL(PREDICTION_SCHEMA)
    kept = fit.predictions.select(*((given | ids)[f.name].cast(f.dataType).alias(f.name) for f in fields))
    kept.write.mode("append").partitionBy("result_id", "save_id").parquet(f"{folder}/predictions")
    listed = F.lit(None).cast("array<struct<feature: string, importance: double>>")
    if fit.importance is not None:
        # Of a bounded number of features.
        ranked = F.array_sort(F.collect_list(F.struct("position", "feature", "importance")))
        listed = fit.importance.agg(ranked.alias("listed")).select(
            F.transform("listed", lambda x: F.struct(x["feature"].alias("feature"), x["importance"].alias("importance")))
        ).scalar()
    measures = [c for c in fit.metrics.columns if c != "algorithm"]
    payload = F.to_json(
        F.struct(F.col("algorithm").alias("model_type"), F.lit(save_id).alias("save_id"), listed.alias("feature_importance"))
    )
    row = fit.metrics.select(
        F.lit(result_id).alias("result_id"), F.lit(file_id).cast("bigint").alias("file_id"), F.lit(result_type).alias("result_type"),
        "algorithm", F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m).cast("string")))).alias("metrics"),
        payload.alias("payload"), (F.current_timestamp() if created_at is None else F.lit(created_at)).alias("created_at"),
    )
    save_results(row, f"{folder}/results")


def saved_fits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The results and the predictions that ``save_fit`` left below ``folder``."""
    tables = {"results": RESULT_SCHEMA, "predictions": PREDICTION_SCHEMA}
    return tuple(spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in tables.items())


def explain_results(results: DataFrame, predictions: DataFrame, tie: str = "created_at") -> DataFrame:
    """(result_id, model_type, feature_importance, confidence, summary_text) of the saved models among ``results``.

    A regression is explained by its importance, a classification by
    ``confidence``: whether predictions have one, and their mean, minimum and
    maximum. The newest save of an id counts, with the predictions (result_id,
    save_id, confidence) of that save alone. Results of other types and those
    whose payload cannot be read are left out.
    """
    newest = latest_results(results, tie).where(F.col("result_type").isin(*EXPLAINED_BY))
    fits = newest.select("result_id", "result_type", F.from_json("payload", FIT_SCHEMA).alias("fit")).where(
        F.col("fit.model_type").isNotNull()
    )
    shown = F.round("confidence", 4)
    found = predictions.groupBy(F.col("result_id").alias("of"), "save_id").agg(
        F.count(shown).alias("n"), F.round(F.avg(shown), 4).alias("average"), F.min(shown).alias("minimum"), F.max(shown).alias("maximum")
    )
    same = (F.col("result_id") == F.col("of")) & (F.col("fit.save_id") == F.col("save_id"))
    is_class = F.col("result_type") == "classification"
    confidence = F.struct((F.coalesce("n", F.lit(0)) > 0).alias("available"), "average", "minimum", "maximum")
    texts = F.create_map(*(F.lit(x) for pair in EXPLAINED_BY.items() for x in pair))
    return fits.join(found, same & is_class, "left").select(
        "result_id", F.col("fit.model_type").alias("model_type"),
        F.when(~is_class, F.col("fit.feature_importance")).alias("feature_importance"),
        F.when(is_class, confidence).alias("confidence"), texts[F.col("result_type")].alias("summary_text"),
    )


def explain_result(results: DataFrame, predictions: DataFrame, result_id: str, tie: str = "created_at") -> DataFrame:
    """The one row of ``explain_results`` for an id; only its partition of the predictions is read."""
    one = F.col("result_id") == result_id
    explained = explain_results(results.where(one), predictions.where(one), tie)
    if explained.isEmpty():
        raise ValueError("Model result not found")
    return explained


def payload_fields(results: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of any JSON payload, parsed once as VARIANT: name -> (path, type).

    Nothing need be known of the other fields. A path that is missing or does not fit
    its type gives NULL; a payload that is no JSON gives no row.
    """
    parsed = results.withColumn("_payload", F.try_parse_json("payload")).where(F.col("_payload").isNotNull())
    return parsed.select(
        "result_id", *(F.try_variant_get("_payload", path, kind).alias(name) for name, (path, kind) in fields.items())
    )


def load_payload(
    results: DataFrame, schema: T.StructType | str, required: str, result_id: str | None = None
) -> DataFrame:
    """Parsed payloads; rows whose JSON lacks the required field are dropped."""
    picked = results if result_id is None else results.filter(F.col("result_id") == result_id)
    parsed = picked.withColumn("_p", F.from_json("payload", schema))
    return parsed.filter(F.col(f"_p.{required}").isNotNull()).select("result_id", "_p.*")


def results_for_file(
    results: DataFrame, file_id: int, result_type: str | None = None, limit: int = 20
) -> DataFrame:
    """Results of a file, newest first."""
    picked = results.filter(F.col("file_id") == file_id)
    if result_type is not None:
        picked = picked.filter(F.col("result_type") == result_type)
    return picked.orderBy(F.desc("created_at"), F.desc("result_id")).limit(limit)


def latest_per_file(results: DataFrame, result_type: str) -> DataFrame:
    """The newest result of one type for every file."""
    newest = F.max_by(F.struct(*results.columns), F.struct("created_at", "result_id"))
    return (
        results.filter(F.col("result_type") == result_type)
        .groupBy(F.col("file_id").alias("_f"))
        .agg(newest.alias("r"))
        .select("r.*")
    )


def compare_metrics(results: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(metric, left, right, difference) of two results."""

    def side(result_id: str, name: str) -> DataFrame:
        return results.filter(F.col("result_id") == result_id).select(
            F.explode("metrics").alias("metric", name)
        )

    both = side(left_id, "left").join(side(right_id, "right"), "metric", "full_outer")
    left, right = F.col("left").try_cast("double"), F.col("right").try_cast("double")
    return both.select(
        "metric", left.alias("left"), right.alias("right"), F.round(right - left, 4).alias("difference")
    )


def insight_text(
    analysis_type: Column, model_type: Column, metrics: Column, note: Column
) -> Column:
    """Rule-based summary: metrics if any, else the note, else a plain sentence."""
    listed = F.array_join(
        F.transform(F.map_entries(metrics), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "
    )
    return (
        F.when(
            F.coalesce(F.size(F.map_keys(metrics)), F.lit(0)) > 0,
            F.concat(
                F.lit("Fallback insight for "), analysis_type, F.lit(": the "), model_type,
                F.lit(" result was generated successfully. Key metrics are "), listed, F.lit("."),
            ),
        )
        .when(
            F.coalesce(note, F.lit("")) != "",
            F.concat(F.lit("Fallback insight for "), analysis_type, F.lit(": "), note),
        )
        .otherwise(
            F.concat(
                F.lit("Fallback insight for "), analysis_type,
                F.lit(": analysis completed, but no detailed model metrics were available for summarization."),
            )
        )
    )


def latest_insight(insights: DataFrame, job: str = "job_id", key: str = "id") -> DataFrame:
    """The newest insight per job."""
    newest = F.max_by(F.struct(*insights.columns), F.struct("created_at", key))
    return insights.groupBy(F.col(job).alias("_j")).agg(newest.alias("i")).select("i.*")


def confidence_summary(predictions: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: whether confidences exist, and their mean, minimum and maximum."""
    c = F.round(F.col(confidence), 4)
    return predictions.agg(
        (F.count(c) > 0).alias("available"),
        F.round(F.avg(c), 4).alias("average"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
    )


def shap_answer(results: DataFrame, result_id: str) -> DataFrame:
    """Model explanations by SHAP are answered as unsupported for known results."""
    return results.filter(F.col("result_id") == result_id).select(
        "result_id", F.lit(False).alias("supported"), F.lit(UNSUPPORTED_SHAP).alias("shap_summary")
    )
