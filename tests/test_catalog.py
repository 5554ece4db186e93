import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwright.operators import audit, catalog, classification, regression, reports, results
from tabwright.streaming import events as ev


def test_versions(spark):
    log = spark.createDataFrame(
        [(1, "f", 10, "upload", "ann", None), (2, "f", 20, "re_upload", "ann", "again"), (3, "g", 5, "upload", "bob", None)],
        "id int, file string, at int, upload_event string, uploaded_by string, notes string",
    )
    numbered = catalog.version_numbers(log, "file", "at", "id")
    assert {r["id"]: r["version_number"] for r in numbered.collect()} == {1: 1, 2: 2, 3: 1}
    fields = {"upload_event": "upload_event", "uploaded_by": "uploaded_by", "notes": "notes"}
    diff = catalog.compare_versions(numbered, "file", 1, 2, fields).collect()
    assert [(r["file"], r["differences"]) for r in diff] == [("f", ["upload_event: upload vs re_upload", "notes differ"])]
    later = spark.createDataFrame([(4, "f", 1, "replace", "ann", None)], log.schema)
    assert catalog.append_version(numbered, later, "file", "at", "id").first()["version_number"] == 3
    assert catalog.get_version(numbered, "file", "f", 2).first()["id"] == 2


def test_manifest(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string, size_bytes bigint")
    stored, now = make([("a", "1", 3), ("b", "2", 3), ("gone", "9", 1)]), make([("a", "1x", 4), ("b", "2", 3), ("new", "5", 7)])
    diff = catalog.manifest_diff(now, stored)
    assert {r["path"]: r["state"] for r in diff.collect()} == {"a": "modified", "b": "unchanged", "gone": "removed", "new": "new"}
    assert {r["state"]: r["files"] for r in catalog.manifest_status(diff).collect()} == {"new": 1, "modified": 1, "removed": 1, "unchanged": 1}
    one = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    after = catalog.apply_changes(stored, now, one("a", "new"), one("gone"))
    assert {tuple(r) for r in after.collect()} == {("a", "1x", 4), ("b", "2", 3), ("new", "5", 7)}
    assert [r["path"] for r in catalog.missing_approvals(now, one("a", "zzz")).collect()] == ["zzz"]


def test_uploads(spark):
    files = spark.createDataFrame([(1, "h", 5), (2, "h", 3), (3, "k", 1)], "file_id int, file_hash string, at int")
    assert {r["file_hash"]: (r["canonical"], r["copies"]) for r in catalog.unique_contents(files, "file_id", "at").collect()} == {"h": (2, 2), "k": (3, 1)}
    known = spark.createDataFrame([(9, "h")], "file_id int, file_hash string")
    for action, want in ((None, "duplicate_detected"), ("use_existing", "use_existing"), ("replace", "replace")):
        got = {r["file_id"]: (r["outcome"], r["existing_id"]) for r in catalog.resolve_uploads(files, known, action).collect()}
        assert got == {1: (want, 9), 2: (want, 9), 3: ("store", None)}
    with pytest.raises(ValueError):
        catalog.resolve_uploads(files, known, "drop")


def test_results(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("r1", 1, "regression", "linear", {"mae": "1.5", "r2": "0.9"}, '{"a": 1}', t),
        ("r1", 1, "regression", "linear", {"mae": "1.0", "r2": "0.95"}, '{"a": 2}', t + dt.timedelta(1)),
        ("r2", 1, "regression", "forest", {"mae": "0.5"}, "{broken", t),
    ]
    results.save_results(spark.createDataFrame(rows, results.RESULT_SCHEMA), str(tmp_path / "r"))
    latest = results.latest_results(spark.read.parquet(str(tmp_path / "r")))
    assert {r["result_id"]: r["a"] for r in results.load_payload(latest, "a int", "a").collect()} == {"r1": 2}
    compared = {r["metric"]: (r["left"], r["right"], r["difference"]) for r in results.compare_metrics(latest, "r1", "r2").collect()}
    assert compared == {"mae": (1.0, 0.5, -0.5), "r2": (0.95, None, None)}
    assert results.results_for_file(latest, 1, "regression", 1).first()["result_id"] == "r1"
    text = results.insight_text(F.lit("x"), F.lit("regression"), F.col("metrics"), F.lit(None))
    assert "Key metrics are mae: 0.5." in latest.filter("result_id = 'r2'").select(text).first()[0]
    assert not results.shap_answer(latest, "r1").first()["supported"]


def test_saved_fits_are_explained(spark, tmp_path, text_table):
    """The newest save alone counts, ids stay text, and what no model saved is not found."""
    place = str(tmp_path / "fits")
    lines = text_table("x,y,kind\n" + "\n".join(f"{k},{3 * k + 1},{'ab'[k % 2]}" for k in range(40)))
    slope = regression.run_regression(lines, "y", ["x"], "i")
    classes = classification.run_classification(lines, "kind", ["x", "y"], "i", "logistic")
    results.save_fit(classes, place, "007", 1, "classification", dt.datetime(2024, 1, 1))
    bare = dataclasses.replace(classes, predictions=classes.predictions.withColumn("confidence", F.lit(None).cast("double")))
    results.save_fit(bare, place, "none", 1, "classification")
    results.save_fit(slope, place, "r", 1, "regression", dt.datetime(2024, 1, 1))
    results.save_fit(slope, place, "late", 1, "regression", dt.datetime(2024, 1, 1))
    results.save_fit(classes, place, "late", 1, "classification", dt.datetime(2024, 1, 2))
    other = [("s", 1, "similarity", "cosine", {}, '{"model_type": "x"}', dt.datetime(2024, 1, 1)),
             ("b", 1, "regression", "linear", {}, "{broken", dt.datetime(2024, 1, 1))]
    results.save_results(spark.createDataFrame(other, results.RESULT_SCHEMA), f"{place}/results")
    saved, predictions = results.saved_fits(spark, place)
    got = {r["result_id"]: r for r in results.explain_results(saved, predictions).collect()}
    assert set(got) == {"007", "none", "r", "late"}
    c = results.confidence_summary(classes.predictions).first()
    assert tuple(got["007"]["confidence"]) == tuple(c) == tuple(got["late"]["confidence"]) and got["007"]["feature_importance"] is None
    assert tuple(got["none"]["confidence"]) == (False, None, None, None)
    assert [tuple(x) for x in got["r"]["feature_importance"]] == [("x", 3.0)] and got["r"]["confidence"] is None
    assert "SHAP is not computed" in got["r"]["summary_text"] and got["late"]["model_type"] == "logistic"
    assert results.explain_result(saved, predictions, "007").first() == got["007"]
    for unknown in ("s", "b", "7", "nobody"):
        with pytest.raises(ValueError, match="Model result not found"):
            results.explain_result(saved, predictions, unknown)
    metrics = {r["result_id"]: r["metrics"] for r in results.latest_results(saved).collect()}
    assert metrics["r"]["r2"] == "1.0" and metrics["r"]["test_rows"] == "8"
    with pytest.raises(ValueError):
        results.save_fit(slope, place, "x", 1, "similarity")


def test_audit_filter(spark):
    rows = [(1, "e", 5, dt.datetime(2024, 1, 1)), (2, "e", 6, dt.datetime(2024, 1, 2)), (3, "f", 5, dt.datetime(2024, 1, 3)), (4, None, None, None)]
    log = spark.createDataFrame(rows, "id int, event_type string, user_id int, created_at timestamp")
    ids = lambda **asked: sorted(r["id"] for r in audit.audit_filter(log, **asked).collect())
    assert ids() == ids(event_type="") == [1, 2, 3, 4] and ids(event_type="e") == [1, 2] and ids(user_id=5) == [1, 3]
    assert ids(from_time=dt.datetime(2024, 1, 2)) == [2, 3] and ids(event_type="e", to_time=dt.datetime(2024, 1, 1)) == [1]


def test_audit_page(spark):
    log = spark.range(30).select("id", F.lit("e").alias("event_type"), F.lit(1).alias("user_id"), F.col("id").alias("created_at"))
    page = audit.audit_page(audit.audit_filter(log, "e", 1), 2, 10).collect()
    assert [r["id"] for r in page] == list(range(19, 9, -1)) and page[0]["total"] == 30


def test_stream_scan_and_dedup(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("x\n=1+1\n")
    files = ev.arriving_files(spark, str(source))
    ev.scan_arriving(files, str(out), str(tmp_path / "ck")).awaitTermination()
    (source / "b.csv").write_text("x\n1\n")
    ev.scan_arriving(ev.arriving_files(spark, str(source)), str(out), str(tmp_path / "ck")).awaitTermination()
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {"a.csv": "warning", "b.csv": "safe"}

    (source / "c.csv").write_text("x\n1\n")
    hashed = ev.arriving_files(spark, str(source)).select("modificationTime", F.sha2("content", 256).alias("file_hash"))
    query = (
        ev.dedup_on_arrival(hashed, "modificationTime").writeStream.format("parquet").option("path", str(tmp_path / "d"))
        .option("checkpointLocation", str(tmp_path / "dk")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_stream_batches(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a,=1"), (2, "ok")], "k int, t string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t string").parquet(str(tmp_path / "in"))
    ev.scan_batches(stream, ["k"], "t", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["k"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "warning", 2: "safe"}


def test_quick_scan(spark, text_table, tmp_path):
    rows = "\n".join(f"{'NS'[k % 2]},{8 + k},{100 + 10 * k + k % 3},{'yn'[k % 2]}" for k in range(8))
    df = text_table(f"region,units,revenue,label\n{rows}")
    got = reports.quick_scan(df, "i", 7, "t.csv", "abc")
    steps = {r["step"]: (r["status"], r["message"]) for r in got.steps.collect()}
    assert steps["security_scan"][0] == "skipped" and steps["eda"] == ("success", "8 rows, 0.0% missing")
    assert steps["sql_import"] == ("success", "Imported 8 rows") and steps["regression"][0] == "success"
    assert steps["eda_suggestions"][0] == "success" and "classification" in steps
    reports.write_csv(got.report, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["section", "name", "value"] and back.filter("section = 'eda_column'").count() == 4
    reports.write_json(got.report, str(tmp_path / "json"))
    assert '"eda_column":[{"name":"region","value":"categorical"}' in spark.read.text(str(tmp_path / "json")).first()[0]
    assert reports.list_algorithms(spark).count() == 16
