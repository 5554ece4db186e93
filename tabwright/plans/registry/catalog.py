"""Catalog, version, result and log queries on derived tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tabwright.operators import audit, catalog, regression, results
from tabwright.session import shared_folder
from tabwright.sources.tables import table
from tabwright.streaming import state


def files(spark, folder):
    """Documents as uploaded files."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        "source",
        F.col("n_chars").alias("size_bytes"),
        catalog.content_hash(F.col("text")).alias("file_hash"),
        (F.col("doc_id") * 7919 % 100003).alias("arrived"),
    )


def events(spark, folder):
    """Events as a version log: the user is the file, the event type the cause."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 40).alias("file_id"),
        F.col("event_type").alias("upload_event"),
        F.col("user_id").alias("uploaded_by"),
        F.when(F.col("event_id") % 5 == 0, "manual").alias("notes"),
        F.col("ts").alias("created_at"),
    )


def log(spark, folder):
    """Events as an audit log."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "event_type",
        F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "store")
        .otherwise("persist")
        .alias("action"),
        "user_id",
        (F.col("user_id") % 50).alias("file_id"),
        F.sha2((F.col("event_id") % 97).cast("string"), 256).alias("file_hash"),
        F.col("ts").alias("created_at"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def stored(spark, folder):
    """Orders as stored results: one save per order, several per result id."""
    key = F.col("o_orderkey")
    broken = F.when(key % 23 == 0, F.lit("{broken"))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("r"), (key % 4000).cast("string")).alias("result_id"),
        F.col("o_custkey").alias("file_id"),
        F.when(key % 3 == 0, "business").when(key % 3 == 1, "regression").otherwise("similarity").alias("result_type"),
        F.when(
            key % 3 != 2,
            F.create_map(F.lit("mae"), F.col("o_totalprice").cast("string")),
        ).alias("metrics"),
        F.when(key % 6 == 2, "Not suitable.").alias("note"),
        F.coalesce(
            broken, F.to_json(F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("state")))
        ).alias("payload"),
        F.col("o_orderdate").alias("created_at"),
        key.alias("seq"),
    )


def fits(spark, folder):
    """Orders as saved models, several saves per result id, and their lines as the models' predictions."""
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "classification").when(key % 3 == 1, "regression").otherwise("similarity")
    weights = F.array(F.struct(F.lit("price").alias("feature"), F.col("o_totalprice").alias("importance")))
    payload = F.to_json(
        F.struct(F.col("o_orderpriority").alias("model_type"), key.cast("string").alias("save_id"), weights.alias("feature_importance"))
    )
    saved = table(spark, folder, "orders").select(
        F.concat(F.lit("m"), key % 4001).alias("result_id"), kind.alias("result_type"),
        F.when(key % 23 == 0, "{broken").otherwise(payload).alias("payload"), F.col("o_orderdate").alias("created_at"), key.alias("seq"),
    )
    line = F.col("l_orderkey")
    predictions = table(spark, folder, "lineitem").select(
        F.concat(F.lit("m"), line % 4001).alias("result_id"), line.cast("string").alias("save_id"),
        F.when(F.col("l_quantity") > 10, 1 - F.floor("l_quantity") / 125).alias("confidence"),
    )
    return saved, predictions


def _explained(spark, folder):
    return results.explain_results(*fits(spark, folder), "seq").select(
        "result_id", "model_type", F.col("feature_importance")[0]["feature"].alias("feature"),
        F.col("feature_importance")[0]["importance"].alias("importance"), "confidence.*",
        F.substring_index("summary_text", " ", 2).alias("text_begins"),
    )


def _saved_fit(spark, folder):
    """A line fitted to all line items, saved twice, loaded and explained by its id."""
    lines = table(spark, folder, "lineitem").select(
        "l_quantity", (F.col("l_quantity") * 2 + 3).alias("doubled"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no")
    )
    fit = regression.run_regression(lines, "doubled", ["l_quantity"], "line_no")
    place = shared_folder(spark, "fits")
    results.save_fit(fit, place, "0042", 7, "regression", dt.datetime(2024, 1, 1))
    results.save_fit(fit, place, "0042", 7, "regression", dt.datetime(2024, 1, 2))
    saved, predictions = results.saved_fits(spark, place)
    explained = results.explain_result(saved, predictions, "0042")
    rows = predictions.groupBy("result_id").agg(F.countDistinct("save_id").alias("saves"))
    return explained.select("result_id", "model_type", F.inline("feature_importance")).join(rows, "result_id").select(
        "result_id", "model_type", "feature", F.round("importance", 3).alias("importance"), "saves"
    )


def _manifest(spark, folder):
    now = files(spark, folder)
    key = F.col("file_id")
    current = now.filter(key % 10 != 0).select("path", F.col("file_hash").alias("sha256"), "size_bytes")
    old = now.filter(key % 7 != 0).select(
        "path",
        F.when(key % 4 == 0, F.sha2(F.concat("file_hash", F.lit("x")), 256)).otherwise(F.col("file_hash")).alias("sha256"),
        "size_bytes",
    )
    return current, old


def _applied(spark, folder):
    current, old = _manifest(spark, folder)
    diff = catalog.manifest_diff(current, old)
    add = diff.filter("state in ('new', 'modified')").select("path")
    remove = diff.filter("state = 'removed'").select("path")
    return catalog.apply_changes(old, current, add, remove)


def _versions(spark, folder):
    return catalog.version_numbers(events(spark, folder), "file_id", "created_at", "id")


def _streamed_versions(spark, folder):
    """The versions numbered by a stream that is started anew for each half of the log."""
    base = shared_folder(spark, "stream-versions")
    log = events(spark, folder).select("id", "file_id", "created_at")
    session = state.state_session(spark)
    for half in (F.col("created_at") < "2024-01-15", F.col("created_at") >= "2024-01-15"):
        log.where(half).write.mode("append").parquet(f"{base}/in")
        arrived = session.readStream.schema(log.schema).parquet(f"{base}/in")
        numbered = state.version_stream(arrived, "file_id", "created_at", "id")
        state.append_available(numbered, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("id", "file_id", "version_number")


def _version_diff(spark, folder):
    out = catalog.compare_versions(
        _versions(spark, folder), "file_id", 1, 2,
        {"upload_event": "upload_event", "uploaded_by": "uploaded_by", "notes": "notes"},
    )
    return out.withColumn("differences", F.array_join("differences", "; "))


def _insights(spark, folder):
    text = results.insight_text(
        F.col("result_type"), F.col("result_type"), F.col("metrics"), F.col("note")
    )
    return stored(spark, folder).select(F.col("seq").alias("id"), F.col("file_id").alias("job_id"), text.alias("summary"), "created_at")


def _resolved(action):
    def run(spark, folder):
        known = catalog.unique_contents(files(spark, folder).filter(F.col("source") == "src0"), "file_id", "arrived")
        base = known.select(F.col("canonical").alias("file_id"), "file_hash")
        incoming = files(spark, folder).filter(F.col("source") != "src0").select("file_id", "file_hash")
        return catalog.resolve_uploads(incoming, base, action).select("file_id", "existing_id", "outcome", "result")

    return run


QUERIES = {
    "results_explained": _explained,
    "results_saved_fit": _saved_fit,
    "results_variant": lambda s, d: results.payload_fields(
        stored(s, d).withColumn("result_id", F.col("seq").cast("string")),
        {"total": ("$.total", "double"), "state": ("$.state", "string"), "whole": ("$.state", "int"), "absent": ("$.no.such", "string")},
    ),
    "dedup_by_hash": lambda s, d: catalog.unique_contents(files(s, d), "file_id", "arrived"),
    "dedup_marks": lambda s, d: catalog.mark_duplicates(files(s, d), "file_id", "arrived").select(
        "file_id", "canonical", "copies", "is_duplicate"
    ),
    "row_hashes": lambda s, d: table(s, d, "nation").select(
        "n_nationkey", catalog.row_hash(["n_nationkey", "n_name", "n_regionkey"]).alias("row_hash")
    ),
    "resolve_duplicate_uploads": _resolved(None),
    "resolve_use_existing": _resolved("use_existing"),
    "new_contents": lambda s, d: catalog.new_contents(
        files(s, d).filter(F.col("source") != "src0"), files(s, d).filter(F.col("source") == "src0")
    ).select("file_id"),
    "declared_hash_check": lambda s, d: files(s, d)
    .withColumn(
        "declared",
        F.when(F.col("file_id") % 3 == 0, F.upper("file_hash")).when(F.col("file_id") % 3 == 1, "abc"),
    )
    .select("file_id", catalog.declared_hash_issue(F.col("declared"), F.col("file_hash")).alias("issue")),
    "recent_uploads": lambda s, d: catalog.recent_uploads(
        files(s, d), "arrived", "file_id", "source", "src0", active=F.col("size_bytes") > 100
    ).select("file_id", "arrived"),
    "version_numbers": lambda s, d: _versions(s, d).select("id", "file_id", "version_number"),
    "latest_versions": lambda s, d: catalog.latest_versions(events(s, d), "file_id", "created_at", "id"),
    "version_stream": _streamed_versions,
    "version_get": lambda s, d: catalog.get_version(_versions(s, d), "file_id", 3, 5).select("id", "upload_event"),
    "version_append": lambda s, d: catalog.append_version(
        catalog.version_numbers(events(s, d).filter("id % 2 = 0"), "file_id", "created_at", "id"),
        events(s, d).filter("id % 2 = 1"), "file_id", "created_at", "id",
    ).select("id", "file_id", "version_number"),
    "version_compare": _version_diff,
    "manifest_diff": lambda s, d: catalog.manifest_diff(*_manifest(s, d)),
    "manifest_status": lambda s, d: catalog.manifest_status(catalog.manifest_diff(*_manifest(s, d))),
    "manifest_apply": _applied,
    "results_latest": lambda s, d: results.latest_results(stored(s, d), "seq").select("result_id", "file_id", "seq"),
    "results_payload": lambda s, d: results.load_payload(
        stored(s, d).withColumn("result_id", F.col("seq").cast("string")), "total double, state string", "state"
    ),
    "results_for_file": lambda s, d: results.results_for_file(
        stored(s, d).withColumn("result_id", F.format_string("%010d", F.col("seq"))), 7, "regression"
    ).select("seq", "result_type"),
    "results_latest_report": lambda s, d: results.latest_per_file(
        stored(s, d).withColumn("result_id", F.format_string("%010d", F.col("seq"))), "business"
    ).select("file_id", "seq"),
    "insight_text": lambda s, d: _insights(s, d).select("id", "summary"),
    "insight_latest": lambda s, d: results.latest_insight(_insights(s, d)).select("job_id", "id", "summary"),
    "confidence_summary": lambda s, d: results.confidence_summary(
        table(s, d, "lineitem").select((1 - F.col("l_discount")).alias("confidence"))
    ),
    "audit_page": lambda s, d: audit.audit_page(
        audit.audit_filter(log(s, d), "purchase", from_time="2024-01-05 00:00:00", to_time="2024-01-20 00:00:00"),
        page=2, page_size=20,
    ).select("id", "user_id", "total"),
    "audit_for_file": lambda s, d: audit.audit_for_file(
        log(s, d), 3, "4e07408562bedb8b60ce05c1decfe3ad16b72230967de01f640b7e4729b49fce"
    ).select("id", "file_id"),
    "audit_count": lambda s, d: audit.audit_count(log(s, d), "error", "store"),
    "event_metrics": lambda s, d: audit.request_metrics(
        log(s, d), F.lit(200) + F.col("k") % 4 * 100, F.concat(F.lit("/"), F.col("event_type")), F.col("value") * 50
    ),
    "table_preview": lambda s, d: catalog.preview(table(s, d, "part"), ["p_partkey"], page=3, page_size=25),
}

FILES = """files AS (SELECT doc_id AS file_id, source || '/' || doc_id AS path, source, n_chars AS size_bytes,
 sha256(text) AS file_hash, doc_id * 7919 % 100003 AS arrived FROM documents)"""
VERSIONS = """ev AS (SELECT event_id AS id, user_id % 40 AS file_id, event_type AS upload_event, user_id AS uploaded_by,
 CASE WHEN event_id % 5 = 0 THEN 'manual' END AS notes, ts AS created_at,
 row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS version_number FROM events)"""
LOG = """lg AS (SELECT event_id AS id, event_type, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'store' ELSE 'persist' END AS action,
 user_id, user_id % 50 AS file_id, sha256(CAST(event_id % 97 AS VARCHAR)) AS file_hash, ts AS created_at, value,
 CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
STORED = """st AS (SELECT 'r' || (o_orderkey % 4000) AS result_id, o_custkey AS file_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'regression' ELSE 'similarity' END AS result_type,
 o_totalprice AS total, o_orderstatus AS state, o_orderdate AS created_at, o_orderkey AS seq FROM orders)"""
MANIFEST = f"""{FILES}, cur AS (SELECT path, file_hash AS sha256, size_bytes FROM files WHERE file_id % 10 <> 0),
old AS (SELECT path, CASE WHEN file_id % 4 = 0 THEN sha256(file_hash || 'x') ELSE file_hash END AS sha256, size_bytes FROM files WHERE file_id % 7 <> 0),
df AS (SELECT coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed'
 WHEN o.sha256 <> c.sha256 THEN 'modified' ELSE 'unchanged' END AS state, o.sha256 AS stored_sha256, c.sha256 AS current_sha256, c.size_bytes
 FROM cur c FULL JOIN old o ON c.path = o.path)"""
_KNOWN = "known AS (SELECT file_hash, arg_min(file_id, arrived) AS existing_id FROM files WHERE source = 'src0' GROUP BY 1)"


def _resolve_sql(action: str, result: str) -> str:
    return f"""WITH {FILES}, {_KNOWN}
SELECT f.file_id, k.existing_id, CASE WHEN k.existing_id IS NULL THEN 'store' ELSE '{action}' END AS outcome,
 CASE WHEN k.existing_id IS NULL THEN 'success' ELSE '{result}' END AS result
FROM files f LEFT JOIN known k USING (file_hash) WHERE f.source <> 'src0'"""


_INSIGHT = """'Fallback insight for ' || result_type || ': ' || CASE WHEN seq % 3 <> 2 THEN 'the ' || result_type ||
 ' result was generated successfully. Key metrics are mae: ' || CAST(total AS VARCHAR) || '.'
 WHEN seq % 6 = 2 THEN 'Not suitable.' ELSE 'analysis completed, but no detailed model metrics were available for summarization.' END"""

SQL = {
    "results_explained": """WITH f AS (SELECT *, 'm' || (o_orderkey % 4001) AS result_id FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 4001 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
p AS (SELECT l_orderkey, count(*) AS n, round(avg(c), 4) AS average, min(c) AS minimum, max(c) AS maximum
 FROM (SELECT l_orderkey, l_quantity, round(1 - floor(l_quantity) / 125, 4) AS c FROM lineitem) WHERE l_quantity > 10 GROUP BY 1)
SELECT result_id, o_orderpriority AS model_type, CASE WHEN o_orderkey % 3 = 1 THEN 'price' END AS feature,
 CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS importance,
 CASE WHEN o_orderkey % 3 = 0 THEN n IS NOT NULL END AS available, CASE WHEN o_orderkey % 3 = 0 THEN average END AS average,
 CASE WHEN o_orderkey % 3 = 0 THEN minimum END AS minimum, CASE WHEN o_orderkey % 3 = 0 THEN maximum END AS maximum,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Classification explainability' ELSE 'Feature importance' END AS text_begins
FROM f LEFT JOIN p ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 2 AND o_orderkey % 23 <> 0""",
    "results_saved_fit": """SELECT '0042' AS result_id, 'linear' AS model_type, 'l_quantity' AS feature,
 round(regr_slope(l_quantity * 2 + 3, l_quantity), 3) AS importance, CAST(2 AS BIGINT) AS saves FROM lineitem""",
    "results_variant": """SELECT CAST(o_orderkey AS VARCHAR) AS result_id, o_totalprice AS total, o_orderstatus AS state,
 TRY_CAST(o_orderstatus AS INTEGER) AS whole, CAST(NULL AS VARCHAR) AS absent FROM orders WHERE o_orderkey % 23 <> 0""",
    "dedup_by_hash": f"WITH {FILES} SELECT file_hash, arg_min(file_id, arrived) AS canonical, count(*) AS copies FROM files GROUP BY 1",
    "dedup_marks": f"""WITH {FILES} SELECT file_id, first_value(file_id) OVER (PARTITION BY file_hash ORDER BY arrived) AS canonical,
 count(*) OVER (PARTITION BY file_hash) AS copies, file_id <> first_value(file_id) OVER (PARTITION BY file_hash ORDER BY arrived) AS is_duplicate FROM files""",
    "row_hashes": """SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS row_hash FROM nation""",
    "resolve_duplicate_uploads": _resolve_sql("duplicate_detected", "pending"),
    "resolve_use_existing": _resolve_sql("use_existing", "success"),
    "new_contents": f"WITH {FILES} SELECT file_id FROM files WHERE source <> 'src0' AND file_hash NOT IN (SELECT file_hash FROM files WHERE source = 'src0')",
    "declared_hash_check": f"""WITH {FILES} SELECT file_id, CASE WHEN file_id % 3 = 1 THEN 'Client SHA-256 hash must be 64 hex characters' END AS issue FROM files""",
    "recent_uploads": f"WITH {FILES} SELECT file_id, arrived FROM files WHERE size_bytes > 100 AND source = 'src0' ORDER BY arrived DESC LIMIT 20",
    "version_numbers": f"WITH {VERSIONS} SELECT id, file_id, version_number FROM ev",
    "latest_versions": f"WITH {VERSIONS} SELECT file_id, max(version_number) AS version_number, arg_max(id, version_number) AS latest FROM ev GROUP BY 1",
    "version_stream": f"WITH {VERSIONS} SELECT id, file_id, version_number FROM ev",
    "version_get": f"WITH {VERSIONS} SELECT id, upload_event FROM ev WHERE file_id = 3 AND version_number = 5",
    "version_append": """WITH a AS (SELECT user_id % 40 AS file_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id AS id, user_id % 40 AS file_id, coalesce(n, 0) + row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS version_number
FROM events LEFT JOIN a ON a.file_id = user_id % 40 WHERE event_id % 2 = 1""",
    "version_compare": f"""WITH {VERSIONS}, a AS (SELECT * FROM ev WHERE version_number = 1), b AS (SELECT * FROM ev WHERE version_number = 2)
SELECT a.file_id, concat_ws('; ', CASE WHEN a.upload_event IS DISTINCT FROM b.upload_event THEN 'upload_event: ' || a.upload_event || ' vs ' || b.upload_event END,
 CASE WHEN a.uploaded_by IS DISTINCT FROM b.uploaded_by THEN 'uploaded_by: ' || a.uploaded_by || ' vs ' || b.uploaded_by END,
 CASE WHEN a.notes IS DISTINCT FROM b.notes THEN 'notes differ' END) AS differences, true AS content_identical FROM a JOIN b USING (file_id)""",
    "manifest_diff": f"WITH {MANIFEST} SELECT * FROM df",
    "manifest_status": f"WITH {MANIFEST} SELECT s.state, count(df.path) AS files FROM (VALUES ('new'),('modified'),('removed'),('unchanged')) s(state) LEFT JOIN df USING (state) GROUP BY 1",
    "manifest_apply": f"WITH {MANIFEST} SELECT path, sha256, size_bytes FROM cur",
    "results_latest": f"WITH {STORED} SELECT result_id, file_id, seq FROM st QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY created_at DESC, seq DESC) = 1",
    "results_payload": "SELECT CAST(o_orderkey AS VARCHAR) AS result_id, o_totalprice AS total, o_orderstatus AS state FROM orders WHERE o_orderkey % 23 <> 0",
    "results_for_file": f"WITH {STORED} SELECT seq, result_type FROM st WHERE file_id = 7 AND result_type = 'regression' ORDER BY created_at DESC, seq DESC LIMIT 20",
    "results_latest_report": f"""WITH {STORED} SELECT file_id, seq FROM st WHERE result_type = 'business'
 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, seq DESC) = 1""",
    "insight_text": f"WITH {STORED} SELECT seq AS id, {_INSIGHT} AS summary FROM st",
    "insight_latest": f"WITH {STORED} SELECT file_id AS job_id, seq AS id, {_INSIGHT} AS summary FROM st QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, seq DESC) = 1",
    "confidence_summary": "SELECT count(*) > 0 AS available, round(avg(round(1 - l_discount, 4)), 4) AS average, min(round(1 - l_discount, 4)) AS minimum, max(round(1 - l_discount, 4)) AS maximum FROM lineitem",
    "audit_page": f"""WITH {LOG}, f AS (SELECT * FROM lg WHERE event_type = 'purchase' AND created_at >= '2024-01-05' AND created_at <= '2024-01-20')
SELECT id, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
    "audit_for_file": f"WITH {LOG} SELECT id, file_id FROM lg WHERE file_id = 3 OR file_hash = sha256('3')",
    "audit_count": f"WITH {LOG} SELECT count(*) AS entries FROM lg WHERE event_type = 'error' AND action = 'store'",
    "event_metrics": f"""WITH {LOG} SELECT 'total' AS metric, '' AS key, count(*) AS requests FROM lg
UNION ALL SELECT 'slow', '', count(*) FILTER (value * 50 >= 2000) FROM lg
UNION ALL SELECT 'status', CAST(200 + k % 4 * 100 AS VARCHAR), count(*) FROM lg GROUP BY ALL
UNION ALL SELECT 'path', '/' || event_type, count(*) FROM lg GROUP BY ALL""",
    "table_preview": "SELECT * FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50",
}
