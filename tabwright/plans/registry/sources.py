"""Queries over files: tables that Spark writes as CSV and reads back through the file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import catalog, scan
from tabwright.session import shared_folder
from tabwright.sources import csv_files
from tabwright.sources.tables import table


def _csv_copy(df: DataFrame, name: str, **options) -> str:
    """The folder of a table written as CSV files with headers."""
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", **options).csv(folder)
    return f"{folder}/*.csv"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line breaks, through quoted multi-line CSV."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    read = csv_files.read_csv(spark, _csv_copy(docs, "csv-documents", quoteAll=True)).df
    return read.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "lang")


def _ragged(spark: SparkSession, folder: str) -> csv_files.CsvTable:
    """Orders as rows of two to five cells below a header of two."""
    tail = F.array_join(F.array_repeat("o_orderpriority", (F.col("o_orderkey") % 4 + 1).cast("int")), ",")
    line = F.concat_ws(",", "o_orderkey", tail).alias("o_orderkey,priority")
    # A separator that no value holds leaves the line as it is.
    return csv_files.read_csv(spark, _csv_copy(table(spark, folder, "orders").select(line), "csv-orders", sep="\x01"))


#: What the texts of a nation's file end with, by the nation's key: nothing, a null byte, half a character, control characters.
ENDINGS = ("", "00", "C3", "01" * 200)
#: Endings of which some begin a pattern that goes on in a later line.
PARTED = (*ENDINGS, *(t.encode().hex() for t in ("<\n  \nscript x", " wget\nhttp://a.b", ",=cmd|x", "\nbash \n -i")))


def _nation_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = ()) -> str:
    """Suppliers as one text file per nation, in the order of their keys."""
    out = shared_folder(spark, "supplier-files")
    line = F.concat_ws(",", "s_suppkey", "s_name").cast("binary")
    if endings:
        bad = F.array(*(F.unhex(F.lit(e)) for e in endings))
        line = F.concat(line, F.get(bad, F.col("s_nationkey") % len(endings)))
    rows = table(spark, folder, "supplier").select("s_nationkey", "s_suppkey", line.cast("string").alias("line"))
    in_order = rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    in_order.select("s_nationkey", "line").write.mode("overwrite").partitionBy("s_nationkey").text(out)
    return f"{out}/s_nationkey=*"


def _nation() -> Column:
    return F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("int").alias("nation")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """The files against a manifest in which some hashes are old, some paths missing and some files gone."""
    now = csv_files.stream_hashes(spark, _nation_files(spark, folder), "*.txt").withColumn("nation", _nation())
    old = F.when(F.col("nation") % 5 == 0, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256"))
    manifest = now.where(F.col("nation") % 5 != 1).withColumn("sha256", old)
    current = now.where(F.col("nation") % 5 != 2)
    return catalog.manifest_diff(current, manifest).select(_nation(), "state")


QUERIES = {
    "csv_documents": _documents,
    "csv_ragged": lambda s, d: _ragged(s, d).df.drop(csv_files.ROW_INDEX),
    "csv_counts": lambda s, d: csv_files.csv_summary(_ragged(s, d)),
    "file_listing": lambda s, d: csv_files.list_files(
        s, _csv_copy(table(s, d, "nation").select("n_nationkey", "n_name").coalesce(1), "csv-nation")
    ).select("kind", "size_bytes", "issue"),
    "file_hashes": lambda s, d: csv_files.stream_hashes(s, _nation_files(s, d), "*.txt").select(
        _nation(), "sha256", "size_bytes"
    ),
    "file_changes": _changes,
    "file_encoding": lambda s, d: csv_files.encoding_issues(
        csv_files.read_bytes(s, _nation_files(s, d, ENDINGS), "*.txt")
    ).select(_nation(), "issue"),
    "file_scan": lambda s, d: scan.scan_files(
        csv_files.read_bytes(s, _nation_files(s, d, ENDINGS), "*.txt").withColumn(
            "path", F.regexp_replace("path", "[^/]*$", "suppliers.csv")
        )
    ).select(_nation(), "status", "risk_score"),
    "file_scan_by_line": lambda s, d: scan.scan_folder(
        s, _nation_files(s, d, PARTED), "*.txt", F.lit("suppliers.csv")
    ).select(_nation(), "status", "risk_score", F.array_join("issues", "; ").alias("issues")),
}

_FILES = """
    WITH files AS (
        SELECT s_nationkey AS nation, string_agg(s_suppkey || ',' || s_name || chr(10), '' ORDER BY s_suppkey) AS content
        FROM supplier GROUP BY s_nationkey)"""

SQL = {
    "csv_documents": """
        SELECT doc_id::VARCHAR AS doc_id, sha256(coalesce(text, '')) AS text_sha256,
               length(coalesce(text, ''))::BIGINT AS n_chars, coalesce(lang, '') AS lang
        FROM documents""",
    "csv_ragged": """
        SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority AS priority,
               CASE WHEN o_orderkey % 4 >= 1 THEN o_orderpriority ELSE '' END AS item_1,
               CASE WHEN o_orderkey % 4 >= 2 THEN o_orderpriority ELSE '' END AS item_2,
               CASE WHEN o_orderkey % 4 >= 3 THEN o_orderpriority ELSE '' END AS item_3
        FROM orders""",
    "csv_counts": "SELECT count(*) AS row_count, (1 + max(o_orderkey % 4 + 1))::INTEGER AS column_count FROM orders",
    "file_listing": """
        SELECT 'csv' AS kind, (sum(strlen(n_nationkey || ',' || n_name) + 1) + strlen('n_nationkey,n_name') + 1)::BIGINT
                   AS size_bytes, NULL::VARCHAR AS issue
        FROM nation""",
    "file_hashes": f"{_FILES} SELECT nation, sha256(content) AS sha256, strlen(content)::BIGINT AS size_bytes FROM files",
    "file_changes": f"""{_FILES}
        SELECT nation, CASE nation % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'new' WHEN 2 THEN 'removed' ELSE 'unchanged' END
                   AS state
        FROM files""",
    "file_encoding": f"""{_FILES}
        SELECT nation, CASE nation % 4 WHEN 1 THEN 'File contains null bytes' WHEN 2 THEN 'CSV must be valid UTF-8 text'
                   WHEN 3 THEN 'File contains too many control characters' END AS issue
        FROM files""",
    "file_scan_by_line": f"""{_FILES}
        SELECT nation, CASE WHEN nation % 8 = 0 THEN 'safe' WHEN nation % 8 < 4 THEN 'blocked' ELSE 'warning' END AS status,
               ([0, 100, 100, 100, 30, 50, 45, 60])[nation % 8 + 1]::INTEGER AS risk_score,
               (['', 'File contains null bytes', 'CSV must be valid UTF-8 text', 'File contains too many control characters',
                 'Potential HTML or JavaScript injection detected', 'Suspicious command string detected; Embedded URL detected',
                 'Dangerous spreadsheet formula detected',
                 'CSV formula injection pattern detected; Suspicious command string detected'])[nation % 8 + 1] AS issues
        FROM files""",
    "file_scan": f"""{_FILES}
        SELECT nation, CASE WHEN nation % 4 = 0 THEN 'safe' ELSE 'blocked' END AS status,
               (CASE WHEN nation % 4 = 0 THEN 0 ELSE 100 END)::INTEGER AS risk_score
        FROM files""",
}
