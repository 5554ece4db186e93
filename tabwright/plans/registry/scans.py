"""Content-scan queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import content_rules as rules
from tabwright.operators import scan
from tabwright.plans.parallel import spread
from tabwright.sources.tables import table


def risky_documents(spark, folder):
    """Whole documents with risky cells appended by document number."""
    key = F.col("doc_id")
    tail = (
        F.when(key % 9 == 0, "\nA,=1+1")
        .when(key % 9 == 1, '\nA,=HYPERLINK("http://evil.test")')
        .when(key % 9 == 2, "\nA,powershell -nop")
        .when(key % 9 == 3, F.concat(F.lit("\n"), F.repeat(F.lit("A"), 100)))
        .when(key % 9 == 4, "\nA,javascript:alert(1)")
        .when(key % 9 == 5, F.concat(F.lit("\n"), F.repeat(F.lit("x "), 60000)))
        .otherwise("")
    )
    name = F.concat(
        F.col("source"), F.lit("_"), key.cast("string"),
        F.when(key % 17 == 0, ".exe.csv").when(key % 19 == 0, "/x.csv").otherwise(".csv"),
    )
    # The stored columns are dealt out, not the longer texts made of them.
    stored = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return stored.select(
        key, "source", F.concat(F.col("text"), tail).alias("text"), name.alias("name")
    )


def _flat(df):
    return df.withColumn("issues", F.array_join("issues", "; "))


def _scans(spark, folder):
    return scan.scan_texts(
        risky_documents(spark, folder), ["doc_id", "source"], F.col("text"), F.col("name")
    )


QUERIES = {
    "scan_documents": lambda s, d: _flat(_scans(s, d)),
    "scan_pages": lambda s, d: _flat(
        scan.scan_texts(
            table(s, d, "pages"), ["page_id"], F.concat_ws("\n", F.col("url"), F.col("html"))
        )
    ).drop("file_hash"),
    "scan_conversations": lambda s, d: _flat(
        scan.scan_texts(table(s, d, "conversations"), ["conv_id", "turn"], F.col("text"))
    ),
    "scan_totals": lambda s, d: scan.scan_totals(_scans(s, d)),
    "scan_latest": lambda s, d: scan.latest_scan(_scans(s, d), "source", "doc_id", "doc_id").select(
        "source", "doc_id", "status", "risk_score"
    ),
    "scan_history": lambda s, d: scan.scan_history(_scans(s, d), "source", "src0", "doc_id", "file_hash").select(
        "doc_id", "status"
    ),
    "filename_rules": lambda s, d: risky_documents(s, d).select(
        "name", rules.filename_issue(F.col("name")).alias("issue"), rules.clean_filename(F.col("name")).alias("cleaned")
    ),
}

RISKY = """risky AS (SELECT doc_id, source, text || CASE doc_id % 9
 WHEN 0 THEN chr(10) || 'A,=1+1' WHEN 1 THEN chr(10) || 'A,=HYPERLINK("http://evil.test")'
 WHEN 2 THEN chr(10) || 'A,powershell -nop' WHEN 3 THEN chr(10) || repeat('A', 100)
 WHEN 4 THEN chr(10) || 'A,javascript:alert(1)' WHEN 5 THEN chr(10) || repeat('x ', 60000) ELSE '' END AS text,
 source || '_' || doc_id || CASE WHEN doc_id % 17 = 0 THEN '.exe.csv' WHEN doc_id % 19 = 0 THEN '/x.csv' ELSE '.csv' END AS name
 FROM documents)"""


def _scan_sql(source: str, keys: str, name_issue: str = "NULL::VARCHAR") -> str:
    """CTE list ending in ``scans`` over a CTE with the keys and ``text``."""
    blank = "[ \\t\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]*"
    cell = (
        "(?i)(?:^|[,\\n\\r\\x0b\\x0c])" + blank + "\"*''*" + blank
        + "(?:=" + blank + "(?:cmd|hyperlink|webservice|importxml)\\b|[=+\\-@])"
    )
    return f"""f AS (SELECT *, {name_issue} AS name_issue,
 list_max(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: length(x))) > 100000 AS long_rows,
 regexp_matches(text, '(?i)<\\s*script\\b|javascript\\s*:|\\bonerror\\s*=|\\bonclick\\s*=|<\\s*iframe\\b|<\\s*object\\b|<\\s*embed\\b') AS script,
 regexp_extract(text, '{cell}') AS hit,
 regexp_matches(text, '(?i)\\b(?:cmd\\.exe|powershell|bash\\s+-i|nc\\s+-e|wget\\s+|curl\\s+)\\b') AS command,
 regexp_matches(text, '(?i)https?://[^\\s,]+') AS url,
 regexp_matches(text, '\\b[A-Za-z0-9+/]{{80,}}={{0,2}}\\b') AS b64 FROM {source}),
i AS (SELECT *, CASE WHEN name_issue IS NOT NULL THEN [{{'t': name_issue, 's': 100}}] ELSE list_filter([
 CASE WHEN long_rows THEN {{'t': 'File contains unusually long rows', 's': 20}} END,
 CASE WHEN script THEN {{'t': 'Potential HTML or JavaScript injection detected', 's': 30}} END,
 CASE WHEN regexp_matches(hit, '(?i)(cmd|hyperlink|webservice|importxml)$') THEN {{'t': 'Dangerous spreadsheet formula detected', 's': 45}}
      WHEN hit <> '' THEN {{'t': 'CSV formula injection pattern detected', 's': 20}} END,
 CASE WHEN command THEN {{'t': 'Suspicious command string detected', 's': 40}} END,
 CASE WHEN url THEN {{'t': 'Embedded URL detected', 's': 10}} END,
 CASE WHEN b64 THEN {{'t': 'Embedded base64-looking payload detected', 's': 20}} END], lambda x: x IS NOT NULL) END AS found FROM f),
sc AS (SELECT *, CAST(least(100, coalesce(list_sum(list_transform(found, lambda x: x.s)), 0)) AS INTEGER) AS risk_score FROM i),
scans AS (SELECT {keys}, CASE WHEN name_issue IS NOT NULL OR risk_score >= 70 THEN 'blocked' WHEN len(found) > 0 THEN 'warning' ELSE 'safe' END AS status,
 array_to_string(list_transform(found, lambda x: x.t), '; ') AS issues, risk_score,
 CASE WHEN name_issue IS NOT NULL OR risk_score >= 70 THEN 'Do not analyse this file. Replace it with a clean CSV.'
 WHEN len(found) > 0 THEN 'Review issues before analysis and clean suspicious cells.'
 ELSE 'File passed scanner checks and can be analysed.' END AS recommended_action, sha256(text) AS file_hash FROM sc)"""


_NAME_ISSUE = """CASE WHEN contains(name, '/') THEN 'Filename must not contain path separators'
 WHEN name LIKE '%.exe.csv' THEN 'Executable or script extensions are blocked' END"""
_DOCS = f"WITH {RISKY}, {_scan_sql('risky', 'doc_id, source', _NAME_ISSUE)}"

SQL = {
    "scan_documents": f"{_DOCS} SELECT * FROM scans",
    "scan_pages": f"""WITH p AS (SELECT page_id, url || chr(10) || html AS text FROM pages), {_scan_sql('p', 'page_id')}
SELECT * EXCLUDE (file_hash) FROM scans""",
    "scan_conversations": f"WITH {_scan_sql('conversations', 'conv_id, turn')} SELECT * FROM scans",
    "scan_totals": f"{_DOCS} SELECT status, count(*) AS units, round(avg(risk_score), 4) AS mean_risk FROM scans GROUP BY status",
    "scan_latest": f"""{_DOCS} SELECT source, doc_id, status, risk_score FROM scans
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""",
    "scan_history": f"{_DOCS} SELECT doc_id, status FROM scans WHERE source = 'src0'",
    "filename_rules": f"""WITH {RISKY} SELECT name, {_NAME_ISSUE} AS issue,
 CASE WHEN {_NAME_ISSUE.replace(chr(10), ' ')} IS NULL THEN regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') END AS cleaned FROM risky""",
}
