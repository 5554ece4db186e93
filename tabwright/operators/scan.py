"""Content risk scan: one record per document or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions import content_rules as rules
from tabwright.plans.parallel import spread
from tabwright.sources.csv_files import BOM, file_lines, in_order, missing_ends

UNREAD = "File content was not read"
#: Rules that are run on what can be read as text.
LATER_RULES = ("long", "script", "formula", "command", "url", "base64")


def _found(condition: Column, kind: str) -> Column:
    text, score = rules.ISSUES[kind]
    return F.when(condition, F.struct(F.lit(text).alias("issue"), F.lit(score).alias("score")))


def _scan(df: DataFrame, keys: list[str], text: Column, name: Column | None, valid: Column | None, file_hash: Column,
          fault: Column | None = None) -> DataFrame:
    """Keys, status, issues, risk_score, recommended_action and file_hash per row.

    Every rule is evaluated once into a flag column, and its pattern is only tried
    on texts that may match; a ``fault`` (why the text is not there), name,
    null-byte and encoding faults block the unit, and its later rules are not run.
    """
    flags = df.select(*keys, text.alias("_text"), file_hash.alias("file_hash"),
        (rules.filename_issue(name) if name is not None else F.lit(None).cast("string")).alias("_name"),
        (valid if valid is not None else F.lit(True)).alias("_valid"),
        (fault if fault is not None else F.lit(None).cast("string")).alias("_fault"),
    ).withColumn("_null", rules.has_null_byte(F.col("_text")))
    stopped = F.col("_fault").isNotNull() | F.col("_name").isNotNull() | F.col("_null")
    flags = flags.withColumn("_may", rules.candidate_rules(F.col("_text")))

    def tried(rule: str, value: Column) -> Column:
        return rules.where_candidate(F.col("_may"), rule, value)

    crowded = tried("control", rules.unprintable_share(F.col("_text")) > rules.CONTROL_SHARE)
    flags = flags.withColumn("_control", F.when(~stopped & F.col("_valid"), crowded))
    blocked = stopped | ~F.col("_valid") | F.coalesce("_control", F.lit(False))
    flags = flags.withColumn("_blocked", blocked)
    body = F.when(~F.col("_blocked"), F.col("_text"))
    checked = flags.select(
        *keys, "file_hash", "_fault", "_name", "_valid", "_null", "_control", "_blocked",
        rules.has_long_line(body).alias("_long"),
        tried("script", rules.has_script(body)).alias("_script"),
        rules.where_candidate(F.col("_may"), "formula", rules.formula_kind(body), F.lit(None).cast("string")).alias("_formula"),
        tried("command", rules.has_command(body)).alias("_command"),
        tried("url", rules.has_url(body)).alias("_url"),
        tried("base64", rules.has_base64_run(body)).alias("_base64"),
    )
    return _records(checked, keys)


def _records(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Scan records of rows whose rules are worked out: one flag column per rule, null where it was not run."""
    unread, named = (
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("issue"), F.lit(100).alias("score"))) for c in ("_fault", "_name")
    )
    early = F.col("_fault").isNotNull() | F.col("_name").isNotNull() | F.col("_null")
    found = F.array_compact(
        F.array(
            unread,
            named,
            _found(F.col("_null"), "null_bytes"),
            F.when(~early, F.coalesce(_found(~F.col("_valid"), "not_utf8"), _found(F.col("_control"), "control"))),
            _found(F.col("_long"), "long_rows"),
            _found(F.col("_script"), "script"),
            F.coalesce(
                _found(F.col("_formula") == "dangerous_formula", "dangerous_formula"),
                _found(F.col("_formula") == "formula", "formula"),
            ),
            _found(F.col("_command"), "command"),
            _found(F.col("_url"), "url"),
            _found(F.col("_base64"), "base64"),
        )
    )
    scored = checked.select(*keys, "file_hash", "_blocked", found.alias("_found")).withColumn(
        "risk_score",
        F.least(F.lit(100), F.aggregate("_found", F.lit(0), lambda total, f: total + f["score"])),
    )
    status = (
        F.when(F.col("_blocked") | (F.col("risk_score") >= rules.BLOCK_SCORE), "blocked")
        .when(F.size("_found") > 0, "warning")
        .otherwise("safe")
    )
    advice = F.create_map(*(F.lit(x) for pair in rules.ADVICE.items() for x in pair))
    return scored.withColumn("status", status).select(
        *keys,
        "status",
        F.col("_found.issue").alias("issues"),
        "risk_score",
        F.element_at(advice, F.col("status")).alias("recommended_action"),
        "file_hash",
    )


def scan_texts(df: DataFrame, keys: list[str], text: Column, name: Column | None = None) -> DataFrame:
    """Scan one text per row: keys, status, issues, risk_score, action, file_hash."""
    extra = [] if name is None else [name.alias("_scan_name")]
    narrow = spread(df.select(*keys, text.alias("_scan_text"), *extra))
    body = F.col("_scan_text")
    return _scan(
        narrow, keys, body, F.col("_scan_name") if extra else None, None, F.sha2(body.cast("binary"), 256)
    )


def scan_files(files: DataFrame) -> DataFrame:
    """Scan a ``binaryFile`` listing: bytes are checked before they are read as text.

    A file with an ``issue``, or whose content was not read, is blocked for it.
    """
    fault = F.when(F.col("content").isNull(), UNREAD)
    if "issue" in files.columns:
        fault = F.coalesce(F.col("issue"), fault)
    raw = F.col("content").cast("string")
    text = F.regexp_replace(F.make_valid_utf8(raw), r"^\uFEFF", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return _scan(files, ["path"], text, name, F.is_valid_utf8(raw), F.sha2("content", 256), fault)


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*", name: Column | None = None) -> DataFrame:
    """``scan_files`` of files of any size: no file is read whole, so none is left unread.

    Every rule but the hash is worked out line by line, wherever a byte range
    puts the line, and folded per file before the shuffle. A pattern that goes
    over several lines is followed by the task that hashes the file in order.
    A line must fit in a task. Spark's readers pass over empty files. ``name`` is
    worked out from ``path`` where it is not its last part.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.col("_metadata.file_path").alias("file")
    )
    lines = file_lines(spark, folder, pattern).withColumnRenamed("path", "of")
    text, place = F.col("value"), F.struct("start", "number")
    kind = rules.formula_kind(text)
    flags = lines.groupBy("of").agg(
        F.bool_or(rules.has_null_byte(text)).alias("_null"), F.bool_and(F.is_valid_utf8(text)).alias("_valid"),
        F.sum(rules.unprintable_count(text)).alias("odd"),
        (F.sum(F.length(text)) + F.count(F.lit(1)) - missing_ends().isin(-1, 2).cast("int")).alias("characters"),
        F.bool_or(rules.has_long_line(text)).alias("_long"), F.bool_or(rules.has_script(text)).alias("_script"),
        F.min_by(kind, F.when(kind.isNotNull(), place)).alias("_formula"), F.bool_or(rules.has_command(text)).alias("_command"),
        F.bool_or(rules.has_url(text)).alias("_url"), F.bool_or(rules.has_base64_run(text)).alias("_base64"),
    )
    followed = in_order(lines.withColumnRenamed("of", "path")).select(F.col("path").alias("hashed"), "sha256", "parted")
    files = names.join(flags, F.col("file") == F.col("of"), "left").join(followed, F.col("file") == F.col("hashed"), "left")
    name = rules.filename_issue(F.regexp_extract("path", r"([^/]*)$", 1) if name is None else name)
    # A file without a line is a byte order mark alone: the readers pass over empty ones.
    lineless = F.sha2(F.lit(BOM), 256)
    files = files.select(
        "path", F.coalesce("sha256", lineless).alias("file_hash"), F.lit(None).cast("string").alias("_fault"),
        name.alias("_name"), F.coalesce("_valid", F.lit(True)).alias("_valid"), F.coalesce("_null", F.lit(False)).alias("_null"),
        (F.coalesce(F.try_divide("odd", "characters"), F.lit(0.0)) > rules.CONTROL_SHARE).alias("_control"), "parted",
        *(F.col(f"_{rule}") for rule in LATER_RULES),
    )
    stopped = F.col("_name").isNotNull() | F.col("_null")
    files = files.withColumn("_control", F.when(~stopped & F.col("_valid"), F.col("_control")))
    files = files.withColumn("_blocked", stopped | ~F.col("_valid") | F.coalesce("_control", F.lit(False)))
    later = {f"_{rule}": F.col(f"_{rule}") for rule in LATER_RULES}
    for bit, rule in enumerate(rules.PARTED_RULES):
        later[f"_{rule}"] = later[f"_{rule}"] | (F.col("parted").bitwiseAND(1 << bit) != 0)
    return _records(files.withColumns({c: F.when(~F.col("_blocked"), value) for c, value in later.items()}), ["path"])


def latest_scan(scans: DataFrame, file: str, scanned_at: str, tie: str) -> DataFrame:
    """The newest scan of every file, combined map-side."""
    newest = F.max_by(F.struct(*scans.columns), F.struct(scanned_at, tie))
    return scans.groupBy(F.col(file).alias("_file")).agg(newest.alias("s")).select("s.*")


def scan_history(scans: DataFrame, file: str, value, scanned_at: str, tie: str) -> DataFrame:
    """All scans of one file, newest first."""
    return scans.filter(F.col(file) == value).orderBy(F.desc(scanned_at), F.desc(tie))


def scan_totals(scans: DataFrame) -> DataFrame:
    """Number of units and mean risk per status."""
    return scans.groupBy("status").agg(
        F.count(F.lit(1)).alias("units"), F.round(F.avg("risk_score"), 4).alias("mean_risk")
    )
