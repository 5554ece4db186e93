"""CSV text files as all-text tables in file order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.content_rules import CONTROL_SHARE, blank_line, closed, has_null_byte, opened, unprintable_share
from tabwright.sources.csv_records import csv_records

RAGGED_WARNING = "Ragged CSV rows detected; extra columns were padded for analysis"
ROW_INDEX = "_row_index"
MAX_FILE_BYTES = 250 * 1024 * 1024
BOM = b"\xef\xbb\xbf"
TOO_LARGE = "Uploaded file exceeds the configured size limit"


@dataclass(frozen=True)
class CsvTable:
    """All-text rows with ``_row_index``, the headers and parse warnings."""

    df: DataFrame
    headers: list[str]
    warnings: list[str]


def clean_headers(cells_in_header: list[str | None]) -> list[str]:
    return [(h or "").strip() or f"column_{i + 1}" for i, h in enumerate(cells_in_header)]


def unique_names(headers: list[str]) -> list[str]:
    """Header names made distinct for a DataFrame (compared case-blind)."""
    taken: set[str] = set()
    out = []
    for header in headers:
        name, k = header, 2
        while name.lower() in taken or name == ROW_INDEX:
            name, k = f"{header}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


# Cells are taken as they are; a cell without text is null here and '' in the table.
CELL_OPTIONS = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "", "maxColumns": "20480",
    "maxCharsPerColumn": "-1",
}


def _cells(record, names: list[str]):
    return F.from_csv(record, ", ".join(f"`{n}` string" for n in names), CELL_OPTIONS)


def read_csv(spark: SparkSession, path: str, widen: bool = True) -> CsvTable:
    """Read one CSV file set whose files each begin with a header row.

    Headers are stripped, blank ones become ``column_<n>``; rows of blank cells are
    dropped. With ``widen`` records wider than the header get ``item_<n>`` columns
    and short ones are padded with ''; otherwise extra cells are ignored. Quoted
    cells may hold line breaks, files of any size are read in parallel
    (``csv_records``), and ``_row_index`` follows the files' order.
    """
    records = csv_records(spark, path)
    first = F.struct("record", "width")
    at_top = F.col("position") == 0
    head, width = records.agg(
        F.min_by(F.when(at_top, first), F.when(at_top, F.col("file"))), F.max(F.when(~at_top, F.col("width")))
    ).first()
    if head is None:
        raise ValueError("CSV must contain a header row")
    single = spark.createDataFrame([(head["record"].removeprefix("\ufeff"),)], "record string")
    top = _cells(F.col("record"), [f"c{i}" for i in range(head["width"])])
    headers = clean_headers(list(single.select(top.alias("c")).first()["c"]))
    rows = records.where(F.col("position") > 0)
    warnings: list[str] = []
    if widen and (width or 0) > len(headers):
        warnings.append(RAGGED_WARNING)
        headers = headers + [f"item_{i + 1}" for i in range(width - len(headers))]
    names, shown = [f"c{i}" for i in range(len(headers))], unique_names(headers)
    table = rows.select(F.col("row_number").alias(ROW_INDEX), _cells(F.col("record"), names).alias("c"))
    return CsvTable(
        table.select(ROW_INDEX, *(F.coalesce(F.col(f"c.{n}"), F.lit("")).alias(shown[i]) for i, n in enumerate(names))),
        shown,
        warnings,
    )


def csv_summary(table: CsvTable) -> DataFrame:
    """One row: row and column count."""
    return table.df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(table.headers)).alias("column_count")
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, size_bytes, modified, kind, issue) of CSV and workbook files.

    Contents are not read. Unsafe names are left out; empty and oversized files
    are listed with an issue.
    """
    from tabwright.functions.content_rules import filename_issue

    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(F.col("name"), r"\.([^.]*)$", 1))
    as_csv = F.regexp_replace("name", r"(?i)\.xlsx$", ".csv")
    issue = F.when(F.col("length") == 0, "Uploaded file is empty").when(
        F.col("length") > MAX_FILE_BYTES, TOO_LARGE
    )
    return (
        listing.withColumn("name", name)
        .withColumn("kind", kind)
        .filter(F.col("kind").isin("csv", "xlsx") & filename_issue(as_csv).isNull())
        .select(
            "path", "name", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "kind",
            issue.alias("issue"),
        )
    )


def read_bytes(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Whole files as (path, modificationTime, length, content, issue), one row per file.

    A file above the size limit keeps its row: its content is not read and the
    issue says why. Spark's readers pass over empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    fits = files.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("issue", F.lit(None).cast("string"))
    large = files.filter(F.col("length") > MAX_FILE_BYTES).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("issue")
    )
    return fits.unionByName(large)


def encoding_issues(files: DataFrame) -> DataFrame:
    """(path, issue): why file bytes cannot be read as UTF-8 text, or NULL."""
    raw = F.col("content").cast("string")
    text = F.regexp_replace(F.make_valid_utf8(raw), r"^\uFEFF", "")
    issue = (
        F.when(has_null_byte(raw), "File contains null bytes")
        .when(~F.is_valid_utf8(raw), "CSV must be valid UTF-8 text")
        .when(unprintable_share(text) > CONTROL_SHARE, "File contains too many control characters")
    )
    return files.select("path", (F.coalesce("issue", issue) if "issue" in files.columns else issue).alias("issue"))


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256, size_bytes) of whole files: the input of integrity checks."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def _hash_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of files from their lines in order, and the parted patterns that go on from one line to another.

    A file's state is one hasher and the pattern that its last line left open, whatever its size.
    """
    path, hasher, left, extra, size = None, None, 0, 0, 0
    waits, parted = -1, 0
    for batch in batches:
        done = []
        for r in batch.itertuples(index=False):
            if r.path != path:
                path, left, extra, size = r.path, r.lines, r.extra, r.size_bytes
                hasher = hashlib.sha256(BOM if extra >= len(BOM) - 1 else b"")
                waits, parted = -1, 0
            left -= 1
            if not r.blank:
                if waits >= 0:
                    parted |= r.closed & (1 << waits)
                waits = r.opened
            hasher.update(r.line)
            if left or extra in (0, len(BOM)):
                hasher.update(b"\n")
            if not left:
                done.append((path, hasher.hexdigest(), size, parted))
        yield pd.DataFrame(done, columns=["path", "sha256", "size_bytes", "parted"])


def file_lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, start, number, value): the lines of files as they are; start and number give their order.

    Lines end at line feeds alone. Files are read in parallel by byte ranges;
    empty files have no line.
    """
    return spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), "value",
    )


def missing_ends() -> Column:
    """Of a file's lines: its size beyond theirs, each with a line feed; -1 or 2 where the last has none, 2 or 3 with a mark."""
    return F.first("size_bytes") - F.count(F.lit(1)) - F.sum(F.octet_length("value"))


def stream_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size_bytes) of whole files of any size.

    Files are read as lines, in parallel, and each is hashed in order by one
    task in the memory of a batch of lines. What the reader drops, a mark at the
    file's start and whether its last line is ended, follows from its size.
    Spark's readers pass over empty files and those of a mark alone, so these have no row.
    """
    return in_order(file_lines(spark, folder, pattern)).select("path", "sha256", "size_bytes")


def in_order(lines: DataFrame) -> DataFrame:
    """(path, sha256, size_bytes, parted) of ``file_lines``, each file's followed in order by one task.

    ``parted`` has a bit per pattern of ``content_rules`` that begins on one line and ends on a later one.
    """
    facts = lines.groupBy(F.col("path").alias("of")).agg(F.count(F.lit(1)).alias("lines"), missing_ends().alias("extra"))
    value = F.col("value")
    marked = lines.select(
        "path", "size_bytes", "start", "number", value.cast("binary").alias("line"),
        blank_line(value).alias("blank"), opened(value).alias("opened"), closed(value).alias("closed"),
    )
    joined = marked.join(facts, F.col("path") == F.col("of")).repartition("path").sortWithinPartitions("path", "start", "number")
    return joined.select("path", "size_bytes", "lines", "extra", "line", "blank", "opened", "closed").mapInPandas(
        _hash_lines, "path string, sha256 string, size_bytes long, parted int"
    )
