"""Cross-site boilerplate lines by their distinct-site spread.

Every line is hashed; one HyperLogLog sketch of sites per line hash is built
map-side and merged by aggregation, so a line on every page of every site costs
one small sketch per task. Where the estimate is far from the threshold it
decides; lines near it get an exact distinct count of sites. Lines at or above
the threshold are cut from every document.

Everything here is DataFrame work; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import whole_text, written

SITES = 4
#: log2 of the sketch's registers: its relative standard error is about 1.04 / sqrt(2**12) = 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold, and at least two sites around it, are counted exactly (six standard errors).
MARGIN = 0.1


def line_key(line: Column) -> Column:
    """128 bits of a line's trimmed text, so that different lines do not meet by chance."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_sites(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """(line, site) with a row per non-blank line of every document; a null site is one site of its own."""
    return (
        docs.select(
            F.explode(F.array_distinct(F.transform(_lines(whole_text(f"`{text}`")), F.trim))).alias("bare"),
            F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\u0000")).alias("site"),
        )
        .where(F.col("bare") != "")
        .select(line_key(F.col("bare")).alias("line"), "site")
    )


def spread_lines(rows: DataFrame, threshold: int = SITES, margin: float = MARGIN, bits: int = SKETCH_BITS) -> DataFrame:
    """(line, sites) of the lines on ``threshold`` distinct sites or more.

    ``sites`` is exact where it is within the margin of the threshold and the
    sketch's estimate elsewhere.
    """
    around = max(2.0, threshold * margin)
    near = (F.col("sites") >= threshold - around) & (F.col("sites") <= threshold + around)
    # Stored, so that sketches are made once; they fold map-side, as do the distinct (line, site) pairs.
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", bits).alias("sketch"))
    estimates = written(
        sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(near | (F.col("sites") >= threshold)),
        "estimates",
    )
    wide = estimates.where(~near)
    close = estimates.where(near).select(F.col("line").alias("close"))
    exact = (
        rows.distinct()
        .join(close, F.col("line") == F.col("close"), "left_semi")
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= threshold)
    )
    return wide.unionByName(exact)


def cut_spread_lines(
    docs: DataFrame, threshold: int = SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """One row per document: doc_id, lines, removed, clean_text.

    Lines are split at line feeds and compared after trimming spaces; blank
    lines always stay. A null text is one empty line. A null site counts as a
    site. Rows that repeat a doc_id are each treated on their own; an empty
    table gives an empty result.
    """
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), whole_text(f"`{text}`").alias("text"), F.col(f"`{site}`").alias("site")
    )
    spread = spread_lines(line_sites(base, "text", "site"), threshold).select(F.col("line").alias("spread"))
    # Which spread lines a text has, keyed by the text itself: copies share the entry and ids may repeat.
    text_key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    keyed = base.withColumn("key", text_key)
    has = (
        keyed.select(
            "key", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), line_key))).alias("line")
        )
        .join(spread, F.col("line") == F.col("spread"), "left_semi")
        .groupBy(F.col("key").alias("of"))
        .agg(F.collect_set("line").alias("drop"))
    )
    parts = _lines(F.col("text"))
    joined = keyed.join(has, F.col("key") == F.col("of"), "left")
    stays = F.when(F.col("drop").isNull(), parts).otherwise(
        F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains("drop", line_key(x)))
    )
    return joined.select("doc_id", F.size(parts).alias("lines"), stays.alias("stays"), "text").select(
        "doc_id",
        F.col("lines").cast("long").alias("lines"),
        (F.col("lines") - F.size("stays")).cast("long").alias("removed"),
        F.array_join("stays", "\n").alias("clean_text"),
    )
