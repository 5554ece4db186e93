"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, with one row per
distinct text: the digest, the row that stays and how many rows shared it when
they arrived. New data is digested, folded to one row per digest (map-side
first, so a text that fills a third of the table costs one row per task),
sort-merge anti-joined with the index, and what is new is appended. The index
side of the anti-join needs no shuffle, as it is stored by bucket.

Everything here is DataFrame work; nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import lower_ascii, whole_text, written
from tabwright.session import shared_folder


def digest_of(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(whole_text(text)), 256))


@dataclass
class DigestIndex:
    """A digest index as a bucketed table.

    ``path`` makes it persistent: a later session that opens the same path goes
    on with what is there. ``buckets`` is fixed when the table is made.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one per digest) whose digest the index lacks."""
        known = self.rows().select(F.col("digest").alias("known")).hint("merge")
        return groups.join(known, F.col("digest") == F.col("known"), "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups that the index lacks; adding the same groups again adds nothing."""
        fresh = self.unseen(groups).select("digest", "keep_id", "copies", F.lit(batch).alias("batch"))
        (
            fresh.repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index of its own below the shared folder."""
    folder = shared_folder(spark, "digests")
    return DigestIndex(spark, folder.rsplit("/", 1)[1].replace("-", "_"), folder, buckets).open()


def digest_groups(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) rows as one row per digest: the largest doc_id and the count."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def mark_copies(
    docs: DataFrame, index: DigestIndex, batch: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Append ``docs`` to the index as ``batch``; return one row per input row.

    Columns: doc_id, keep_id, group_size, kept, digest. ``keep_id`` is the
    index's row where an earlier batch brought the text, and otherwise the
    largest doc_id of the equal texts in ``docs``; ``group_size`` counts the
    equal texts of ``docs`` and of the batch that brought the text.

    A null text counts as empty. Rows without doc_id count in their group and
    are kept only if no row of it has one. Rows that repeat doc_id and text are
    all marked alike. An empty table gives an empty result. Other columns are
    neither read nor returned.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), digest_of(f"`{text}`").alias("digest"))
    groups = digest_groups(rows)
    index.append(groups, batch)
    entries = index.rows().select(
        F.col("digest").alias("entry"), F.col("keep_id").alias("stays"), F.col("copies").alias("came"), "batch"
    )
    size = F.when(F.col("batch") == batch, F.col("copies")).otherwise(F.col("copies") + F.col("came"))
    verdicts = groups.join(entries.hint("merge"), F.col("digest") == F.col("entry")).select(
        F.col("digest").alias("of"), F.col("stays").alias("keep_id"), size.alias("group_size"), "batch"
    )
    # Stored, both sides of the join are plain shuffles, of which Spark splits a hot digest.
    verdicts = written(verdicts, "verdicts")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    return rows.join(verdicts, F.col("digest") == F.col("of")).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"
    )


def drop_copies(
    docs: DataFrame, index: DigestIndex, batch: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the index grows by them.

    One whole row stays per text that no earlier batch brought: that with the
    largest doc_id (a null doc_id comes last; of rows that repeat doc_id and
    text, any one). The rows are folded map-side before the shuffle. Columns
    may have any names, also those used here.
    """
    rank = F.struct(F.col(f"`{doc_id}`").isNotNull().alias("has"), F.col(f"`{doc_id}`").alias("id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        digest_of(f"`{text}`").alias("digest"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        rank.alias("rank"), row.alias("row"),
    )
    index.append(digest_groups(rows.select("digest", "doc_id")), batch)
    best = rows.groupBy("digest").agg(F.max_by("row", "rank").alias("row"))
    mine = index.rows().where(F.col("batch") == batch).select(F.col("digest").alias("entry")).hint("merge")
    return best.join(mine, F.col("digest") == F.col("entry"), "left_semi").select("row.*")


def text_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``mark_copies`` with the digest as lowercase hex."""
    marked = mark_copies(docs, index, batch)
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
