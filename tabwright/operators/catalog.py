"""File catalog: content dedup, uploads, versions and integrity comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.plans.ordering import positions_by_range

DUPLICATE_ACTIONS = (None, "use_existing", "replace")


def content_hash(content: Column) -> Column:
    """SHA-256 of text or bytes as hex."""
    return F.sha2(content.cast("binary"), 256)


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def declared_hash_issue(declared: Column, actual: Column) -> Column:
    """Why a declared hash is refused, or NULL when absent or equal."""
    clean = F.lower(F.trim(declared))
    return (
        F.when(declared.isNull(), F.lit(None).cast("string"))
        .when(F.length(clean) != 64, "Client SHA-256 hash must be 64 hex characters")
        .when(clean != actual, "Client SHA-256 hash does not match uploaded file")
    )


def unique_contents(files: DataFrame, key: str, arrived: str, file_hash: str = "file_hash") -> DataFrame:
    """One row per content: hash, the first file holding it, and the number of copies.

    First-of-group and count are partial aggregates, so a content held by a third
    of all files is combined before the shuffle.
    """
    return files.groupBy(file_hash).agg(
        F.min_by(F.col(key), F.struct(arrived, key)).alias("canonical"),
        F.count(F.lit(1)).alias("copies"),
    )


def mark_duplicates(files: DataFrame, key: str, arrived: str, file_hash: str = "file_hash") -> DataFrame:
    """Every file with its canonical file and an ``is_duplicate`` flag.

    The join is on the hash with a single row per hash on the right; a hot hash is
    split on the left by adaptive skew handling.
    """
    firsts = unique_contents(files, key, arrived, file_hash)
    return (
        files.join(firsts, file_hash)
        .withColumn("is_duplicate", F.col(key) != F.col("canonical"))
    )


def resolve_uploads(
    incoming: DataFrame, catalog: DataFrame, action: str | None = None, key: str = "file_id"
) -> DataFrame:
    """Decide per incoming file: stored, use_existing, replace or duplicate_detected.

    Both sides carry ``key`` and ``file_hash``; the catalog has one row per hash.
    """
    if action not in DUPLICATE_ACTIONS:
        raise ValueError("Invalid duplicate_action value")
    known = catalog.select(F.col("file_hash").alias("_hash"), F.col(key).alias("existing_id"))
    seen = F.col("existing_id").isNotNull()
    outcome = F.when(~seen, "store").otherwise(F.lit(action or "duplicate_detected"))
    return (
        incoming.join(known, F.col("file_hash") == F.col("_hash"), "left")
        .withColumn("outcome", outcome)
        .withColumn(
            "result",
            F.when(F.col("outcome") == "duplicate_detected", "pending").otherwise("success"),
        )
        .drop("_hash")
    )


def new_contents(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming files whose content is not in the catalog yet."""
    return incoming.join(catalog.select("file_hash"), "file_hash", "left_anti")


def recent_uploads(
    files: DataFrame, created_at: str, key: str, owner: str | None = None, owner_id=None, limit: int = 20,
    active: Column | None = None,
) -> DataFrame:
    """Active uploads, optionally of one owner, newest first."""
    kept = files.filter(active) if active is not None else files
    if owner is not None:
        kept = kept.filter(F.col(owner) == owner_id)
    return kept.orderBy(F.desc(created_at), F.desc(key)).limit(limit)


def version_numbers(events: DataFrame, file: str, at: str, key: str) -> DataFrame:
    """Number the events of each file 1, 2, ... in time order.

    A file with any share of all events is spread over many tasks.
    """
    numbered = positions_by_range(events, [at, key], name="version_number", keys=[file])
    return numbered.withColumn("version_number", F.col("version_number") + 1)


def latest_versions(events: DataFrame, file: str, at: str, key: str) -> DataFrame:
    """Latest version number and event per file; the number is the event count."""
    return events.groupBy(file).agg(
        F.count(F.lit(1)).alias("version_number"),
        F.max_by(F.col(key), F.struct(at, key)).alias("latest"),
    )


def append_version(log: DataFrame, incoming: DataFrame, file: str, at: str, key: str) -> DataFrame:
    """Incoming events numbered after the last version already in the log."""
    last = log.groupBy(file).agg(F.max("version_number").alias("_last"))
    fresh = version_numbers(incoming, file, at, key)
    return (
        fresh.join(last, file, "left")
        .withColumn("version_number", F.col("version_number") + F.coalesce("_last", F.lit(0)))
        .drop("_last")
    )


def get_version(versions: DataFrame, file: str, file_id, number: int) -> DataFrame:
    return versions.filter((F.col(file) == file_id) & (F.col("version_number") == number))


def compare_versions(
    versions: DataFrame, file: str, a: int, b: int, fields: dict[str, str], quiet: tuple[str, ...] = ("notes",)
) -> DataFrame:
    """Per file, the differences between versions ``a`` and ``b`` as text.

    ``fields`` maps shown names to columns; names in ``quiet`` only say that they
    differ. ``content_identical`` is true when no hash column is given.
    """
    has_hash = "file_hash" in versions.columns
    cols = [*fields.values(), *(["file_hash"] if has_hash else [])]

    def side(number: int, tag: str) -> DataFrame:
        picked = versions.filter(F.col("version_number") == number)
        return picked.select(file, *(F.col(c).alias(f"{tag}{i}") for i, c in enumerate(cols)))

    parts = []
    for i, name in enumerate(fields):
        left, right = F.col(f"a{i}"), F.col(f"b{i}")
        shown = (
            F.lit(f"{name} differ")
            if name in quiet
            else F.concat(
                F.lit(f"{name}: "), F.coalesce(left.cast("string"), F.lit("None")),
                F.lit(" vs "), F.coalesce(right.cast("string"), F.lit("None")),
            )
        )
        parts.append(F.when(~left.eqNullSafe(right), shown))
    same = F.col(f"a{len(fields)}").eqNullSafe(F.col(f"b{len(fields)}")) if has_hash else F.lit(True)
    return side(a, "a").join(side(b, "b"), file).select(
        file, F.array_compact(F.array(*parts)).alias("differences"), same.alias("content_identical")
    )


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state, stored_sha256, current_sha256, size_bytes) by full outer join.

    Both sides hold one row per path with columns path, sha256, size_bytes. A
    path is there when it has a row; one whose content nobody hashed cannot be
    shown to be unchanged and counts as modified.
    """
    now = current.select(
        "path", F.col("sha256").alias("current_sha256"), F.col("size_bytes").alias("_size"), F.lit(True).alias("_now")
    )
    stored = manifest.select("path", F.col("sha256").alias("stored_sha256"), F.lit(True).alias("_stored"))
    state = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_now").isNull(), "removed")
        .when(F.col("stored_sha256") == F.col("current_sha256"), "unchanged")
        .otherwise("modified")
    )
    return now.join(stored, "path", "full_outer").select(
        "path", state.alias("state"), "stored_sha256", "current_sha256", F.col("_size").alias("size_bytes")
    )


def manifest_status(diff: DataFrame) -> DataFrame:
    """Files per state, all four states present."""
    counts = F.array(
        *(
            F.struct(F.lit(s).alias("state"), F.count_if(F.col("state") == s).alias("files"))
            for s in ("new", "modified", "removed", "unchanged")
        )
    )
    return diff.agg(counts.alias("c")).select(F.inline("c"))


def apply_changes(
    manifest: DataFrame, current: DataFrame, add_or_update: DataFrame, remove: DataFrame
) -> DataFrame:
    """The next manifest: approved paths take their current hash, removed ones go.

    ``add_or_update`` and ``remove`` are one-column (path) tables.
    """
    approved = current.join(add_or_update.select("path"), "path", "left_semi")
    touched = add_or_update.select("path").unionByName(remove.select("path"))
    kept = manifest.join(touched, "path", "left_anti")
    added = approved.join(remove.select("path"), "path", "left_anti")
    return kept.select("path", "sha256", "size_bytes").unionByName(
        added.select("path", "sha256", "size_bytes")
    )


def missing_approvals(current: DataFrame, add_or_update: DataFrame) -> DataFrame:
    """Approved paths that are not on disk: a caller should refuse the change."""
    return add_or_update.select("path").join(current.select("path"), "path", "left_anti")


def preview(df: DataFrame, order_by: list[str], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of a table in a fixed order."""
    return df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)
