"""Column profile: types, missing cells, distinct values, statistics, warnings.

Text facts come from one ``(column, value) -> count`` aggregation, so each
distinct value is parsed once and a value repeated on any share of the rows is
combined before the shuffle. Numeric facts come from one wide aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import cells
from tabwright.operators.quantiles import quartiles_exclusive

# Thresholds of the type rules and quality warnings.
DATE_SHARE = 0.8
CATEGORY_RATIO = 0.2
CATEGORY_DISTINCT = 20
MISSING_WARNING_PERCENT = 50
MAX_TARGET_CLASSES = 12

PROFILE_SCHEMA_TYPES = ("integer", "float")


def _fields(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    wanted = columns or df.columns
    return [cells.field_of(df, c) for c in wanted]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, copies) over the non-missing normalised cells.

    Missing cells appear once per column with a NULL value.
    """
    entries = [
        F.struct(F.lit(f.name).alias("column"), cells.text_of(f).alias("value"))
        for f in _fields(df, columns)
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, row_count, missing_count, missing_percent, unique_count, inferred_type).

    Rules in order: all boolean tokens, at least 80 % dates, all integral, all
    numeric, few distinct values, else string. A typed numeric column goes through
    the same rules by its text, a typed date column is a datetime.
    """
    fields = _fields(df, columns)
    typed_number = [f.name for f in fields if cells.is_numeric_field(f)]
    typed_time = [f.name for f in fields if cells.is_time_field(f)]
    value, copies, column = F.col("value"), F.col("copies"), F.col("column")
    is_number = column.isin(typed_number) if typed_number else F.lit(False)
    is_time = column.isin(typed_time) if typed_time else F.lit(False)
    number = F.when(is_number, value.try_cast("double")).when(
        ~is_time, cells.coerce_float(value)
    )
    date = F.when(is_time, value.isNotNull()).when(
        ~is_number, cells.parse_date(value).isNotNull()
    )
    seen = value.isNotNull()
    facts = (
        value_counts(df, columns)
        .select(
            "column",
            "copies",
            seen.alias("seen"),
            F.lower(value).isin(*cells.BOOLEAN_TOKENS).alias("boolean"),
            F.coalesce(date, F.lit(False)).alias("date"),
            number.alias("number"),
        )
        .groupBy("column")
        .agg(
            F.sum("copies").alias("row_count"),
            F.coalesce(F.sum(F.when(~F.col("seen"), F.col("copies"))), F.lit(0)).alias("missing_count"),
            F.count_if("seen").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("seen"), F.col("copies"))), F.lit(0)).alias("filled"),
            F.coalesce(F.sum(F.when(F.col("seen") & F.col("date"), F.col("copies"))), F.lit(0)).alias("dates"),
            F.coalesce(F.every(F.when(F.col("seen"), F.col("boolean"))), F.lit(False)).alias("all_boolean"),
            F.coalesce(
                F.every(F.when(F.col("seen"), F.col("number").isNotNull())), F.lit(False)
            ).alias("all_float"),
            F.coalesce(
                F.every(
                    F.when(
                        F.col("seen"),
                        F.coalesce(cells.is_integral(F.col("number")), F.lit(False)),
                    )
                ),
                F.lit(False),
            ).alias("all_integer"),
        )
    )
    few = (F.try_divide(F.col("unique_count"), F.col("row_count")) <= CATEGORY_RATIO) | (
        F.col("unique_count") <= CATEGORY_DISTINCT
    )
    inferred = (
        F.when(F.col("filled") == 0, "string")
        .when(F.col("all_boolean"), "boolean")
        .when(F.try_divide(F.col("dates"), F.col("filled")) >= DATE_SHARE, "datetime")
        .when(F.col("all_integer"), "integer")
        .when(F.col("all_float"), "float")
        .when(few, "categorical")
        .otherwise("string")
    )
    percent = F.round(F.try_divide(F.col("missing_count"), F.col("row_count")) * 100, 2)
    return facts.select(
        "column",
        "row_count",
        "missing_count",
        percent.alias("missing_percent"),
        "unique_count",
        inferred.alias("inferred_type"),
    )


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, row_count, missing_count, missing_percent) in one map-side aggregate."""
    fields = _fields(df, columns)
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *(
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.count_if(cells.text_of(f).isNull()).alias("missing_count"),
                )
                for f in fields
            )
        ).alias("m"),
    )
    return row.select("row_count", F.inline("m")).select(
        "column",
        "row_count",
        "missing_count",
        F.round(F.coalesce(F.try_divide("missing_count", "row_count"), F.lit(0.0)) * 100, 2).alias(
            "missing_percent"
        ),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share of all cells."""
    per_column = missing_cells(df)
    width = len(df.columns)
    return per_column.agg(
        F.max("row_count").alias("row_count"),
        F.lit(width).cast("bigint").alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
    ).withColumn(
        "missing_percent",
        F.round(F.col("missing_cells") / F.greatest(F.col("row_count") * width, F.lit(1)) * 100, 2),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each identical normalised row."""
    texts = [
        F.coalesce(cells.text_of(f), F.lit("")).alias(f"c{i}")
        if cells.is_numeric_field(f) or cells.is_time_field(f)
        else cells.normalize_cell(cells.column_ref(f.name)).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    groups = df.select(*texts).groupBy(*(f"c{i}" for i in range(len(texts)))).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_row_count"))


def numeric_stats(
    df: DataFrame, columns: list[str] | None = None, quartiles: bool = True, places: int = 4
) -> DataFrame:
    """(column, n, min, max, mean, std, q25, median, q75); population std.

    Columns without any number give no row.
    """
    values = {f.name: cells.number_of(f) for f in _fields(df, columns)}
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.count(v).alias("n"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.round(F.avg(v), places).alias("mean"),
            F.round(F.stddev_pop(v), places).alias("std"),
        )
        for name, v in values.items()
    ]
    wide = df.agg(F.array(*entries).alias("s")).select(F.inline("s")).filter("n > 0")
    if not quartiles:
        return wide
    ranks = quartiles_exclusive(df, values, places).drop("n")
    # Both sides hold one row per column of the table.
    return wide.join(F.broadcast(ranks), "column", "left")


def top_values(
    df: DataFrame,
    columns: list[str] | None = None,
    n: int = 5,
    order_by: str | None = None,
) -> DataFrame:
    """(column, position, value, copies): the most frequent values per column.

    Ties go to the value seen first by ``order_by``, else to the smaller value.
    """
    entries = [
        F.struct(F.lit(f.name).alias("column"), cells.text_of(f).alias("value"))
        for f in _fields(df, columns)
    ]
    first = F.min(F.col(order_by)) if order_by else F.lit(0)
    kept = [order_by] if order_by else []
    counted = (
        df.select(*kept, F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("copies"), first.alias("first_seen"))
    )
    ranked = Window.partitionBy("column").orderBy(F.desc("copies"), "first_seen", "value")
    return (
        counted.withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= n)
        .select("column", "position", "value", "copies")
    )


def sample_values(
    df: DataFrame, order_by: str, columns: list[str] | None = None, n: int = 5
) -> DataFrame:
    """(column, samples): the first ``n`` non-missing cells in ``order_by`` order."""
    fields = [f for f in _fields(df, columns) if f.name != order_by]
    entries = [
        F.struct(F.lit(f.name).alias("column"), cells.text_of(f).alias("value")) for f in fields
    ]
    ranked = Window.partitionBy("column").orderBy(order_by, "value")
    return (
        df.select(F.col(order_by).alias("_at"), F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .withColumnRenamed("_at", order_by)
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= n)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s"))
        .select("column", F.col("s.value").alias("samples"))
    )


def quality_warnings(
    profile: DataFrame,
    duplicates: DataFrame | None = None,
    parse_warnings: list[str] | None = None,
    sampled_rows: int | None = None,
) -> DataFrame:
    """(column, warning) rows from a profile and a duplicate count."""
    name = F.col("column")
    per_column = profile.select(
        "column",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("missing_percent") >= MISSING_WARNING_PERCENT,
                        F.concat(F.lit("Column '"), name, F.lit("' is more than 50% missing")),
                    ),
                    F.when(
                        (F.col("unique_count") <= 1) & (F.col("row_count") > 1),
                        F.concat(F.lit("Column '"), name, F.lit("' appears constant")),
                    ),
                )
            )
        ).alias("warning"),
    )
    none = F.lit(None).cast("string").alias("column")
    if duplicates is not None:
        per_table = duplicates.filter("duplicate_row_count > 0").select(
            none,
            F.concat(
                F.col("duplicate_row_count").cast("string"), F.lit(" duplicate rows detected")
            ).alias("warning"),
        )
        per_column = per_column.unionByName(per_table)
    notes = list(parse_warnings or [])
    if sampled_rows is not None:
        notes.append(f"Large dataset sampled to first {sampled_rows:,} rows for EDA")
    if notes:
        extra = profile.sparkSession.createDataFrame([(w,) for w in notes], "warning string")
        per_column = per_column.unionByName(extra.select(none, "warning"))
    return per_column


def first_rows(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The optional row cap of a profile: the first ``n`` rows in file order."""
    return df.orderBy(order_by).limit(n)


def profile(
    df: DataFrame, order_by: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """One row per column: types, missing, distinct, samples, numeric and top values.

    Numeric statistics are filled for integer and float columns, top values for
    categorical, boolean and string columns.
    """
    columns = columns or [c for c in df.columns if c != order_by]
    order = df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(columns)], "ordinal int, column string"
    )
    types = column_types(df, columns)
    is_number = F.col("inferred_type").isin(*PROFILE_SCHEMA_TYPES)
    is_text = F.col("inferred_type").isin("categorical", "boolean", "string")
    stats = numeric_stats(df, columns)
    tops = (
        top_values(df, columns, order_by=order_by)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value", "copies"))).alias("tops"))
    )
    out = (
        types.join(F.broadcast(order), "column")
        .join(F.broadcast(stats), "column", "left")
        .join(F.broadcast(tops), "column", "left")
    )
    if order_by:
        out = out.join(F.broadcast(sample_values(df, order_by, columns)), "column", "left")
    else:
        out = out.withColumn("samples", F.col("tops.value"))

    def only(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name)).alias(name)

    return out.select(
        "ordinal",
        "column",
        "inferred_type",
        "row_count",
        "missing_count",
        "missing_percent",
        "unique_count",
        "samples",
        *(only(is_number, c) for c in ("n", "min", "max", "mean", "median", "std", "q25", "q75")),
        F.when(
            is_text,
            F.transform("tops", lambda t: F.struct(t["value"].alias("value"), t["copies"].alias("count"))),
        ).alias("top_values"),
    )


def suggestions(types: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: target, feature and date columns and the feasible analyses."""
    kind, distinct = F.col("inferred_type"), F.col("unique_count")
    numeric = kind.isin("integer", "float")
    target = distinct.between(2, MAX_TARGET_CLASSES) & (
        kind.isin("categorical", "boolean") | (numeric & (distinct < F.col("row_count")))
    )
    feature = kind.isin("integer", "float", "categorical", "boolean") & ~target
    position = F.col("ordinal") if "ordinal" in types.columns else F.lit(0)

    def names(condition: Column) -> Column:
        chosen = F.collect_list(F.when(condition, F.struct(position.alias("o"), F.col("column").alias("c"))))
        return F.sort_array(chosen)["c"]

    picked = types.agg(
        names(target).alias("target_columns"),
        names(feature).alias("feature_columns"),
        names(kind == "datetime").alias("date_columns"),
        F.coalesce(F.some(numeric), F.lit(False)).alias("has_numeric"),
    )
    if duplicates is not None:
        picked = picked.withColumn("dups", duplicates.select("duplicate_row_count").scalar())
    else:
        picked = picked.withColumn("dups", F.lit(0))
    features = F.size("feature_columns")
    targets = F.size("target_columns")
    analyses = F.array_compact(
        F.array(
            F.when((F.size("date_columns") > 0) & F.col("has_numeric"), "time_series"),
            F.when((features >= 2) & (targets > 0), "regression"),
            F.when(targets > 0, "classification"),
            F.when(features >= 2, "clustering"),
            F.when(F.col("dups") > 0, "deduplication_review"),
        )
    )
    return picked.select(
        "target_columns", "feature_columns", "date_columns", analyses.alias("suggested_analyses")
    )


def column_lookup(profile_df: DataFrame, name: str) -> DataFrame:
    """The profile row of one column."""
    return profile_df.filter(F.col("column") == name)


def missing_ranking(profile_df: DataFrame) -> DataFrame:
    """Columns with missing cells, worst first."""
    return (
        profile_df.filter("missing_count > 0")
        .select("column", "missing_count", "missing_percent")
        .orderBy(F.desc("missing_percent"), "column")
    )


def cached_profile(df: DataFrame, content_hash: str, folder: str, force: bool = False, **options) -> DataFrame:
    """Reuse a profile stored under the content hash; compute and store it otherwise."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/profile_{content_hash}"
    if not force and _has_success_marker(spark, path):
        return spark.read.parquet(path).withColumn("cached", F.lit(True))
    profile(df, **options).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("cached", F.lit(False))


def _has_success_marker(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
