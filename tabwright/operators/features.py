"""Feature preparation shared by the model operators."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.plans.parallel import spread

# One-hot levels are held on the driver; wider text columns are refused.
MAX_MISSING_PERCENT = 50
FALLBACK_FEATURES = 3


@dataclass(frozen=True)
class Prepared:
    """Complete rows as (idx, features[, target]) with the feature names in order."""

    rows: DataFrame
    names: list[str]
    numeric: list[str]
    categorical: list[str]
    n: int


def check_columns(df: DataFrame, features: list[str], target: str | None) -> None:
    if target is not None and target not in df.columns:
        raise ValueError(f"Target column not found: {target}")
    for column in features:
        if column not in df.columns:
            raise ValueError(f"Feature column not found: {column}")
    if target in features:
        raise ValueError("Target column cannot also be a feature column")


def prepare(
    df: DataFrame,
    features: list[str],
    order_by: str,
    target: str | None = None,
    target_kind: str = "number",
    minimum: int = 4,
    separator: str = "=",
) -> Prepared:
    """Complete rows with a numeric block followed by one-hot blocks.

    A feature is numeric when every kept cell is a number. One aggregate decides
    that for all features, counts the rows and checks the target.
    """
    check_columns(df, features, target)
    fields = [cells.field_of(df, c) for c in features]
    typed = [cells.is_numeric_field(f) for f in fields]
    # A typed number needs no text form: it is present when it is not NULL.
    texts = [cells.text_of(f).alias(f"t{i}") for i, f in enumerate(fields) if not typed[i]]
    numbers = [cells.number_of(f).alias(f"n{i}") for i, f in enumerate(fields)]
    chosen = [F.col(order_by).cast("bigint").alias("idx"), *texts, *numbers]
    bad = F.lit(False)
    if target is not None:
        field = cells.field_of(df, target)
        chosen.append(cells.text_of(field).alias("label"))
        if target_kind == "number":
            chosen.append(cells.number_of(field).alias("target"))
            bad = F.col("target").isNull()
    table = df.select(*chosen)
    if target is not None:
        table = table.filter(F.col("label").isNotNull())
    # The narrow projection feeds the facts, the encoders and the fit; one file may come as one task.
    table = spread(table).persist(StorageLevel.MEMORY_AND_DISK)
    complete = F.lit(True)
    for i in range(len(features)):
        complete = complete & F.col(f"n{i}" if typed[i] else f"t{i}").isNotNull()
    texts_at = [i for i in range(len(features)) if not typed[i]]
    facts = table.agg(
        F.count_if(bad).alias("bad"),
        F.count_if(complete).alias("n"),
        *(F.every(F.when(complete, F.col(f"n{i}").isNotNull())).alias(f"num{i}") for i in texts_at),
    ).first()
    if facts["bad"]:
        raise ValueError(f"Target column must be numeric: {target}")
    if facts["n"] < minimum:
        raise ValueError(f"Need at least {minimum} complete rows")
    kept = table.filter(complete)
    is_number = [typed[i] or facts[f"num{i}"] for i in range(len(features))]
    numeric = [i for i in range(len(features)) if is_number[i]]
    categorical = [i for i in range(len(features)) if not is_number[i]]
    stages: list = []
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=[f"t{i}" for i in categorical],
                outputCols=[f"s{i}" for i in categorical],
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"s{i}" for i in categorical], outputCols=[f"o{i}" for i in categorical], dropLast=False
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[*(f"n{i}" for i in numeric), *(f"o{i}" for i in categorical)], outputCol="features"
        )
    )
    model: PipelineModel = Pipeline(stages=stages).fit(kept)
    names = [features[i] for i in numeric]
    if categorical:
        for i, levels in zip(categorical, model.stages[0].labelsArray):
            names += [f"{features[i]}{separator}{level}" for level in levels]
    out = ["idx", "features"]
    if target is not None:
        out.append("label")
        if target_kind == "number":
            out.append("target")
    rows = model.transform(kept).select(*out)
    return Prepared(rows, names, [features[i] for i in numeric], [features[i] for i in categorical], facts["n"])


def scaler(n: int, width: int, output: str = "scaled") -> list:
    """Stages that standardise ``features`` by mean and population deviation.

    A constant column becomes zero. ``n`` is the number of rows it is fitted on.
    """
    factor = sqrt(n / (n - 1)) if n > 1 else 1.0
    return [
        StandardScaler(inputCol="features", outputCol="_centred", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_centred", outputCol=output, scalingVec=Vectors.dense([factor] * width)),
    ]


def standardise(prepared: Prepared) -> DataFrame:
    """The prepared rows with a ``scaled`` vector fitted on all of them."""
    stages = scaler(prepared.n, len(prepared.names))
    return Pipeline(stages=stages).fit(prepared.rows).transform(prepared.rows).drop("_centred")


def feature_issues(profile: DataFrame, target: str) -> DataFrame:
    """(column, issues): why a column should not be a feature; empty when fine."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("column") == target, "is the target column"),
            F.when(
                F.col("missing_percent") >= MAX_MISSING_PERCENT,
                F.concat(F.round("missing_percent").cast("int").cast("string"), F.lit("% missing")),
            ),
            F.when(F.col("unique_count") <= 1, "constant values"),
        )
    )
    return profile.select("column", issues.alias("issues"))


def eligible_features(
    profile: DataFrame, target: str, columns: list[str], candidates: list[str] | None = None
) -> tuple[list[str], dict[str, list[str]]]:
    """Features without issues, and the removed candidates with their issues.

    Without any, the first clean columns are taken. The profile has one row per
    column, so its rows are read on the driver.
    """
    wanted = candidates or [c for c in columns if c != target]
    spark = profile.sparkSession
    asked = spark.createDataFrame(
        [(c, n, True) for n, c in enumerate(wanted)] + [(c, n, False) for n, c in enumerate(columns) if c != target],
        "name string, place int, candidate boolean",
    )
    clean = F.size(F.coalesce("issues", F.array())) == 0
    faults = F.filter("issues", lambda i: (F.size("issues") == 1) | (i != "is the target column"))
    known = asked.join(feature_issues(profile, target), F.col("name") == F.col("column"), "left")
    rows = known.groupBy("candidate", "name").agg(
        F.min("place").alias("place"), F.first(clean).alias("clean"), F.first(faults).alias("faults")
    ).orderBy("place").collect()  # one row per column
    removed = {r["name"]: list(r["faults"]) for r in rows if r["candidate"] and not r["clean"]}
    selected, fallback = ([r["name"] for r in rows if r["clean"] and r["candidate"] is kind] for kind in (True, False))
    return selected or fallback[:FALLBACK_FEATURES], removed


def numeric_targets(profile: DataFrame) -> list[str]:
    """Columns that can be a regression target."""
    rows = profile.filter(F.col("inferred_type").isin("integer", "float")).select("column").collect()
    return [r["column"] for r in rows]


def drop_sparsest(features: list[str], profile: DataFrame) -> tuple[list[str], list[str]]:
    """After a fit with too few complete rows: features with missing cells go, the
    sparsest first, as long as one is left."""
    missing = {r["column"]: r["missing_percent"] for r in profile.select("column", "missing_percent").collect()}
    kept, dropped = list(features), []
    for column in sorted(features, key=lambda c: -missing.get(c, 0.0)):
        if missing.get(column, 0.0) <= 0 or len(kept) <= 1:
            continue
        kept.remove(column)
        dropped.append(column)
    return kept, dropped
