"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

The features are those that a URL's spelling gives: length, depth, share of
digits, entropy of its signs, number of parameters, labels and hyphens of the
host, and how often URLs of the same suffix (last label, last two labels) were
blocked among one half of the labelled URLs. The trees are trained on the other
half, so that a suffix' own labels do not leak into its features.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import lower_ascii, written

#: Trees are trained on about this many labelled URLs at most, taken by a hash of the URL.
TRAIN_ROWS = 20000
TREES = 12
DEPTH = 3
#: A suffix without labels counts as one that was blocked in half of this many URLs.
PRIOR = 4.0
LEXICAL = ["length", "depth", "digit_share", "entropy", "parameters", "labels", "hyphens", "host_length", "path_length"]
SUFFIX = ["last_rate", "last_seen", "last_two_rate", "last_two_seen"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ``rules`` are (verdict, host/path) pairs.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Of equally long rules the earlier one counts.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, spelled in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        own, _, rest = spelled.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(spelled)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and more) with the lexical features and the host's suffixes."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda sign: (F.length(url) - F.length(F.replace(url, sign))) / F.length(sign) / size
    entropy = F.aggregate(
        F.transform(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), share),
        F.lit(0.0), lambda total, p: total - p * F.log2(p),
    )
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    parts = F.split("host", "\\.")
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
            "digit_share": F.regexp_count(url, F.lit("[0-9]")) / size,
            "entropy": entropy,
            "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
            "labels": F.size(parts).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "last": F.element_at(parts, -1),
            "last_two": F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), "."),
        }
    )


class UrlTrees:
    """A trained filter: suffix statistics and boosted trees, or one verdict where the labels know only one."""

    def __init__(self, suffixes: dict[str, DataFrame], trees: GBTClassificationModel | None, constant: str):
        self.suffixes, self.trees, self.constant = suffixes, trees, constant

    @staticmethod
    def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlTrees:
        """Train on (url, blocked) rows; all of them count in the suffix statistics' half and in the bound's share.

        Rows without a label or a URL teach nothing. Labels of one kind alone
        give a constant filter; no labels at all give one that allows.
        """
        rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
        host, path = host_and_path(F.col("url"))
        rows = lexical_features(rows.select("url", "blocked", host.alias("host"), path.alias("path")))
        seen = {bool(r["blocked"]): r["count"] for r in rows.groupBy("blocked").count().collect()}  # two rows at most
        if len(seen) < 2:
            return UrlTrees({}, None, "block" if seen.get(True) else "allow")
        half = F.pmod(F.xxhash64("url"), F.lit(2))
        suffixes = {}
        for column in ("last", "last_two"):
            counts = rows.where(half == 0).groupBy(F.col(column).alias(f"of_{column}")).agg(
                F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad")
            )
            rate = (F.col("bad") + PRIOR / 2) / (F.col("n") + PRIOR)
            suffixes[column] = written(
                counts.select(f"of_{column}", rate.alias(f"{column}_rate"), F.log1p("n").alias(f"{column}_seen")), "suffixes"
            )
        part = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * train_rows / sum(seen.values())))
        model = UrlTrees(suffixes, None, "allow")
        train = written(model._features(rows.where((half == 1) & part)).select(
            *LEXICAL, *SUFFIX, F.col("blocked").cast("double").alias("label")), "labelled")
        if train.select("label").distinct().count() < 2:
            return UrlTrees({}, None, "block" if seen[True] > seen[False] else "allow")
        boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7)
        model.trees = boosted.fit(model._vectors(train).select("features", "label"))
        return model

    def _features(self, rows: DataFrame) -> DataFrame:
        for column, table in self.suffixes.items():
            rows = rows.join(table, F.col(column) == F.col(f"of_{column}"), "left").drop(f"of_{column}")
        return rows.fillna({f"{c}_rate": 0.5 for c in self.suffixes} | {f"{c}_seen": 0.0 for c in self.suffixes})

    @staticmethod
    def _vectors(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features").transform(rows)

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path and more) with the filter's ``learned`` verdict."""
        if self.trees is None:
            return urls.withColumn("learned", F.lit(self.constant))
        scored = self.trees.transform(self._vectors(self._features(lexical_features(urls))))
        added = [*LEXICAL, *SUFFIX, "last", "last_two", "features", "rawPrediction", "probability"]
        return scored.withColumn("learned", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).drop(
            "prediction", *added
        )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None,
                page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest rule that fits decides; where none does, trees trained on
    ``labelled`` (url, blocked) do. Without ``labelled`` the rows that a rule
    decides are the labelled URLs. A null URL, or one without ``://``, has an
    empty host and path, which no rule fits, and is judged by its spelling. Rows
    may repeat; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = ruled.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "block").alias("blocked"))
    judged = UrlTrees.fit(labelled, **options).judge(ruled)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"))
