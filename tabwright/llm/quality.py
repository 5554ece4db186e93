"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (all documents, one
row per pattern, so at most 3 to the number of labellers) estimates how often
each labeller votes what for good and bad documents, and gives every pattern a
posterior. A bounded sample of documents, each with its posterior as weight of
either class, trains a linear scorer on hashed words, word shapes and coarse
statistics, which then scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import WordCache, release, whole_text, worker_cache, written

#: The scorer is fitted on about this many documents at most, taken by a hash of their text.
TRAIN_ROWS = 8000
FEATURES = 1 << 14
REJECT_BELOW = 0.5
ROUNDS = 200
CACHED_WORDS = 100_000

GOOD, BAD, NOTHING = 1, -1, 0
#: How a labeller votes on a statistic: bad beyond the one bound, good within the other, nothing between.
BOUNDS = {
    "capitals": (0.30, 0.08),
    "shouts": (0.05, 0.005),
    "bars": (0.05, 0.005),
    "runs": (0.03, 0.003),
    "symbols": (0.06, 0.015),
    "repeats": (0.10, 0.04),
    "sameness": (0.70, 0.50),
    "crowding": (0.25, 0.15),
}
LABELLERS = list(BOUNDS)
#: Labellers of repetition say nothing on texts of fewer words.
FEW_WORDS = 20
SYMBOLS = b"#$%&*@^~|<>{}[]=+_`!\\"
RUNS = re.compile(rb"[#$%&*@^~]{2,}")
SAME = re.compile(rb"(.)\1+")
SHAPES = bytes(
    ord("A") if chr(b).isupper() and b < 128 else ord("a") if b > 127 or chr(b).isalpha() else ord("0") if chr(b).isdigit() else b
    for b in range(256)
)


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """What the labellers look at, in the order of ``LABELLERS``."""
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(words))
    capitals = int(seen[65:91].sum())
    letters = capitals + int(seen[97:123].sum()) + int(seen[0xC2:].sum())
    symbols = int(sum(seen[b] for b in SYMBOLS))
    enough = len(words) >= FEW_WORDS
    most = Counter(words).most_common(1)[0][1] if enough else 0
    return [
        capitals / max(20, letters),
        raw.count(b"!!") / n,
        int(seen[ord("|")]) / n,
        len(RUNS.findall(raw)) / n if symbols else 0.0,
        symbols / max(1, len(raw)),
        sum(map(eq, words, words[1:])) / n if enough else 0.07,
        1 - len(set(words)) / n if enough else 0.6,
        most / n if enough else 0.2,
    ]


def votes_of(stats: list[float]) -> list[int]:
    return [BAD if s > bad else GOOD if s <= good else NOTHING for s, (bad, good) in zip(stats, BOUNDS.values())]


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, prior_bad: float = 0.1) -> np.ndarray:
    """P(bad) of every vote pattern by expectation-maximisation.

    The labellers are independent given the class; per class each has a share of
    bad among its votes, smoothed by one vote each. An empty vote says nothing.
    The start is the plain count of votes, so that the class called bad is the
    one that bad votes speak for.
    """
    n, m = patterns.shape
    if n == 0 or m == 0:
        return np.zeros(n)
    bad = 1 / (1 + np.exp(-((patterns == BAD).sum(1) * 3.0 - (patterns == GOOD).sum(1) * 0.5)))
    seen = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        weight = counts * bad
        share_bad = (weight.sum() + 10 * prior_bad) / (counts.sum() + 10)
        logs = []
        for w, share in ((weight, share_bad), (counts - weight, 1 - share_bad)):
            votes = np.einsum("i,ijk->jk", w, seen) + 1
            logs.append(math.log(share) + np.einsum("ijk,jk->i", seen, np.log(votes / votes.sum(1, keepdims=True))))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        done = np.abs(new - bad).max() < 1e-9
        bad = new
        if done:
            break
    return bad


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters and digits as one sign each; other signs once per run."""
    return SAME.sub(rb"\1", word.translate(SHAPES))[:16]


def word_features(word: bytes, features: int) -> tuple[int, int]:
    """The hashed places of a word and of its shape."""
    return zlib.crc32(b"w" + word.lower()) % features, zlib.crc32(b"s" + shape(word)) % features


def stat_features(stats: list[float], features: int) -> list[int]:
    """The hashed places of the statistics' coarse steps."""
    return [zlib.crc32(b"%d/%d" % (n, min(20, int(s * 40)))) % features for n, s in enumerate(stats)]


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _votes(texts: DataFrame) -> DataFrame:
    """(text key, votes): the labellers' votes on every text that is not blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = _raw(text)
                words = raw.split()
                if words:
                    rows.append(votes_of(statistics(raw, words)))
            yield pd.DataFrame(rows, columns=LABELLERS, dtype="int8")

    return texts.mapInPandas(run, ", ".join(f"{n} tinyint" for n in LABELLERS))


def _examples(texts: DataFrame, model: dict[tuple, float], features: int) -> DataFrame:
    """(places, values, bad) of sampled texts with the posterior of their votes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = _raw(text)
                words = raw.split()
                if not words:
                    continue
                stats = statistics(raw, words)
                held: Counter = Counter()
                for word, count in Counter(words).items():
                    for place in word_features(word, features):
                        held[place] += count / len(words)
                held.update(dict(Counter(stat_features(stats, features))))
                places = sorted(held)
                rows.append((places, [float(held[p]) for p in places], model.get(tuple(votes_of(stats)), 0.5)))
            yield pd.DataFrame(rows, columns=["places", "values", "bad"])

    return texts.mapInPandas(run, "places array<int>, values array<double>, bad double")


def fit_scorer(texts: DataFrame, model: dict[tuple, float], total: int, rows: int, features: int) -> tuple[np.ndarray, float] | None:
    """Weights and bias of the scorer of goodness; None where the posteriors know one class only."""
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(1, total)))
    examples = written(_examples(texts.where(part), model, features), "examples")
    vector = F.udf(lambda places, values: Vectors.sparse(features, places, values), VectorUDT())
    weights = F.array(
        F.struct(F.lit(1.0).alias("label"), (1 - F.col("bad")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("bad").alias("weight")),
    )
    train = examples.select("places", "values", F.explode(weights).alias("w")).where("w.weight > 0.01").repartition(3)
    if train.select("w.label").distinct().count() < 2:
        return None
    fitted = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=100, regParam=1e-6, standardization=False
    ).fit(train.select(vector("places", "values").alias("vector"), "w.label", "w.weight"))
    return fitted.coefficients.toArray(), float(fitted.intercept)


class Scorer:
    """The linear scorer in a task; a word's weights are looked up once."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: WordCache = worker_cache(f"weights_{zlib.crc32(weights.tobytes())}", CACHED_WORDS)

    def _weight(self, word: bytes) -> float:
        known = self.cache.recall(word)
        if known is None:
            known = float(self.weights[list(word_features(word, len(self.weights)))].sum())
            self.cache.young[word] = known
        return known

    def __call__(self, text: str) -> float:
        raw = _raw(text)
        words = raw.split()
        if not words:
            return 0.0
        self.cache.turn()
        found = self.cache.young.get
        total = sum([w if (w := found(word)) is not None else self._weight(word) for word in words])
        steps = stat_features(statistics(raw, words), len(self.weights))
        score = self.bias + total / len(words) + float(self.weights[steps].sum())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))


def judge(docs: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` with quality (0 to 1) and kept (quality of at least 0.5).

    Every row is judged on its own whole text; equal texts get equal scores.
    Null and blank texts hold nothing to learn from: quality 0, not kept. Where
    all documents look alike, so that one class is empty, the posterior of the
    votes is the quality. An empty table gives an empty result. Columns may have
    any names.
    """
    texts = docs.select(whole_text(f"`{text}`").alias("text"))
    patterns = written(_votes(texts), "votes").groupBy(*LABELLERS).count().collect()  # at most 3 ** 8 rows
    known = np.array([[r[n] for n in LABELLERS] for r in patterns], dtype=int).reshape(len(patterns), len(LABELLERS))
    counts = np.array([r["count"] for r in patterns], dtype=float)
    bad = posteriors(known, counts)
    model = {tuple(map(int, p)): float(b) for p, b in zip(known, bad)}
    fitted = fit_scorer(texts, model, int(counts.sum()), train_rows, features)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # ``features`` numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value) if shared.value else None
        for batch in batches:
            out = []
            for whole in batch:
                raw = _raw(whole)
                words = raw.split()
                if scorer:
                    out.append(scorer(whole))
                else:
                    out.append(1 - model.get(tuple(votes_of(statistics(raw, words))), 0.0) if words else 0.0)
            yield pd.Series(out, dtype="float64")
        # The worker lives on, idle, beside stages that run no Python and would never free its words.
        scorer = None
        release()

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, score(whole_text(f"`{text}`")).alias("quality")).withColumn(
        "kept", F.col("quality") >= REJECT_BELOW
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are."""
    return judge(docs, **options).where("kept").select("row.*")
