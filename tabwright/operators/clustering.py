"""k-means and Ward clustering with elbow and silhouette."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.features import prepare, standardise
from tabwright.plans import blocks
from tabwright.plans.packed import boxed, matrices, summed
from tabwright.session import cut_lineage

STARTS = 10
MICRO_CENTRES = 1000
#: Rows whose distances to a piece are laid out at once.
TILE = 256
#: Rows of a block whose distances to the centres of a fit are laid out at once.
PART = 1 << 14
#: Neighbouring boxes that are tried as one first.
GROUP = 32
ALGORITHMS = {
    "kmeans": ("K-means", "Partition rows into k spherical clusters."),
    "hierarchical": ("Hierarchical", "Agglomerative clustering with ward linkage."),
}


@dataclass(frozen=True)
class ClusteringResult:
    assignments: DataFrame
    sizes: DataFrame
    elbow: DataFrame
    silhouette: DataFrame


@dataclass(frozen=True)
class KMeansFit:
    """Centres of a k-means fit and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float
    column: str = "scaled"

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of the nearest centre as ``cluster``."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            return pd.Series(blocks.squared_distances(blocks.matrix(vectors), centres).argmin(axis=1).astype("int32"))

        return rows.withColumn("cluster", nearest(vector_to_array(self.column)))


def _candidates(data: DataFrame, width: int, n: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows far from each other and how many rows are nearest to each (k-means||, 2012): two rounds of about ``most`` rows."""
    chosen = (summed(data, lambda x, _: x.sum(axis=0), width) / n)[None, :]
    for turn in range(2):
        at = chosen

        def gaps(x: np.ndarray) -> np.ndarray:
            return np.concatenate([blocks.squared_distances(x[i : i + TILE], at).min(axis=1) for i in range(0, len(x), TILE)])

        spread = float(summed(data, lambda x, _: gaps(x).sum()[None], 1)[0])
        if spread <= 0:
            break

        def draw(batches):
            for batch in batches:
                for x, _ in matrices(batch):
                    random = np.random.default_rng([seed, turn, crc32(x.tobytes())])
                    hit = random.random(len(x)) * spread < most * gaps(x)
                    if hit.any():
                        yield pd.DataFrame({"vec": list(x[hit])})

        # Some ``most`` rows, whatever the size of the table.
        drawn = [r["vec"] for r in data.mapInPandas(draw, "vec array<double>").collect()]
        if drawn:
            chosen = np.unique(np.concatenate([chosen, np.asarray(drawn)]) if turn else np.asarray(drawn), axis=0)
    at = chosen

    def held(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        return sum(
            np.bincount(blocks.squared_distances(x[i : i + TILE], at).argmin(axis=1), minlength=len(at))
            for i in range(0, len(x), TILE)
        )

    return chosen, summed(data, held, len(chosen))


def _seeded(points: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted points by k-means++; fewer where there are no more distinct ones."""
    chosen = [points[random.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        pull = ((points[:, None, :] - np.asarray(chosen)[None]) ** 2).sum(-1).min(axis=1) * weights
        if pull.sum() <= 0:
            break
        chosen.append(points[random.choice(len(points), p=pull / pull.sum())])
    return np.asarray(chosen)


def _add_rows(x: np.ndarray, centres: np.ndarray, total: np.ndarray, cost: np.ndarray) -> None:
    """Add rows to the sums and counts of their nearest centres, and their squared distances to the cost."""
    gaps = blocks.squared_distances(x, centres)
    near = gaps.argmin(axis=1)
    cost += gaps[np.arange(len(x)), near].sum()
    for axis in range(x.shape[1]):
        total[:, axis] += np.bincount(near, weights=x[:, axis], minlength=len(centres))
    total[:, -1] += np.bincount(near, minlength=len(centres))


@dataclass(frozen=True)
class Boxes:
    """Rows in boxes: where each begins, its rows, sum, middle, half sides and squared distances to its mean."""

    x: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    middle: np.ndarray
    half: np.ndarray
    spread: np.ndarray

    @staticmethod
    def of(x: np.ndarray, starts: np.ndarray) -> Boxes:
        counts = np.diff(np.append(starts, len(x)))
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        sums = np.add.reduceat(x, starts)
        off = x - np.repeat(sums / counts[:, None], counts, axis=0)
        return Boxes(x, counts, sums, (low + high) / 2, (high - low) / 2, np.add.reduceat((off * off).sum(axis=1), starts))

    def judged(self, centres: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of the middles of the chosen boxes, and whether it is the nearest of all their rows.

        Another centre is further from every row of a box where it is from the corner that lies most to its side.
        """
        middle, half = self.middle[chosen], self.half[chosen]
        far = (centres * centres).sum(axis=1)[None, :] / 2 - middle @ centres.T
        near = far.argmin(axis=1)
        margin = far - far[np.arange(len(far)), near][:, None]
        apart = np.abs(centres[:, None] - centres[None])
        for axis in range(centres.shape[1]):
            margin -= half[:, axis, None] * apart[near, :, axis]
        # What the arithmetic may be off; the own centre is left out.
        size = max(np.abs(self.middle).max(initial=0), np.abs(centres).max(initial=0))
        clear = margin > 1e-12 * (1 + centres.shape[1] * size * size)
        clear[np.arange(len(far)), near] = True
        return near, clear.all(axis=1)

    def add(self, centres: np.ndarray, total: np.ndarray, cost: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Add the chosen boxes of which all rows have one nearest centre; the others are returned."""
        near, sure = self.judged(centres, chosen)
        near, whole = near[sure], chosen[sure]
        counts, sums = self.counts[whole], self.sums[whole]
        for axis in range(centres.shape[1]):
            total[:, axis] += np.bincount(near, weights=sums[:, axis], minlength=len(centres))
        total[:, -1] += np.bincount(near, weights=counts, minlength=len(centres))
        off = sums / counts[:, None] - centres[near]
        cost += (self.spread[whole] + counts * (off * off).sum(axis=1)).sum()
        return chosen[~sure]


def _add_boxes(fine: Boxes, coarse: Boxes, centres: np.ndarray, total: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Add what boxes can be added whole, GROUP neighbouring ones at once where that goes; the rows of the others are returned."""
    groups = coarse.add(centres, total, cost, np.arange(len(coarse.counts)))
    places = (groups[:, None] * GROUP + np.arange(GROUP)[None, :]).ravel()
    left = np.zeros(len(fine.counts), dtype=bool)
    left[fine.add(centres, total, cost, places[places < len(fine.counts)])] = True
    return fine.x[np.repeat(left, fine.counts)]


def kmeans_fits(
    rows: DataFrame, sizes: list[int], seed: int, starts: int = STARTS, column: str = "scaled",
    rounds: int = 300, tolerance: float = 1e-4,
) -> dict[int, KMeansFit]:
    """The cheapest of several seeded k-means fits for every number of clusters.

    All starts of all sizes move in the same passes over the packed rows; one that
    has come to rest leaves. Only sums per cluster leave a task. Boxes of rows that
    lie nearer to one centre than to any other are added whole (Kanungo et al., 2002).
    """
    data = boxed(rows.select(vector_to_array(column).alias("vec")), "vec")
    facts = data.selectExpr("sum(n) AS n", "max(octet_length(data) div n div 8) AS width").first()
    points, weights = _candidates(data, facts["width"], facts["n"], 2 * max(sizes) * starts, seed)
    heavy = weights > 0
    points, weights = points[heavy], weights[heavy]
    moving = {
        (k, start): _seeded(points, weights, k, np.random.default_rng([seed, start, k])) for k in sizes for start in range(starts)
    }
    resting: set[tuple[int, int]] = set()
    best: dict[int, KMeansFit] = {}
    for turn in range(rounds + 1):
        if turn == rounds:
            resting = set(moving)
        runs = list(moving)
        every = np.concatenate([moving[r] for r in runs])
        begin = np.cumsum([0, *(len(moving[r]) for r in runs)])

        def kernel(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
            width = x.shape[1]
            total = np.zeros((len(every), width + 1))
            cost = np.zeros(len(runs))
            fine, coarse = (Boxes.of(x, starts.astype(np.int64)[::step]) if len(starts) else None for step in (1, GROUP))
            for r in range(len(runs)):
                own = slice(begin[r], begin[r + 1])
                part = x if fine is None else _add_boxes(fine, coarse, every[own], total[own], cost[r : r + 1])
                for i in range(0, len(part), PART):
                    _add_rows(part[i : i + PART], every[own], total[own], cost[r : r + 1])
            return np.concatenate([cost, total.ravel()])

        found = summed(data, kernel, len(runs) + len(every) * (facts["width"] + 1))
        sums = found[len(runs) :].reshape(len(every), -1)
        for r, run in enumerate(runs):
            if run in resting:
                fit = KMeansFit(moving.pop(run), float(found[r]), column)
                if run[0] not in best or fit.cost < best[run[0]].cost:
                    best[run[0]] = fit
                continue
            part, old = sums[begin[r] : begin[r + 1]], moving[run]
            # A centre without a row stays where it is.
            new = np.where(part[:, -1:] > 0, part[:, :-1] / np.maximum(part[:, -1:], 1.0), old)
            moving[run] = new
            if ((new - old) ** 2).sum(axis=1).max() <= tolerance**2:
                resting.add(run)
        if not moving:
            break
    data.unpersist()
    return best


def best_kmeans(rows: DataFrame, k: int, seed: int, starts: int = STARTS, column: str = "scaled") -> KMeansFit:
    """The cheapest of several seeded k-means fits."""
    return kmeans_fits(rows, [k], seed, starts, column)[k]


def total_spread(rows: DataFrame, column: str = "scaled") -> float:
    """Sum of squared distances to the overall mean: the inertia for k = 1."""
    wide = rows.select(F.posexplode(vector_to_array(column)).alias("axis", "v"))
    per_axis = wide.groupBy("axis").agg((F.var_pop("v") * F.count("v")).alias("s"))
    return per_axis.agg(F.sum("s")).first()[0] or 0.0


def elbow(rows: DataFrame, n: int, max_k: int, seed: int, starts: int = STARTS) -> DataFrame:
    """(k, inertia) for k = 1 .. min(max_k, n)."""
    points = [(1, round(total_spread(rows), 4))]
    sizes = list(range(2, min(max_k, n) + 1))
    fits = kmeans_fits(rows, sizes, seed, starts) if sizes else {}
    points += [(k, round(fits[k].cost, 4)) for k in sizes]
    return rows.sparkSession.createDataFrame(points, "k int, inertia double")


def ward_labels(centres: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward merging of weighted centres down to ``k`` groups.

    Works on at most MICRO_CENTRES centres; the merge cost of two groups is
    w_a w_b / (w_a + w_b) times their squared distance.
    """
    means, mass = centres.astype(float).copy(), weights.astype(float).copy()
    owner = np.arange(len(means))
    alive = np.ones(len(means), dtype=bool)
    cost = blocks.squared_distances(means, means) * np.outer(mass, mass) / (mass[:, None] + mass[None, :])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(means) - k):
        a, b = divmod(int(cost.argmin()), len(means))
        a, b = min(a, b), max(a, b)
        means[a] = (mass[a] * means[a] + mass[b] * means[b]) / (mass[a] + mass[b])
        mass[a] += mass[b]
        alive[b] = False
        owner[owner == b] = a
        cost[b, :] = cost[:, b] = np.inf
        gap = ((means - means[a]) ** 2).sum(1) * mass * mass[a] / (mass + mass[a])
        gap[~alive] = np.inf
        gap[a] = np.inf
        cost[a, :] = cost[:, a] = gap
    names = {group: i for i, group in enumerate(dict.fromkeys(owner.tolist()))}
    return np.asarray([names[g] for g in owner])


def ward(rows: DataFrame, k: int, seed: int, micro: int = MICRO_CENTRES, method: str = "micro") -> DataFrame:
    """(idx, cluster) by Ward linkage.

    ``micro`` condenses the rows to ``micro`` k-means centres first, whatever
    their number (the idea of BIRCH, 1996); ``exact`` merges the distinct rows
    themselves, of which there may be ``micro`` at most.
    """
    if method not in ("micro", "exact"):
        raise ValueError(f"Unknown Ward method: {method}")
    vectors = rows.select("idx", vector_to_array("scaled").alias("vec"))
    if method == "exact":
        distinct = vectors.groupBy("vec").agg(F.count(F.lit(1)).alias("w"), F.min("idx").alias("first"))
        listed = distinct.orderBy("first").limit(micro + 1).collect()
        if len(listed) > micro:
            raise ValueError(f"Exact Ward clustering takes {micro} distinct rows at most")
        centres = np.asarray([r["vec"] for r in listed], dtype=float)
        weights = np.asarray([r["w"] for r in listed], dtype=float)
    else:
        model = KMeans(k=micro, seed=seed, featuresCol="scaled", predictionCol="micro", maxIter=20).fit(rows)
        mass = {r["micro"]: r["count"] for r in model.transform(rows).groupBy("micro").count().collect()}
        every = np.asarray(model.clusterCenters(), dtype=float)
        used = [i for i in range(len(every)) if mass.get(i)]
        centres, weights = every[used], np.asarray([mass[i] for i in used], dtype=float)
    labels = ward_labels(centres, weights, min(k, len(centres)))

    def assign(batches):
        for batch in batches:
            if len(batch):
                nearest = blocks.squared_distances(blocks.matrix(batch["vec"]), centres).argmin(axis=1)
                yield pd.DataFrame({"idx": batch["idx"], "cluster": labels[nearest]})

    return vectors.mapInPandas(assign, "idx bigint, cluster int")


def cluster_sizes(assignments: DataFrame, k: int) -> DataFrame:
    """(cluster, rows) for clusters 0 .. k-1, empty ones with 0."""
    counts = assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    axis = assignments.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return axis.join(F.broadcast(counts), "cluster", "left").select("cluster", F.coalesce("rows", F.lit(0)).alias("rows"))


def _pieces(n: int, cores: int) -> int:
    """Pieces of all rows; a row is copied once for each, so they are as large as a task holds, but keep every core busy."""
    return max(1, -(-n // (4 * blocks.MAX_BLOCK)), min(-(-n // (blocks.MAX_BLOCK // 4)), ceil(sqrt(2 * cores))))


def silhouette(vectors: DataFrame) -> DataFrame:
    """One row: the mean silhouette with Euclidean distance, exactly.

    ``vectors`` has idx, vec and cluster. Every pair of rows counts, so the work
    is quadratic; it is cut into pairs of bounded blocks that return, per row and
    cluster, one distance sum. NULL when only one cluster is found.
    """
    slim = cut_lineage(vectors.select("idx", F.col("vec").cast("array<double>").alias("vec"), "cluster"))
    n = slim.count()
    pieces = _pieces(n, slim.sparkSession.sparkContext.defaultParallelism)
    piece = F.pmod(F.xxhash64("idx"), F.lit(pieces)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    left = slim.select("idx", "vec", "cluster", piece.alias("a"), every.alias("b"))
    right = slim.select("vec", "cluster", every.alias("ra"), piece.alias("rb")).toDF("vec", "cluster", "ra", "rb")

    def sums(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"idx": [], "own": [], "cluster": [], "total": []})
        a, b = blocks.matrix(l["vec"]), blocks.matrix(r["vec"])
        names, owner = np.unique(r["cluster"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(names)))
        member[np.arange(len(b)), owner] = 1.0
        totals = np.concatenate(
            [np.sqrt(blocks.squared_distances(a[at : at + TILE], b)) @ member for at in range(0, len(a), TILE)]
        )
        return pd.DataFrame(
            {
                "idx": np.repeat(l["idx"].to_numpy(), len(names)), "own": np.repeat(l["cluster"].to_numpy(), len(names)),
                "cluster": np.tile(names, len(a)), "total": totals.ravel(),
            }
        )

    partial = (
        left.groupBy("a", "b")
        .cogroup(right.groupBy("ra", "rb"))
        .applyInPandas(sums, "idx bigint, own int, cluster int, total double")
    )
    sizes = F.broadcast(slim.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    summed = partial.groupBy("idx", "own", "cluster").agg(F.sum("total").alias("total")).join(sizes, "cluster")
    own = F.col("own") == F.col("cluster")
    per_row = summed.groupBy("idx").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.nullif(F.col("size") - 1, F.lit(0))))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    score = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    return per_row.filter(F.col("b").isNotNull()).agg(F.round(F.avg(score), 4).alias("silhouette"))


def run_clustering(
    df: DataFrame, features: list[str], order_by: str, algorithm: str = "kmeans", n_clusters: int = 3,
    max_k: int = 10, seed: int = 42, starts: int = STARTS,
) -> ClusteringResult:
    """Standardise, cluster and evaluate; cluster numbers are arbitrary."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown clustering algorithm: {algorithm}")
    prepared = prepare(df, features, order_by, minimum=3, separator="_")
    if prepared.n < n_clusters:
        raise ValueError(f"Need at least {n_clusters} rows for {n_clusters} clusters")
    rows = standardise(prepared).select("idx", "scaled").persist()
    if algorithm == "kmeans":
        assigned = best_kmeans(rows, n_clusters, seed, starts).transform(rows).select("idx", "cluster")
    else:
        assigned = ward(rows, n_clusters, seed)
    vectors = rows.select("idx", vector_to_array("scaled").alias("vec")).join(assigned, "idx")
    return ClusteringResult(
        assigned, cluster_sizes(assigned, n_clusters), elbow(rows, prepared.n, max_k, seed, starts), silhouette(vectors)
    )


def cluster_vectors(vectors: DataFrame, k: int, seed: int = 42, starts: int = 1) -> DataFrame:
    """(idx, vec, cluster): k-means on ready-made vectors."""
    rows = vectors.select("idx", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("scaled"))
    return best_kmeans(rows, k, seed, starts).transform(rows).select("idx", "vec", "cluster")
