"""Hard-negative mining with exact scores by the Four-Russians method.

A vector's integer weights are cut into bit planes in two's complement, and
every plane is packed into bytes of eight dimensions each. For an anchor and a
group of eight dimensions a table holds the sums of all 256 subsets of the
anchor's eight weights. The inner product is then a matter of look-ups: the
candidate's byte picks a sum in each group, the sums of a plane are added up,
and the planes are added by shifting from the highest down (the sign plane
counts negative). Scores are exact and full.

Candidates are packed once, in blocks of bounded size. Positives are looked for
in blocks of the anchor's own label alone; what they score gives every (anchor,
positive) its range of scores, and a second pass over blocks of all rows finds
the best other-label rows in that range. Anchors come in blocks too: a stated
query set against all rows. A task holds one pair of blocks and its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written
from tabwright.llm.topk import integer_weights

CANDIDATES_PER_BLOCK = 2048
ANCHORS_PER_BLOCK = 256
#: Candidate blocks that share a task, beyond as many tasks as there are shuffle partitions.
BLOCKS_PER_TASK = 8
GROUP = 8
PACKED = "c_ids array<long>, c_labels array<string>, planes binary, bits int, width int"


def padded(weights: list, width: int) -> np.ndarray:
    """Rows of weights as a matrix with zeros up to a multiple of eight dimensions."""
    out = np.zeros((len(weights), -(-width // GROUP) * GROUP), dtype=np.int64)
    for i, w in enumerate(weights):
        out[i, : min(len(w), out.shape[1])] = w[: out.shape[1]]
    return out


def bit_planes(weights: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes; the lowest plane first, the sign plane last."""
    bits = 1 + max((int(x).bit_length() for x in (weights.max(initial=0), ~weights.min(initial=0))), default=0)
    planes = [np.packbits((weights >> b & 1).astype(np.uint8), axis=1).T for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sums of every subset of each group's weights; the first dimension is the highest bit."""
    groups = anchors.T.reshape(-1, GROUP, len(anchors))
    sums = np.zeros((len(groups), 1 << GROUP, len(anchors)), dtype=anchors.dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + groups[:, GROUP - 1 - bit, None]
    return sums


def look_up(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Scores (rows, anchors) of packed candidates: the planes' sums, shifted and added from the sign plane down."""
    scores = np.zeros((planes.shape[2], sums.shape[2]), dtype=sums.dtype)
    picked = np.empty_like(scores)
    for plane in range(len(planes) - 1, -1, -1):
        scores <<= 1
        for group, table in enumerate(sums):
            np.take(table, planes[plane, group], axis=0, out=picked)
            scores += picked
        if plane == len(planes) - 1:
            np.negative(scores, out=scores)
    return scores


def narrowest(anchors: np.ndarray, bits: int) -> np.ndarray:
    """The anchors in 32 bits where no score, nor a sum on the way to it, can leave them."""
    reach = int(np.abs(anchors).sum(axis=1).max(initial=0)) << bits
    return anchors.astype(np.int32) if reach < 1 << 31 else anchors


def pair_scores(anchors: list[dict], pair) -> np.ndarray:
    """Scores of a block of anchors against a block of packed candidates, one row per anchor."""
    weights = padded([a["weights"] for a in anchors], pair.width)
    planes = np.frombuffer(pair.planes, dtype=np.uint8).reshape(pair.bits, -(-pair.width // GROUP), len(pair.c_ids))
    return np.ascontiguousarray(look_up(subset_sums(narrowest(weights, pair.bits)), planes).T)


def first_places(scores: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest allowed scores; of equal scores the earlier place comes first."""
    places = np.flatnonzero(allowed)
    if len(places) > n:
        values = scores[places]
        least = np.partition(values, len(values) - n)[len(values) - n]
        above = places[values > least]
        places = np.concatenate([above, places[values == least][: n - len(above)]])
    return places[np.lexsort((places, -scores[places].astype(np.int64)))]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows as packed planes, in the order of their ids."""
    for batch in batches:
        for block in batch.itertuples(index=False):
            ids = np.asarray(block.ids)
            order = np.argsort(ids, kind="stable")
            width = max(map(len, block.weights), default=0)
            planes = bit_planes(padded(block.weights, width)[order])
            yield pd.DataFrame({
                "key": [block.key], "slot": [block.slot], "c_ids": [ids[order]], "c_labels": [np.asarray(block.labels)[order]],
                "planes": [planes.tobytes()], "bits": [len(planes)], "width": [width],
            })


def _blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """``rows`` with a slot below ``slots``, the number that the rows of one key need at ``per_block`` a slot."""
    sizes = rows.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count(F.lit(1)) / per_block).alias("slots"))
    # Repeated ids are dealt by their place too, so that no block grows with them.
    return rows.join(sizes, F.col("key") == F.col("of")).drop("of").withColumn(
        "slot", F.pmod(F.xxhash64("vec_id", "copy"), F.col("slots"))
    )


def _candidates(rows: DataFrame, per_block: int) -> DataFrame:
    """Packed blocks (key, slot, ...) of rows (key, vec_id, label, weights, copy)."""
    lists = _blocks(rows, per_block).groupBy("key", "slot").agg(
        *(F.collect_list(c).alias(n) for c, n in (("vec_id", "ids"), ("label", "labels"), ("weights", "weights")))
    )
    return written(lists.mapInPandas(_pack, f"key string, slot long, {PACKED}"), "blocks")


def _met(anchors: DataFrame, candidates: DataFrame, per_block: int) -> DataFrame:
    """Every block of anchors (key, vec_id, copy, ...) beside every candidate block of its key."""
    lists = _blocks(anchors, per_block).groupBy("key", "slot").agg(
        F.collect_list(F.struct(*[c for c in anchors.columns if c not in ("key", "copy")])).alias("anchors")
    )
    counts = candidates.groupBy(F.col("key").alias("of")).agg(F.max("slot").alias("last"))
    asked = lists.join(counts, F.col("key") == F.col("of")).select(
        F.col("key").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("at"), "anchors"
    )
    # Pairs are few and heavy rows: their number of tasks is set, not left to their size.
    least = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-candidates.count() // BLOCKS_PER_TASK))
    asked, blocks = asked.repartition(tasks, "of", "at"), candidates.repartition(tasks, "key", "slot")
    return asked.join(blocks.hint("shuffle_hash"), (F.col("of") == F.col("key")) & (F.col("at") == F.col("slot"))).select(
        "anchors", "c_ids", "c_labels", "planes", "bits", "width"
    )


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
    per_candidates: int = CANDIDATES_PER_BLOCK, per_anchors: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's hard negatives.

    A component x counts floor(scale * x); a score is the inner product with the
    anchor. An anchor's positives are the first ``positives`` other rows of its
    label by score, ties by smaller id; a positive's negatives the first
    ``negatives`` rows of another label with low_percent * positive_score <=
    100 * negative_score <= high_percent * positive_score.

    Rows without id or label, and vectors that are null or hold a null or
    non-finite component, take no part. Vectors of different length meet on the
    dimensions that both have; an empty vector scores 0. An id on several rows
    is a candidate as often as it has rows, though never for its own anchor; as
    an anchor its rows count once, with the least label and weights. An anchor
    without positives, and a positive without a row in its range, give no rows,
    nor does an empty table. Other columns are not read. Scores, and 100 times
    them, must fit a long.
    """
    kind = F.col(f"`{label}`") if isinstance(label, str) else label
    base = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), kind.cast("string").alias("label"),
        integer_weights(F.col(f"`{vector}`"), scale).alias("weights"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).dropna(subset=["vec_id", "label", "weights"])
    # Numbered once, so that rows that repeat deal out evenly and alike on every read.
    stored = written(base.withColumn("copy", F.monotonically_increasing_id()), "vectors")
    anchors = stored.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "weights")).alias("own"))
    anchors = written(anchors.select("vec_id", "own.label", "own.weights", F.lit(0).alias("copy")), "anchors")
    rows = stored.drop("asks")

    def find_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids, found = np.asarray(pair.c_ids), []
                for anchor, row in zip(pair.anchors, pair_scores(pair.anchors, pair)):
                    for place in first_places(row, ids != anchor["vec_id"], positives):
                        found.append((anchor["vec_id"], ids[place], row[place]))
                yield pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"])

    def find_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids, labels, found = np.asarray(pair.c_ids), np.asarray(pair.c_labels), []
                others = {own: labels != own for own in {a["label"] for a in pair.anchors}}
                for anchor, row in zip(pair.anchors, pair_scores(pair.anchors, pair)):
                    other = np.flatnonzero(others[anchor["label"]] & (ids != anchor["vec_id"]))
                    values, seen = row[other].astype(np.int64), {}
                    hundred = 100 * values
                    for positive in anchor["positives"]:
                        level = positive["positive_score"]
                        if level not in seen:
                            fits = (hundred >= low_percent * level) & (hundred <= high_percent * level)
                            seen[level] = first_places(values, fits, negatives)
                        for place in seen[level]:
                            found.append((anchor["vec_id"], positive["positive_id"], positive["turn"], level,
                                          ids[other[place]], values[place]))
                yield pd.DataFrame(found, columns=["anchor_id", "positive_id", "turn", "positive_score", "negative_id",
                                                   "negative_score"])

    near = _met(anchors.withColumn("key", F.col("label")),
                _candidates(rows.withColumn("key", F.col("label")), per_candidates), per_anchors)
    near = near.mapInPandas(find_positives, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= positives)
    lists = chosen.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "turn", "positive_score")).alias("positives")
    )
    asking = written(anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "asking")
    all_rows = F.lit("all")
    pairs = _met(asking.withColumn("key", all_rows), _candidates(rows.withColumn("key", all_rows), per_candidates), per_anchors)
    far = pairs.mapInPandas(
        find_negatives,
        "anchor_id long, positive_id long, turn int, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "turn").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
