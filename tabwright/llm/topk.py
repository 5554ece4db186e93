"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term; a vector's non-zero integer weights are its postings.
Candidates are dealt into blocks by a hash of their id, queries into blocks of
their own. A block is one row whose weights are packed as bytes of the least
width that holds them, so that neither the driver nor an executor's heap ever has
lists of them. Blocks of queries come in bands; every band meets each candidate block once: a
stated query set against all rows, in blocks. There every term's postings times the queries'
weights are scattered into a dense array of scores (one row per query), a tile of queries at a
time, the k best of each row are found by partition selection, and the k best of the blocks are
merged per query. Memory in a task is one candidate block, one band and a tile of scores, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written

CANDIDATES_PER_BLOCK = 8192
#: Candidate blocks above which blocks become larger instead of more, up to MOST_CANDIDATES: every block reads all queries.
MANY_BLOCKS = 96
MOST_CANDIDATES = 1 << 17
QUERIES_PER_BLOCK = 256
#: Query blocks that meet a candidate block in one group.
BAND = 128
#: Scores held at once in a task.
SCORES = 1 << 18
PACKED_NAMES = ["block", "n", "width", "kind", "ids", "weights"]
PACKED = "block int, n int, width int, kind string, ids binary, weights binary"


def integer_weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where a component or the vector is null or not finite."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(vector.isNotNull() & fit, doubles)


def postings(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term: the places of the rows that hold it and their weights; of a term that most rows hold, all rows and their weights or 0."""
    out = []
    for column in weights.T:
        held = np.flatnonzero(column)
        held = held if 2 * len(held) < len(column) else np.arange(len(column))
        out.append((held, column[held]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Scores of every query against ``rows`` candidates, one term at a time; in the type of ``queries``, which must hold them."""
    scores = np.zeros((len(queries), rows), dtype=queries.dtype)
    for term, (held, weights) in enumerate(lists[: queries.shape[1]]):
        if len(held) == rows:
            scores += np.multiply.outer(queries[:, term], weights)
        elif len(held):
            scores[:, held] += np.multiply.outer(queries[:, term], weights)
    return scores


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the k best of every row of scores, the best first; of equal scores the earlier place comes first."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        row, place = np.nonzero(scores >= least)
    else:
        row, place = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((place, -scores[row, place].astype(np.int64), row))
    row, place = row[order], place[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], place[first]


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of weights as long as the longest, with zeros behind."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(counts.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(table: pa.Table) -> pa.Table:
    """One row for a group of (block, vec_id, weights): its ids in order and their weights in the least type that holds them."""
    table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
    weights = matrix(table.column("weights").combine_chunks())
    kind = np.result_type(np.min_scalar_type(weights.min(initial=0)), np.min_scalar_type(weights.max(initial=0)), np.int8)
    kind = kind if np.issubdtype(kind, np.signedinteger) else np.dtype(np.int64)
    values = [table.column("block")[0].as_py(), *weights.shape, kind.str, table.column("vec_id").to_numpy().astype("<i8").tobytes(),
              weights.astype(kind).tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(values, (*[pa.int32()] * 3, pa.string(), pa.binary(), pa.binary()))], names=PACKED_NAMES)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of a packed block."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], row["kind"]).reshape(row["n"], row["width"])


def _best(queries: tuple[np.ndarray, np.ndarray], cands: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query ids, candidate ids, scores) of the k best candidates of every query, tile by tile."""
    (asking, wanted), (ids, weights) = queries, cands
    width = min(wanted.shape[1], weights.shape[1])
    wanted, weights = wanted[:, :width], weights[:, :width]
    # Sums are exact: scores that may leave 32 bits are summed in 64.
    most = sum(int(a) * int(b) for a, b in zip(np.abs(wanted.astype(object)).max(axis=0, initial=0), np.abs(weights.astype(object)).max(axis=0, initial=0)))
    kind = np.int32 if most < np.iinfo(np.int32).max else np.int64
    none = np.iinfo(kind).min
    lists = postings(weights.astype(kind))
    step = max(1, SCORES // max(1, len(ids)))
    for low in range(0, len(asking), step):
        scores = accumulate(wanted[low : low + step].astype(kind), lists, len(ids))
        own = asking[low : low + step]
        # A query's own id is on neighbouring places of the sorted ids.
        begin, end = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for q in np.flatnonzero(end > begin):
            scores[q, begin[q] : end[q]] = none
        row, place = select(scores, k)
        found = scores[row, place]
        real = found != none
        yield own[row[real]], ids[place[real]], found[real].astype(np.int64)


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    # Repeated ids are dealt by their weights too, so that no block grows with them.
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "weights", "copy"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "weights")
    return dealt.groupBy("block").applyInArrow(_pack, PACKED)


def _block_count(rows: int, per_block: int) -> int:
    """Blocks of ``per_block`` candidates, or of more where there would be too many."""
    small = max(1, -(-rows // per_block))
    return min(small, max(MANY_BLOCKS, -(-rows // MOST_CANDIDATES)))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding",
    per_candidates: int = CANDIDATES_PER_BLOCK, per_queries: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    ``is_query`` marks the query rows. A query's own id is no candidate. Rows
    without id, and vectors that are null or hold a null or non-finite
    component, take no part. Ties go to the smaller id. Vectors of different
    length meet on the dimensions that both have; an empty vector scores 0.
    An id on several rows is a candidate as often as it has rows; as a query
    its rows count once, with the least weights. Scores must fit a long.
    """
    base = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        integer_weights(F.col(f"`{vector}`"), scale).alias("weights"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("weights").isNotNull())
    # Tables of vectors are numbered once, so that rows that repeat deal out evenly and alike on every read.
    stored = written(base.withColumn("copy", F.monotonically_increasing_id()), "vectors")
    asks = stored.where("asks").groupBy("vec_id").agg(F.min("weights").alias("weights"), F.lit(0).alias("copy"))
    n_cands = _block_count(stored.count(), per_candidates)
    n_queries = max(1, -(-asks.count() // per_queries))
    cands, queries = _blocks(stored.drop("asks"), n_cands), _blocks(asks, n_queries)
    # The packed rows are read once for every band and for every candidate block, so they are stored.
    cands, queries = written(cands, "candidates"), written(queries, "queries")
    bands = -(-n_queries // BAND)
    cands = cands.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    queries = queries.withColumns({"band": F.floor(F.col("block") / BAND).cast("int"), "slot": F.explode(F.sequence(F.lit(0), F.lit(n_cands - 1)))})

    def score(asked: pa.Table, block: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for cand in block.to_pylist():
            of = _unpack(cand)
            for n in range(asked.num_rows):
                found += _best(_unpack(asked.slice(n, 1).to_pylist()[0]), of, k)
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("slot", "band").cogroup(cands.groupBy("block", "band")).applyInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
