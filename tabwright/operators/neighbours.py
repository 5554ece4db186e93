"""Exact k-nearest-neighbour search between two tables of vectors.

Cells around pivots (Lu et al., 2012): a query first looks into its own cell,
which bounds its k-th distance, then only into cells whose ball, and whose side of the
plane between the two pivots, can hold a closer row. Both sides of a cell are cut into bounded chunks. Rows of
few numbers are parted into small boxes within a chunk, and a query meets those near enough alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.plans import blocks
from tabwright.plans.blocks import boxes
from tabwright.session import cut_lineage

_FOUND = "query bigint, neighbour bigint, gap double"
QUERY_CHUNK = 4096
#: Up to this many numbers a row, small cells leave out most of the others: more pivots are taken.
NARROW = 8
NARROW_PIVOTS = 2048
#: Base rows of a box.
BOX = 256


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``, 9 decimals; of narrow rows by their differences, without cancellation."""
    if a.shape[1] > NARROW:
        return np.round(np.sqrt(blocks.squared_distances(a, b)), 9)
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        total += (a[:, axis, None] - b[None, :, axis]) ** 2
    return np.round(np.sqrt(total), 9)


def _first(row: np.ndarray, column: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest columns of every row, ties to the smaller column."""
    order = np.lexsort((column, near, row))
    row, column, near = row[order], column[order], near[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], near[first]


def _nearest_rows(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of ``b``."""
    parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    keep = min(k, len(b))
    for start in range(0, len(a), 512):
        gaps = _gaps(a[start : start + 512], b)
        # No row is sorted whole: only what is as near as its k-th nearest; columns stand in the order of ids.
        limit = np.partition(gaps, keep - 1, axis=1)[:, keep - 1 : keep]
        row, column = np.nonzero(gaps <= limit)
        row, column, near = _first(row, column, gaps[row, column], keep)
        parts.append((row + start, column, near))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _nearest_in_boxes(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_nearest_rows`` by boxes: a query's nearest box bounds its k-th distance, and only boxes within that are met."""
    parts = boxes(b, BOX)
    low, high = (np.stack([f(b[rows], axis=0) for rows in parts]) for f in (np.min, np.max))
    away = np.zeros((len(a), len(parts)))
    for axis in range(a.shape[1]):
        x = a[:, axis, None]
        away += np.maximum(np.maximum(low[None, :, axis] - x, x - high[None, :, axis]), 0.0) ** 2
    away = np.sqrt(away)
    home = away.argmin(axis=1)
    limit = np.full(len(a), np.inf)
    found = []

    def meet(asked: np.ndarray, part: int) -> None:
        row, column, near = _nearest_rows(a[asked], b[parts[part]], k)
        found.append((asked[row], parts[part][column], near))

    for part in np.unique(home):
        asked = np.flatnonzero(home == part)
        meet(asked, part)
        if len(parts[part]) >= k:
            np.minimum.at(limit, asked, _kth(*found[-1][::2], len(a))[asked])
    open_box = away <= limit[:, None] + 1e-6
    open_box[np.arange(len(a)), home] = False
    for part in np.flatnonzero(open_box.any(axis=0)):
        meet(np.flatnonzero(open_box[:, part]), part)
    return _first(*(np.concatenate(x) for x in zip(*found)), k)


def _kth(row: np.ndarray, near: np.ndarray, rows: int) -> np.ndarray:
    """The largest distance found for every row."""
    worst = np.zeros(rows)
    np.maximum.at(worst, row, near)
    return worst


def _local_nearest(queries: pd.DataFrame, base: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(base):
        return pd.DataFrame({"query": [], "neighbour": [], "gap": []})
    base = base.sort_values("idx")
    a, b, ids = blocks.matrix(queries["vec"]), blocks.matrix(base["vec"]), base["idx"].to_numpy()
    small = b.shape[1] > NARROW or len(b) <= 4 * BOX
    row, column, near = (_nearest_rows if small else _nearest_in_boxes)(a, b, k)
    return pd.DataFrame({"query": queries["idx"].to_numpy()[row], "neighbour": ids[column], "gap": near})


def _match(queries: DataFrame, base: DataFrame, facts: blocks.Cells, k: int) -> DataFrame:
    """Compare query pieces with every chunk of their cell; local k nearest each.

    ``queries`` is materialised. A cell is cut into as many query pieces as its own
    number of queries asks for, so a hot cell does not multiply the others.
    """
    asked = np.zeros(len(facts.pivots), dtype=int)
    for row in queries.groupBy("cell").count().collect():
        asked[row["cell"]] = row["count"]
    pieces = np.maximum(1, -(-asked // QUERY_CHUNK))

    of_cell = blocks.of_cell
    spread = queries.select(
        "idx", "vec", "cell",
        F.pmod(F.xxhash64("idx"), of_cell(pieces).cast("bigint")).cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), of_cell(facts.chunks) - 1)).alias("chunk"),
    )
    copies = base.filter(of_cell(asked) > 0).select(
        "idx", "vec", "cell", "chunk", F.explode(F.sequence(F.lit(0), of_cell(pieces) - 1)).alias("piece")
    ).toDF("idx", "vec", "r_cell", "r_chunk", "r_piece")
    key = ["cell", "chunk", "piece"]
    return (
        spread.groupBy(*key)
        .cogroup(copies.groupBy(*(f"r_{c}" for c in key)))
        .applyInPandas(lambda q, b: _local_nearest(q, b, k), _FOUND)
    )


def _closest(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query").orderBy("gap", "neighbour")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """(query, neighbour, gap, rank): the k nearest base rows of every query row.

    Both tables have ``idx`` and ``vec``. Ties go to the smaller base id.
    """
    # Of equal base rows the k least ids alone can be an answer; equal queries have one answer.
    first = Window.partitionBy("vec").orderBy("idx")
    wide = base.select("idx", F.col("vec").cast("array<double>").alias("vec"))
    base = cut_lineage(wide.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k).drop("_k"))
    asking = cut_lineage(queries.select("idx", F.col("vec").cast("array<double>").alias("vec")))
    queries = cut_lineage(asking.groupBy("vec").agg(F.min("idx").alias("idx")).select("idx", "vec"))
    answers = _nearest_distinct(queries, base, k)
    same = asking.join(queries.select(F.col("idx").alias("of"), F.col("vec").alias("like")), F.col("vec") == F.col("like"))
    return same.select("idx", "of").join(answers, F.col("of") == F.col("query")).select(
        F.col("idx").alias("query"), "neighbour", "gap", "rank"
    )


def _over_the_plane(gap: np.ndarray, cell: np.ndarray, pivots: np.ndarray, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """At least how far rows are from where the ``other`` pivot is nearer than their own, less what the arithmetic may be off."""
    own = gap[row, cell[row]]
    apart = np.sqrt(((pivots[cell[row]] - pivots[other]) ** 2).sum(axis=1))
    size = 1e-13 * ((pivots**2).sum(axis=1).max() + gap[row, other] ** 2)
    return (gap[row, other] ** 2 - own**2 - size) / np.maximum(2 * apart, 1e-300)


def _nearest_distinct(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``nearest`` of materialised tables."""
    total = base.count()
    if not total or queries.isEmpty():
        return queries.sparkSession.createDataFrame([], _FOUND + ", rank int")
    width = len(base.first()["vec"])
    pivots = blocks.choose_pivots(base, total, max(NARROW_PIVOTS, blocks.MAX_PIVOTS) if width <= NARROW else None)
    # Read three times, and every row takes a distance to each pivot.
    placed = cut_lineage(blocks.assign_cells(base, pivots))
    facts = blocks.cell_facts(placed, pivots)
    placed = blocks.with_chunk(placed, facts).select("idx", "vec", "cell", "chunk")
    homes = cut_lineage(blocks.assign_cells(queries, pivots))
    inside = cut_lineage(_closest(_match(homes, placed, facts, k), k))
    if len(pivots) == 1:
        return inside
    limits = inside.groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("gap")).otherwise(F.lit(float("inf"))).alias("limit")
    )
    asked_again = homes.join(limits, homes["idx"] == limits["query"], "left").select(
        "idx", "vec", "cell", F.coalesce("limit", F.lit(float("inf"))).alias("limit")
    )
    alive, radius = facts.rows > 0, facts.radius

    def candidates(batches):
        for batch in batches:
            for start in range(0, len(batch), blocks.ASSIGNED):
                part = batch.iloc[start : start + blocks.ASSIGNED]
                gap = np.sqrt(blocks.squared_distances(blocks.matrix(part["vec"]), pivots))
                limit, cell = part["limit"].to_numpy(), part["cell"].to_numpy()
                open_cell = (gap - radius[None, :] <= limit[:, None] + 1e-6) & alive[None, :]
                open_cell[np.arange(len(part)), cell] = False
                row, other = np.nonzero(open_cell)
                open_cell[row, other] = _over_the_plane(gap, cell, pivots, row, other) <= limit[row] + 1e-6
                yield pd.DataFrame({"idx": part["idx"], "vec": part["vec"], "cells": [np.flatnonzero(row) for row in open_cell]})

    # Spark copies a query for its cells: a worker holds it once.
    listed = asked_again.mapInPandas(candidates, "idx bigint, vec array<double>, cells array<int>")
    outside = cut_lineage(listed.select("idx", "vec", F.explode("cells").alias("cell")))
    more = _match(outside, placed, facts, k)
    return _closest(inside.drop("rank").unionByName(more), k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, predicted, confidence): majority label, ties to the smaller label.

    ``labels`` has ``idx`` and ``label``.
    """
    named = neighbours.join(labels.select(F.col("idx").alias("neighbour"), "label"), "neighbour")
    counts = named.groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), F.col("label")))
    return counts.groupBy("query").agg(best.alias("b"), F.sum("votes").alias("all")).select(
        "query", F.col("b.label").alias("predicted"), F.round(F.col("b.votes") / F.col("all"), 4).alias("confidence")
    )
