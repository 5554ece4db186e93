"""Blocked vector work: bounded groups for all-pairs style operators.

Rows are vectors ``vec`` with a unique ``idx``. They are assigned to the nearest
of a bounded number of pivot rows (a cell) and each cell is cut by hash into
chunks of bounded size, however many rows a cell attracts. Block pairs are
matched with an equi-join on their ids; numpy kernels work on two bounded blocks
and return only what the operator needs, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 256
ROWS_PER_PIVOT = 2048
MAX_BLOCK = 8192
#: Rows whose distances to all pivots are laid out at once.
ASSIGNED = 2048


@dataclass(frozen=True)
class Cells:
    """Pivot vectors with the row count, radius and chunk count of their cells."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray


def choose_pivots(vectors: DataFrame, n: int, most: int | None = None) -> np.ndarray:
    """A seeded sample of at most ``most`` (MAX_PIVOTS) distinct rows."""
    wanted = max(1, min(most or MAX_PIVOTS, ceil(n / ROWS_PER_PIVOT)))
    rows = vectors.select("idx", "vec").orderBy(F.xxhash64("idx"), "idx").limit(wanted).collect()
    return np.unique(np.asarray([r["vec"] for r in rows], dtype=float), axis=0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(gap, 0.0)


def matrix(series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, 0))


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    def nearest(batches):
        for batch in batches:
            if not len(batch):
                continue
            for start in range(0, len(batch), ASSIGNED):
                part = batch.iloc[start : start + ASSIGNED]
                gaps = squared_distances(matrix(part["vec"]), pivots)
                cell = gaps.argmin(axis=1)
                yield part.assign(cell=cell, reach=np.sqrt(gaps[np.arange(len(cell)), cell]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(nearest, f"{schema}, cell int, reach double")


def cell_facts(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    """Row count and radius per cell: one row per pivot reaches the driver."""
    count, radius = np.zeros(len(pivots), dtype=int), np.zeros(len(pivots))
    for row in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():
        count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return Cells(pivots, count, radius, np.maximum(1, np.ceil(count / MAX_BLOCK)).astype(int))


def with_chunk(assigned: DataFrame, cells: Cells, name: str = "chunk") -> DataFrame:
    """Add the chunk of a row within its cell, by hash of the row id."""
    return assigned.withColumn(name, F.pmod(F.xxhash64("idx"), of_cell(cells.chunks).cast("bigint")).cast("int"))


def of_cell(numbers: np.ndarray) -> Column:
    """The number of a row's cell. One literal holds them all, however many cells there are."""
    listed = F.split(F.lit(",".join(str(int(n)) for n in numbers)), ",").cast("array<int>")
    return F.element_at(listed, F.col("cell") + 1)


def boxes(b: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers, in order, of parts of at most ``most`` rows: halved across the widest side, again and again."""
    todo, done = [np.arange(len(b))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(np.sort(rows))
            continue
        side = np.ptp(b[rows], axis=0).argmax()
        rows = rows[np.argpartition(b[rows, side], len(rows) // 2)]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return done
