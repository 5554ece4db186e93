"""Rows as packed blocks: what an iterative fit reads again and again.

A block is one row that holds some thousand vectors as bytes, so that a pass moves
bytes alone and a task works on one matrix at a time, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Rows that a kernel lays out at once.
TILE = 4096
#: Numbers of a sum up to which the tasks' sums are added on the driver; wider ones are added by tasks first.
WIDE = 1 << 14
#: Numbers a row up to which rows are dealt into boxes of at most BOX neighbours, and rows of such a block.
NARROW = 8
BOX = 64
BLOCK = 1 << 20


def packed(rows: DataFrame, vector: str = "vec", number: str | None = None) -> DataFrame:
    """(data, extra, n): blocks of an array column, with a double column beside it; persisted, to be unpersisted by the caller.

    A small input is dealt over all cores first: one file may come as one task.
    """
    from tabwright.plans.parallel import spread

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            extra = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if number else b""
            yield pa.RecordBatch.from_arrays(
                [pa.array([data.tobytes()], pa.binary()), pa.array([extra], pa.binary()), pa.array([batch.num_rows], pa.int32())],
                names=["data", "extra", "n"],
            )

    blocks = spread(rows.select(vector, *([number] if number else []))).mapInArrow(pack, "data binary, extra binary, n int")
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def boxed(rows: DataFrame, vector: str = "vec") -> DataFrame:
    """Like ``packed``, in blocks of up to BLOCK rows dealt into boxes of neighbours, whose first places are the numbers beside the rows.

    Rows of more than NARROW numbers stay as they come, without boxes: these would leave nothing out.
    """
    from tabwright.plans.blocks import boxes
    from tabwright.plans.parallel import spread

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        x, starts = np.concatenate(parts), np.zeros(0)
        if x.shape[1] <= NARROW:
            dealt = boxes(x, BOX)
            x, starts = x[np.concatenate(dealt)], np.cumsum([0, *map(len, dealt[:-1])]).astype(np.float64)
        return pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()), pa.array([starts.tobytes()], pa.binary()), pa.array([len(x)], pa.int32())],
            names=["data", "extra", "n"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            parts.append(data)
            if data.shape[1] > NARROW or sum(map(len, parts)) >= BLOCK:
                yield block(parts)
                parts = []
        if parts:
            yield block(parts)

    return spread(rows.select(vector)).mapInArrow(pack, "data binary, extra binary, n int").persist(StorageLevel.MEMORY_AND_DISK)


def matrices(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, numbers) of each block of a batch."""
    for data, extra, n in zip(batch["data"], batch["extra"], batch["n"]):
        yield np.frombuffer(data).reshape(n, -1), np.frombuffer(extra)


def summed(blocks: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of ``kernel(vectors, numbers)``, an array of ``size`` numbers; one of them leaves a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for vectors, numbers in matrices(batch):
                total += kernel(vectors, numbers)
        yield pd.DataFrame({"total": [total.tobytes()]})

    parts = blocks.mapInPandas(run, "total binary")
    if size <= WIDE:
        return np.sum([np.frombuffer(r["total"]) for r in parts.collect()], axis=0)
    return parts.rdd.map(lambda r: np.frombuffer(r["total"])).treeReduce(add, depth=2)
