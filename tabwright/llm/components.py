"""Connected components of an undirected graph given as a table of links.

Alternating star contraction: each round hangs every node's larger neighbours,
then its smaller ones, below the least node it knows, until nothing changes. A
round is two aggregate-and-join steps whose hot nodes fold map-side (minimum)
and split (join), so a node with a third of all links meets no single task. The
links of each round are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written


class Forest:
    """Union-find over 0..n-1; the least member is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        """Every member's root; halves the paths of all members at once."""
        parent = self.parent
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                return parent
            self.parent = parent = above

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def join(self, a: int, b: int) -> bool:
        """Unite two members' trees; False where they were one before."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each batch as stars around the least node of their components."""
    for batch in batches:
        if not len(batch):
            continue
        nodes, places = np.unique(batch[["a", "b"]].to_numpy(), return_inverse=True)
        places = places.reshape(-1, 2)
        forest = Forest(len(nodes))
        for a, b in places.tolist():
            forest.join(a, b)
        roots = forest.roots()
        hung = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[hung], "b": nodes[roots[hung]]})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links with a > b."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = links
    least = ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    met = ways.join(least, F.col("a") == F.col("node"))
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the least node that it reaches.

    Links are pairs of longs; links to oneself, repeated links and links with a
    null are no obstacle (a null links nothing). Nodes without a link to
    another node are not returned. No links give an empty table.
    """
    pairs = links.select(
        F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    state = written(pairs.mapInPandas(_contract, "a long, b long").distinct(), "links")
    before = _print_of(state)
    while before[0]:
        state = written(_star(_star(state, large=True), large=False), "links")
        after = _print_of(state)
        if after == before:
            break
        before = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
