"""Random forests whose passes do not grow with their depth.

Features become bins, equal binned rows one cell. One pass draws every tree's
bootstrap weights and folds them per cell; a task then grows a tree from its
cells. A node with more rows than a task should hold is split first, level by
level, from histograms that tasks add up, and its leaves are grown singly. The
trees stay a table: a row's votes are summed where a tree meets its cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.session import stored

#: Bytes of sums that a task keeps before it passes them on, and of a pass's histograms.
FLUSH_BYTES = 1 << 27
#: Bytes of rows up to which a node is grown by one task.
NODE_BYTES = 1 << 25
#: Quantiles from which the split candidates of a feature are taken; one with fewer values is split between any two.
QUANTILES = 4096
#: Relative difference of gains that rounding explains.
TIE = 1e-9


def _bytes(array: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(array, dtype=kind).tobytes()


def _thresholds(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Split candidates per feature, at most ``bins - 1``: halfway between values, or between quantiles of many values."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = (
        rows.select(F.posexplode("features").alias("axis", "x")).groupBy("axis")
        .agg(F.percentile_approx("x", F.array(*map(F.lit, shares)), F.lit(4 * QUANTILES)).alias("marks")).collect()  # one row per feature
    )
    out = []
    for _, marks in sorted((r["axis"], np.unique(r["marks"])) for r in found):
        if len(marks) > bins:
            marks = np.unique(marks[np.linspace(0, len(marks) - 1, bins).round().astype(int)])
        out.append((marks[1:] + marks[:-1]) / 2)
    return out


def _binned(features: Column, thresholds: list[np.ndarray]) -> Column:
    """The bins of a feature array as bytes: equal bytes, equal way through every tree."""
    kind = np.uint8 if max(map(len, thresholds)) < 256 else np.uint16

    @F.pandas_udf("binary")
    def cell(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy())
        # As in Spark's trees, a value at the threshold goes left.
        at = np.column_stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)]).astype(kind)
        return pd.Series([row.tobytes() for row in at])

    return cell(features)


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, n, cell, y, copies): rows (cell, y, copies) as packed blocks, stored, so that a block's draws are the same in every pass."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(b for b in batches if b.num_rows):
            cells = b"".join(batch.column(0).to_pylist())
            y, copies = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=t) for c, t in ((1, np.float64), (2, np.int64)))
            arrays = [[place + k], [batch.num_rows], [cells], [y.tobytes()], [copies.tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["block", "n", "cell", "y", "copies"],
            )

    return stored(rows.mapInArrow(pack, "block bigint, n int, cell binary, y binary, copies binary"), "forest-rows")


def route(tree: dict, cells: np.ndarray) -> np.ndarray:
    """The node of ``tree`` where each binned row ends."""
    at = np.zeros(len(cells), dtype=np.int64)
    going = np.arange(len(cells))
    while True:
        going = going[tree["left"][at[going]] > 0]
        if not len(going):
            return at
        node = at[going]
        at[going] = tree["left"][node] + (cells[going, tree["feature"][node]] > tree["bin"][node])


def _score(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a node explains, apart from what its rows share: the squared class weights, or the squared sum, per weight."""
    if classes:
        return (sums * sums).sum(-1) / np.maximum(sums.sum(-1), 1e-300)
    return sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1e-300)


def _allowed(key: list[int], nodes: int, width: int, taken: int) -> np.ndarray | None:
    """Which features each node may split on; None: all."""
    if taken >= width:
        return None
    order = np.argsort(np.random.default_rng(key).random((nodes, width)), axis=1)
    mask = np.zeros((nodes, width), dtype=bool)
    np.put_along_axis(mask, order[:, :taken], True, axis=1)
    return mask


def grown(cells: np.ndarray, sums: np.ndarray, classes: int, depth: int, taken: int, key: list[int]) -> tuple[dict, np.ndarray]:
    """A tree over weighted cells, level by level, and the gain by feature.

    ``sums`` are the class weights of a cell, or its (weight, sum, square sum).
    """
    n, width = cells.shape
    at, first, size = np.zeros(n, dtype=np.int64), 0, 1
    feature, cut, left = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
    totals, gains = [sums.sum(axis=0, keepdims=True)], np.zeros(width)
    live = np.arange(n)
    for level in range(depth):
        # Rows of nodes that may be split; nodes of the level count from zero.
        node = at[live] - first
        whole = totals[-1]
        base = _score(whole, classes)
        best, best_feature, best_cut = np.zeros(size), np.full(size, -1), np.zeros(size, dtype=np.int64)
        allowed = _allowed([*key, level], size, width, taken)
        for f in range(width):
            place = node * (1 << 16) + cells[live, f]
            order = np.argsort(place, kind="stable")
            place = place[order]
            run = np.cumsum(sums[live[order]], axis=0)
            owner = place >> 16
            ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
            before = np.zeros((size, sums.shape[1]))
            before[owner[ends[1:]]] = run[ends[:-1]]
            # A cut lies where the bin changes inside a node.
            cuts = np.flatnonzero((place[1:] != place[:-1]) & (owner[1:] == owner[:-1]))
            if not len(cuts):
                continue
            of = owner[cuts]
            low = run[cuts] - before[of]
            gain = _score(low, classes) + _score(whole[of] - low, classes) - base[of]
            if allowed is not None:
                gain[~allowed[of, f]] = 0
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            top = np.maximum.reduceat(gain, starts)
            # Gains that differ by rounding alone are ties, and the first one wins.
            hit = np.flatnonzero(gain >= (1 - TIE) * np.repeat(top, np.diff(np.append(starts, len(of)))))
            hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])]
            better = hit[gain[hit] > (1 + TIE) * best[of[hit]]]
            best[of[better]], best_feature[of[better]], best_cut[of[better]] = gain[better], f, place[cuts[better]] & 0xFFFF
        # Rounding alone is no gain.
        split = (best_feature >= 0) & (best > TIE * np.maximum(base, TIE))
        if not split.any():
            break
        gains += np.bincount(best_feature[split], weights=best[split], minlength=width)
        child = np.zeros(size, dtype=np.int64)
        child[split] = first + size + 2 * np.arange(split.sum())
        feature[-1], cut[-1], left[-1] = np.where(split, best_feature, 0).astype(np.int32), best_cut.astype(np.int32), child.astype(np.int32)
        keep = split[node]
        live, node = live[keep], node[keep]
        at[live] = child[node] + (cells[live, best_feature[node]] > best_cut[node])
        first, size = first + size, 2 * int(split.sum())
        totals.append(np.column_stack([np.bincount(at[live] - first, weights=sums[live, k], minlength=size) for k in range(sums.shape[1])]))
        for part in (feature, cut, left):
            part.append(np.zeros(size, np.int32))
    whole = np.concatenate(totals)
    value = whole / np.maximum(whole.sum(axis=1, keepdims=True), 1e-300) if classes else whole[:, 1:2] / np.maximum(whole[:, :1], 1e-300)
    return {"feature": np.concatenate(feature), "bin": np.concatenate(cut), "left": np.concatenate(left), "value": value}, gains


class _Fit:
    """What tasks of a fit need to know."""

    def __init__(self, options: dict, width: int, wide: bool, classes: int, centre: float) -> None:
        self.width, self.classes, self.centre = width, classes, centre
        self.trees, self.seed, self.depth = options["numTrees"], options["seed"], options["maxDepth"]
        self.bins, self.kind = options["maxBins"], np.uint16 if wide else np.uint8
        self.sums = classes or 3
        self.taken = width if options["featureSubsetStrategy"] == "all" else ceil(sqrt(width)) if classes else ceil(width / 3)

    def read(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = np.frombuffer(block.cell, dtype=self.kind).reshape(block.n, self.width)
        return cells, np.frombuffer(block.y) - self.centre, np.frombuffer(block.copies, dtype=np.int64)

    def drawn(self, block: int, tree: int, copies: np.ndarray) -> np.ndarray:
        """Bootstrap weights: each row counts Poisson(1) times, hence a row that stands for n Poisson(n) times."""
        rng = np.random.Generator(np.random.Philox(key=(self.seed << 32 | tree, int(block))))
        return (rng.poisson(1.0, len(copies)) if (copies == 1).all() else rng.poisson(copies)).astype(float)

    def parts(self, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """What a row adds to each of a node's sums."""
        if self.classes:
            return [weight * (y == c) for c in range(self.classes)]
        return [weight, weight * y, weight * y * y]


def _folded(fit: _Fit, blocks: DataFrame, tops: dict[int, dict]) -> DataFrame:
    """(tree, node, cell, sums): every tree's weighted cells, folded in each task."""
    width, kind, count = fit.width, fit.kind, fit.sums

    def pour(known, total):
        for tree in range(fit.trees):
            held = total[tree].any(axis=1)
            cells, sums = known[held], total[tree][held]
            node = route(tops[tree], cells) if tree in tops else np.zeros(len(cells), dtype=np.int64)
            for k in np.unique(node):
                yield tree, int(k), _bytes(cells[node == k], kind), _bytes(sums[node == k], np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = np.zeros((0, width), dtype=kind), np.zeros((fit.trees, 0, count))
        for batch in batches:
            for block in batch.itertuples():
                cells, y, copies = fit.read(block)
                both = np.concatenate([known, cells])
                fresh, place = _unique(both)
                if len(fresh) > len(known):
                    wider = np.zeros((fit.trees, len(fresh), count))
                    wider[:, place[: len(known)]] = total
                    known, total = both[fresh], wider
                place = place[len(both) - len(cells) :]
                for tree in range(fit.trees):
                    for c, part in enumerate(fit.parts(y, fit.drawn(block.block, tree, copies))):
                        total[tree, :, c] += np.bincount(place, weights=part, minlength=len(known))
                if total.nbytes > FLUSH_BYTES:
                    for row in pour(known, total):
                        yield pd.DataFrame([row], columns=["tree", "node", "cell", "sums"])
                    known, total = known[:0], total[:, :0]
        for row in pour(known, total):
            yield pd.DataFrame([row], columns=["tree", "node", "cell", "sums"])

    return blocks.mapInPandas(run, "tree int, node int, cell binary, sums binary")


def _unique(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order: where each is first, and which of them every row is."""
    raw = np.ascontiguousarray(cells)
    keys = raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
    return np.unique(keys, return_index=True, return_inverse=True)[1:]


def _split_tops(fit: _Fit, blocks: DataFrame, rows: int) -> tuple[dict[int, dict], dict[int, np.ndarray]]:
    """The top of every tree whose root holds more rows than a task should: nodes are split until none does."""
    limit = max(2, NODE_BYTES // (fit.width + 8 * fit.sums))
    if rows <= limit:
        return {}, {}
    lists = {t: {"feature": [0], "bin": [0], "left": [0], "level": [0]} for t in range(fit.trees)}
    gains = {t: np.zeros(fit.width) for t in range(fit.trees)}
    frontier = [(t, 0) for t in range(fit.trees)]
    at_once = max(1, FLUSH_BYTES // (fit.width * fit.bins * fit.sums * 8))
    while frontier:
        following = []
        for start in range(0, len(frontier), at_once):
            asked = frontier[start : start + at_once]
            tops = {t: _arrays(lists[t]) for t, _ in asked}
            for found in _best_splits(fit, blocks, asked, tops).collect():  # one row per asked node
                tree = lists[found["tree"]]
                if found["gain"] <= 0:
                    continue
                node, below = found["node"], len(tree["left"])
                tree["feature"][node], tree["bin"][node], tree["left"][node] = found["feature"], found["bin"], below
                gains[found["tree"]][found["feature"]] += found["gain"]
                for side, weight in enumerate((found["low"], found["high"])):
                    for part in ("feature", "bin", "left"):
                        tree[part].append(0)
                    tree["level"].append(tree["level"][node] + 1)
                    if weight > limit and tree["level"][-1] < fit.depth:
                        following.append((found["tree"], below + side))
        frontier = following
    return {t: _arrays(tree) for t, tree in lists.items()}, gains


def _arrays(tree: dict) -> dict:
    return {part: np.asarray(values, dtype=np.int64) for part, values in tree.items()}


def _best_splits(fit: _Fit, blocks: DataFrame, asked: list[tuple[int, int]], tops: dict[int, dict]) -> DataFrame:
    """(tree, node, feature, bin, gain, low, high) of each asked node, from histograms that tasks add up."""
    shape = (fit.width, fit.bins, fit.sums)
    nodes: dict[int, list[tuple[int, int]]] = {}
    for k, (tree, node) in enumerate(asked):
        nodes.setdefault(tree, []).append((k, node))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(asked), *shape))
        for batch in batches:
            for block in batch.itertuples():
                cells, y, copies = fit.read(block)
                for tree, wanted in nodes.items():
                    at, parts = route(tops[tree], cells), fit.parts(y, fit.drawn(block.block, tree, copies))
                    for k, node in wanted:
                        rows = np.flatnonzero(at == node)
                        for f in range(fit.width):
                            for c, part in enumerate(parts):
                                total[k, f, :, c] += np.bincount(cells[rows, f], weights=part[rows], minlength=fit.bins)
        for k in range(len(asked)):
            yield pd.DataFrame({"k": [k], "sums": [total[k].tobytes()]})

    def choose(key, pieces):
        tree, node = asked[key[0]]
        total = sum(np.frombuffer(p).reshape(shape) for p in pieces["sums"])
        low = np.cumsum(total, axis=1)
        whole = low[0, -1]
        high = whole - low
        weights = [(s.sum(-1) if fit.classes else s[..., 0]) for s in (low, high)]
        gain = _score(low, fit.classes) + _score(high, fit.classes) - _score(whole, fit.classes)
        gain[(weights[0] <= 0) | (weights[1] <= 0)] = 0
        allowed = _allowed([fit.seed, tree, node, 1 << 20], 1, fit.width, fit.taken)
        if allowed is not None:
            gain[~allowed[0]] = 0
        f, b = np.argwhere(gain >= (1 - TIE) * gain.max())[0]
        real = gain[f, b] > TIE * max(float(_score(whole, fit.classes)), TIE)
        return pd.DataFrame([(tree, node, int(f), int(b), float(gain[f, b]) if real else 0.0, float(weights[0][f, b]), float(weights[1][f, b]))])

    sums = blocks.mapInPandas(run, "k int, sums binary")
    return sums.groupBy("k").applyInPandas(choose, "tree int, node int, feature int, bin int, gain double, low double, high double")


def _grown_trees(fit: _Fit, blocks: DataFrame, rows: int) -> DataFrame:
    """(tree, feature, bin, left, value, gains): the whole trees as bytes, one row each; stored."""
    tops, gains = _split_tops(fit, blocks, rows)
    layout = "feature binary, bin binary, left binary, value binary, gains binary"
    names = ["feature", "bin", "left"]

    def row(key: tuple, tree: dict, gain: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(
            [(*key, *(_bytes(tree[c], np.int32) for c in names), _bytes(tree["value"], np.float64), _bytes(gain, np.float64))]
        )

    def grow(key, pieces):
        tree, node = key
        cells = np.concatenate([np.frombuffer(c, dtype=fit.kind).reshape(-1, fit.width) for c in pieces["cell"]])
        sums = np.concatenate([np.frombuffer(s).reshape(-1, fit.sums) for s in pieces["sums"]])
        fresh, place = _unique(cells)
        folded = np.column_stack([np.bincount(place, weights=sums[:, k]) for k in range(fit.sums)])
        level = int(tops[tree]["level"][node]) if tree in tops else 0
        out, gain = grown(cells[fresh].astype(np.int64), folded, fit.classes, fit.depth - level, fit.taken, [fit.seed, int(tree), int(node)])
        return row((tree, node), out, gain)

    def assemble(key, pieces):
        top = tops[key[0]]
        tree = {c: [top[c].copy()] for c in names} | {"value": [np.zeros((len(top["left"]), fit.classes or 1))]}
        size, gain = len(top["left"]), gains[key[0]].copy()
        for piece in pieces.sort_values("node").itertuples():
            part = {c: np.frombuffer(getattr(piece, c), dtype=np.int32).astype(np.int64) for c in names}
            part["value"] = np.frombuffer(piece.value).reshape(len(part["left"]), -1)
            # The root of a part takes the place of its leaf; its other nodes follow what is there.
            part["left"][part["left"] > 0] += size - 1
            for c in (*names, "value"):
                tree[c][0][piece.node] = part[c][0]
                tree[c].append(part[c][1:])
            size, gain = size + len(part["left"]) - 1, gain + np.frombuffer(piece.gains)
        return row(key, {c: np.concatenate(parts) for c, parts in tree.items()}, gain)

    parts = _folded(fit, blocks, tops)
    cores = 4 * parts.sparkSession.sparkContext.defaultParallelism
    trees = parts.repartition(cores, "tree", "node").groupBy("tree", "node").applyInPandas(grow, f"tree int, node int, {layout}")
    trees = trees.groupBy("tree").applyInPandas(assemble, f"tree int, {layout}") if tops else trees.drop("node")
    return stored(trees, "forest-trees")


class _Forest(Estimator):
    """100 deep trees by default, each on a bootstrap sample, with binned splits; the rows are read once or, where a root does not fit a task, a few times more."""

    def __init__(
        self, labelCol: str = "label", featuresCol: str = "features", seed: int = 42, numTrees: int = 100,
        maxDepth: int = 16, maxBins: int = 256, featureSubsetStrategy: str = "auto",
    ) -> None:
        super().__init__()
        if not 2 <= maxBins <= 1 << 16:
            raise ValueError("maxBins must lie between 2 and 65536")
        self.label, self.features = labelCol, featuresCol
        self.options = {
            "seed": seed, "numTrees": numTrees, "maxDepth": maxDepth, "maxBins": maxBins, "featureSubsetStrategy": featureSubsetStrategy,
        }

    def getMaxDepth(self) -> int:
        return self.options["maxDepth"]

    def getMaxBins(self) -> int:
        return self.options["maxBins"]

    def _fit(self, dataset: DataFrame) -> ForestModel:
        rows = dataset.select(vector_to_array(self.features).alias("features"), F.col(self.label).cast("double").alias("y"))
        facts = rows.agg(F.max("y").alias("top"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
        classes = int(facts["top"]) + 1 if self.classifies else 0
        thresholds = _thresholds(rows, self.options["maxBins"])
        cells = rows.select(_binned(F.col("features"), thresholds).alias("cell"), "y")
        if classes:
            # A cell's rows of one class differ in nothing.
            cells = cells.groupBy("cell", "y").agg(F.count(F.lit(1)).alias("copies"))
        else:
            cells = cells.withColumn("copies", F.lit(1).cast("bigint"))
        # Rows come from shuffles in any order, and draws go by place.
        blocks = _blocks(cells.sortWithinPartitions("cell", "y"))
        fit = _Fit(self.options, len(thresholds), max(map(len, thresholds)) >= 256, classes, 0.0 if classes else facts["mean"])
        trees = _grown_trees(fit, blocks, _rows_a_tree(fit, blocks))
        return ForestModel(self.features, thresholds, trees, classes, fit.centre, self.options["numTrees"], fit.kind)


def _rows_a_tree(fit: _Fit, blocks: DataFrame) -> int:
    """The folded rows that all tasks may pass on for one tree: their distinct cells, as often as sums are passed on."""
    most = max(1, FLUSH_BYTES // (8 * fit.trees * fit.sums))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = np.zeros((0, fit.width), dtype=fit.kind), 0
        for batch in batches:
            for block in batch.itertuples():
                both = np.concatenate([known, fit.read(block)[0]])
                known = both[_unique(both)[0]]
                if len(known) > most:
                    known, count = known[:0], count + len(known)
        yield pd.DataFrame({"cells": [count + len(known)]})

    return blocks.mapInPandas(run, "cells bigint").agg(F.sum("cells")).first()[0]


class RandomForestClassifier(_Forest):
    classifies = True


class RandomForestRegressor(_Forest):
    classifies = False


class ForestModel(Model):
    """Adds ``prediction`` and, for classes, ``probability``: the mean of the trees' leaves."""

    def __init__(self, features: str, thresholds: list[np.ndarray], trees: DataFrame, classes: int, centre: float, count: int, kind) -> None:
        super().__init__()
        self.features, self.thresholds, self.trees = features, thresholds, trees
        self.classes, self.centre, self.count, self.kind = classes, centre, count, kind

    @property
    def featureImportances(self):
        """The gain by feature, each tree's and the mean's adding up to one."""
        rows = [np.frombuffer(r["gains"]) for r in self.trees.select("gains").collect()]  # one row per tree
        shares = np.sum([g / g.sum() for g in rows if g.sum() > 0] or [np.zeros(len(self.thresholds))], axis=0)
        return Vectors.dense(shares / shares.sum() if shares.sum() else shares)

    def votes(self, cells: DataFrame) -> DataFrame:
        """(_cell, votes): the trees' leaf values of each distinct binned row, added up."""
        width, kind, values = len(self.thresholds), self.kind, self.classes or 1

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = TaskContext.get().partitionId() << 32
            for k, batch in enumerate(b for b in batches if b.num_rows):
                data = [[place + k], [batch.num_rows], [b"".join(batch.column(0).to_pylist())]]
                arrays = [pa.array(a, t) for a, t in zip(data, (pa.int64(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "n", "cells"])

        def told(held: dict) -> pd.DataFrame:
            return pd.DataFrame([(k, cells, sums.tobytes()) for k, (cells, sums) in held.items()], columns=["block", "cells", "sums"])

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, tuple[bytes, np.ndarray]] = {}
            size = 0
            for batch in batches:
                for pair in batch.itertuples():
                    tree = {c: np.frombuffer(getattr(pair, c), dtype=np.int32) for c in ("feature", "bin", "left")}
                    value = np.frombuffer(pair.value).reshape(len(tree["left"]), values)
                    found = value[route(tree, np.frombuffer(pair.cells, dtype=kind).reshape(pair.n, width))]
                    if pair.block in held:
                        found += held[pair.block][1]
                    else:
                        size += found.nbytes + len(pair.cells)
                    held[pair.block] = (pair.cells, found)
                    if size > FLUSH_BYTES:
                        yield told(held)
                        held, size = {}, 0
            if held:
                yield told(held)

        def add(pieces: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p).reshape(-1, values) for p in pieces["sums"])
            cells, step = pieces["cells"].iloc[0], width * kind().itemsize
            return pd.DataFrame({"_cell": [cells[i : i + step] for i in range(0, len(cells), step)], "votes": list(total)})

        packed = stored(cells.mapInArrow(pack, "block bigint, n int, cells binary"), "forest-asked")
        pairs = packed.crossJoin(self.trees.select("feature", "bin", "left", "value"))
        sums = pairs.mapInPandas(meet, "block bigint, cells binary, sums binary")
        return sums.groupBy("block").applyInPandas(add, "_cell binary, votes array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.withColumn("_cell", _binned(vector_to_array(self.features), self.thresholds))
        joined = rows.join(self.votes(rows.select("_cell").distinct()), "_cell").drop("_cell")
        if not self.classes:
            return joined.withColumn("prediction", F.get("votes", F.lit(0)) / self.count + self.centre).drop("votes")
        best = F.array_position("votes", F.array_max("votes")).cast("double") - 1
        share = F.transform("votes", lambda v: v / self.count)
        return joined.withColumns({"probability": array_to_vector(share), "prediction": best}).drop("votes")
