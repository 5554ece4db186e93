"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints of 64 bits that differ in at most 3 bits agree wholly in one of
four 16-bit segments. Each distinct fingerprint is therefore listed four times,
rotated so that another segment leads, and the lists are sorted by (leading
segment, Gray rank): neighbours in Gray order differ in one bit, so runs of the
sorted list share most bits. The sorted list is cut into ranges of bounded size.

In a range each segment's run becomes a tree: leaves of consecutive
fingerprints, upper nodes over them. A node holds the bits on which all below it
agree (mask and pattern); what its parent already holds is factored out. A
query goes down the tree and adds up its differences on each node's own bits;
a node is left out with all below it once the sum exceeds the bound, or once all
below it are known to be linked with the query. Only links that join two groups
are kept, so a cluster of n fingerprints costs n - 1 links, not n * n.

A segment's run that crosses ranges (a hot segment crosses many) is handed on
piece by piece, and pairs of pieces are searched in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written
from tabwright.llm.components import Forest, components

BITS = 3
SHINGLE = 3
SEED = 42
#: Rows of one sorted range, and of one piece of a hot segment.
RANGE_ROWS = 1 << 17
LEAF = 16
FANOUT = 8
#: Pairs of queries and nodes that are held at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a whole text; 0 without words.

    A-Z are lower-cased, words are runs between ASCII white space (which is what
    ``bytes.split`` splits at), shingles are space-joined words, repeats
    included; fewer words make one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for low in range(0, len(every), 1 << 16):
        part = every[low : low + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(every), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], dtype=np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps})

    kind = dict(docs.dtypes)[doc_id]
    base = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return base.mapInPandas(run, f"doc_id {kind}, fp long")


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit pattern in Gray order, as an order-preserving signed long."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    # Unsigned order as signed order.
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


class GrayTree:
    """The index of one run of fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n = len(codes)
        starts = np.arange(0, n, LEAF)
        both = np.bitwise_and.reduceat(codes, starts)
        any_ = np.bitwise_or.reduceat(codes, starts)
        levels = []
        while True:
            levels.append((starts, np.append(starts[1:], n), ~(both ^ any_), both))
            if len(starts) == 1:
                break
            cut = np.arange(0, len(starts), FANOUT)
            starts, both, any_ = starts[cut], np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
        self.levels = levels[::-1]
        # A node's own bits: those that all below it share and its parent does not hold already.
        self.own = [self.levels[0][2]]
        for above, below in zip(self.levels, self.levels[1:]):
            parent = np.repeat(above[2], FANOUT)[: len(below[2])]
            self.own.append(below[2] & ~parent)

    def near(self, queries: np.ndarray, after: np.ndarray, group: np.ndarray | None, asks: np.ndarray | None,
             bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) places that differ in at most ``bits``, members at ``after`` or beyond.

        ``group`` (per member) and ``asks`` (per query) are group numbers: members
        of the query's own group are left out, whole nodes at a time.
        """
        who = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        spent = np.zeros(len(queries), dtype=np.int64)
        for depth, (starts, ends, _, pattern) in enumerate(self.levels):
            if depth:
                who, spent = np.repeat(who, FANOUT), np.repeat(spent, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < len(starts)
                who, spent, node = who[there], spent[there], node[there]
            spent = spent + np.bitwise_count((queries[who] ^ pattern[node]) & self.own[depth][node])
            keep = (spent <= bits) & (ends[node] > after[who])
            if group is not None:
                least, most = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
                keep &= (least[node] != most[node]) | (least[node] != asks[who])
            who, spent, node = who[keep], spent[keep], node[keep]
        starts = self.levels[-1][0]
        member = (starts[node][:, None] + np.arange(LEAF)).ravel()
        who = np.repeat(who, LEAF)
        there = member < len(self.codes)
        who, member = who[there], member[there]
        keep = (member >= after[who]) & (np.bitwise_count(queries[who] ^ self.codes[member]) <= bits)
        return who[keep], member[keep]


def _unite(forest: Forest, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Join pairs of members; the pairs that joined two trees."""
    if not len(a):
        return []
    roots = forest.roots()
    _, first = np.unique(np.stack([roots[a], roots[b]], axis=1), axis=0, return_index=True)
    return [(x, y) for x, y in zip(a[first].tolist(), b[first].tolist()) if forest.join(x, y)]


def _step(tree: GrayTree) -> int:
    """Queries at once, so that a level's frontier stays bounded."""
    return max(64, FRONTIER // (LEAF * max(1, min(len(tree.levels[-1][0]), 1024))))


def links_within(codes: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join all members of one run (in Gray order) that pairs within ``bits`` connect."""
    forest, links, tree = Forest(len(codes)), [], GrayTree(codes)
    beside = np.flatnonzero(np.bitwise_count(codes[:-1] ^ codes[1:]) <= bits)
    links += _unite(forest, beside, beside + 1)
    step = _step(tree)
    for low in range(0, len(codes), step):
        asked = np.arange(low, min(len(codes), low + step))
        groups = forest.roots().copy()
        who, member = tree.near(codes[asked], asked + 1, groups, groups[asked], bits)
        links += _unite(forest, asked[who], member)
    return links


def links_between(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of members of two runs, as places in left and right; none that earlier ones already give."""
    both = len(left)
    forest, links, tree = Forest(both + len(right)), [], GrayTree(right)
    step = _step(tree)
    for low in range(0, both, step):
        asked = np.arange(low, min(both, low + step))
        groups = forest.roots().copy()
        who, member = tree.near(left[asked], np.zeros(len(asked), dtype=np.int64), groups[both:], groups[asked], bits)
        links += [(a, b - both) for a, b in _unite(forest, asked[who], member + both)]
    return links


def _small_links(codes: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within ``bits`` in runs of at most LEAF members: one leaf each, all runs at once."""
    found = []
    at = np.arange(len(codes))
    for gap in range(1, LEAF):
        at = at[at + gap < len(codes)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            break
        near = at[np.bitwise_count(codes[at] ^ codes[at + gap]) <= bits]
        found.append((near, near + gap))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _range_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside one sorted range; its first and last runs are handed on as pieces."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    rows = pd.concat(rows, ignore_index=True)
    fps, key = rows["fp"].to_numpy(), rows["key"].to_numpy()
    codes = fps.view(np.uint64)
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(cuts[1:], len(key))
    small = np.repeat(ends - cuts <= LEAF, ends - cuts)
    places = np.flatnonzero(small)
    a, b = _small_links(codes[places], key[places], BITS)
    pairs = [(places[a], places[b])]
    for low, high in zip(cuts.tolist(), ends.tolist()):
        if high - low > LEAF:
            links = np.array(links_within(codes[low:high]), dtype=np.int64).reshape(-1, 2) + low
            pairs.append((links[:, 0], links[:, 1]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    yield pd.DataFrame({"key": -1, "piece": -1, "a": fps[a], "b": fps[b]})
    outer = np.flatnonzero((key == key[0]) | (key == key[-1]))
    piece = TaskContext.get().partitionId()
    yield pd.DataFrame({"key": key[outer], "piece": piece, "a": fps[outer], "b": 0})


def _piece_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the two pieces of a run."""
    group = group.sort_values(["piece", "rank"], kind="stable")
    first = group["piece"] == group["piece"].min()
    left, right = group.loc[first, "a"].to_numpy(), group.loc[~first, "a"].to_numpy()
    links = np.array(links_between(left.view(np.uint64), right.view(np.uint64)), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": left[links[:, 0]], "b": right[links[:, 1]]})


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within 3 bits."""
    count = fps.count()
    turns = [
        fps.select("fp", rotated(F.col("fp"), 16 * turn).alias("turned"), F.lit(turn).alias("turn")) for turn in range(4)
    ]
    listed = turns[0].unionByName(turns[1]).unionByName(turns[2]).unionByName(turns[3])
    listed = listed.select(
        "fp",
        (F.col("turn") * 65536 + F.shiftrightunsigned("turned", 48)).cast("long").alias("key"),
        gray_rank(F.col("turned")).alias("rank"),
    )
    least = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-4 * count // RANGE_ROWS))
    in_order = listed.repartitionByRange(ranges, "key", "rank").sortWithinPartitions("key", "rank")
    found = written(in_order.select("fp", "key").mapInPandas(_range_links, "key long, piece int, a long, b long"), "ranges")
    pieces = found.where(F.col("piece") >= 0).select("key", "piece", "a")
    crossing = (
        pieces.groupBy("key").agg(F.sort_array(F.collect_set("piece")).alias("pieces")).where(F.size("pieces") > 1)
    )
    turn = F.floor(F.col("key") / 65536)
    turned = F.when(turn == 0, F.col("a"))
    for t in (1, 2, 3):
        turned = turned.when(turn == t, rotated(F.col("a"), 16 * t))
    met = (
        pieces.join(crossing, "key")
        .withColumn("rank", gray_rank(turned))
        .withColumn("other", F.explode(F.filter("pieces", lambda p: p != F.col("piece"))))
        .groupBy("key", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"))
        .applyInPandas(lambda group: _piece_links(group), "a long, b long")
    )
    return found.where(F.col("piece") < 0).select("a", "b").unionByName(met)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    ``component_id`` is the smallest doc_id that links of fingerprints within 3
    bits reach, the row's own included. Texts that are null, empty or blank have
    fingerprint zero and are linked like any other. A null doc_id is passed
    over in the minimum; a component of null ids alone has a null component_id.
    Rows may repeat; an empty table gives an empty result. Other columns are
    neither read nor returned.
    """
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(near_links(firsts.select("fp")))
    rooted = firsts.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy(F.col("root").alias("top")).agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("top")).select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates, all columns as they are.

    The row with the smallest doc_id stays (of rows that repeat it, any one; a
    null doc_id comes last). Columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = written(
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), row.alias("row"))
        .withColumn("place", F.monotonically_increasing_id()), "rows",
    )
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "place")
    marked = fingerprints(rows.select("place", "text"), "place").withColumnRenamed("doc_id", "place")
    marked = written(marked, "fingerprints")
    groups = components(near_links(marked.select("fp").distinct()))
    firsts = (
        marked.join(groups, F.col("fp") == F.col("node"), "left")
        .select("place", F.coalesce("root", "fp").alias("root"))
        .join(rows.select("place", order.alias("order")), "place")
        .groupBy("root")
        .agg(F.min("order").alias("first"))
        .select(F.col("first.place").alias("stays"))
    )
    return rows.join(firsts, F.col("place") == F.col("stays"), "left_semi").select("row.*")
