"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are encoded whole, given an end id and cut into pieces of at most one
sequence; full pieces are sequences of their own. The others are dealt by a hash
into shards of bounded size. Of each shard several islands evolve packings: an
individual is a list of bins; crossover injects whole well-filled bins of one
parent into the other, drops the bins that would hold a piece twice, and
best-fits the displaced pieces, longest first. After each epoch every island's
elite moves on to the next island of its shard; the best packing of a shard's
islands is taken. Pieces in bins that stay poorly filled are dealt again into
fewer shards of the same bound, until one shard holds all that is left or a
level settles too little, which leaves its bins as they are.

Islands are rows of a DataFrame, so epochs are ordinary Spark jobs over
(shard, island) rows whose size does not depend on the corpus.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tabwright.llm.bpe import byte_letters
from tabwright.llm.common import worker_cache, written

CAPACITY = 1024
END = 2
SHARD_PIECES = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Bins filled to this share are settled; pieces of others are dealt again.
SETTLED = 0.97
#: Least share of a level's pieces that settles, for the others to be dealt again.
WORTH = 0.05
CACHED_WORDS = 300_000
CACHED_LENGTH = 64
# Fixed value: how byte-level tokenizers of this family part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters before this one are classed alike by every version of Unicode.
LATIN_END = "\u0220"
#: White space but for the space and the line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Words(dict):
    """Ids (as bytes) of words with the space before them, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(" " + word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


class CachedEncoder:
    """Ids of whole texts as the tokenizers library gives them, worked out once per word.

    A byte-level tokenizer never joins what stands before and after a single
    space between words (the space goes with the word that follows), so a text
    is parted there and the ids of the parts are joined. Words of Latin letters
    go through the same vocabulary as ranks, where its merges stand in the order
    of their ids, which makes both forms equal and is several times faster; all
    else, and texts that name a special token, go through the library itself.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._as_ranks(json.loads(spec))
        self.name = f"ids_{zlib.crc32(spec.encode())}"
        self.cache = worker_cache(self.name, CACHED_WORDS)
        if not hasattr(self.cache.young, "encode"):
            self.cache.young = Words(self._word, {})

    @staticmethod
    def _as_ranks(spec: dict) -> tiktoken.Encoding | None:
        vocab = spec["model"]["vocab"]
        made = [vocab[a + b] for a, b in spec["model"]["merges"]]
        if made != sorted(made) or spec["pre_tokenizer"].get("use_regex") is not True or spec["normalizer"]:
            return None
        back = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        ranks = {b"".join(map(back.__getitem__, token)): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        if self.ranks is None or not (text.isascii() or max(text) < LATIN_END):
            return self._library(text)
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers in the machine's (little-endian) order."""
        if any(s in text for s in self.special):
            return self._library(text)
        if len(self.cache.young) >= CACHED_WORDS:
            self.cache.young = Words(self._word, dict(self.cache.young))
        odd = OTHER_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text
        if odd or text[:1] == " " or text[-1:] == " ":
            head, *words = BETWEEN_WORDS.split(text)
        else:
            head, *words = text.split(" ")
        return self._word(head) + b"".join(map(self.cache.young.__getitem__, words))


def pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut so that only the first piece is short."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        encoder, last = CachedEncoder(shared.value), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for own, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text or "") + last
                count = len(ids) // 4
                cuts = [0, *range(count % capacity or capacity, count + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((own, n, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    base = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return base.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one packing, found by free space: the tightest that fits is one bit operation away."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int]) -> None:
        """A bin as it is."""
        left = self.capacity - sum(self.lengths[i] for i in items)
        self.by_free[left].append(len(self.bins))
        self.mask |= 1 << left
        self.bins.append(items)
        self.free.append(left)

    def best_fit(self, item: int) -> None:
        size = self.lengths[item]
        fits = self.mask >> size
        if not fits:
            self.add([item])
            return
        left = size + (fits & -fits).bit_length() - 1
        place = self.by_free[left].pop()
        if not self.by_free[left]:
            self.mask ^= 1 << left
        self.bins[place].append(item)
        self.free[place] = left = left - size
        self.by_free[left].append(place)
        self.mask |= 1 << left


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def best_fit(order: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    packed = Bins(lengths, capacity)
    for item in order:
        packed.best_fit(item)
    return packed.bins


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``other`` into ``one``; pieces then held twice or displaced are best-fitted."""
    filled = sorted(other, key=lambda b: sum(lengths[i] for i in b), reverse=True)
    injected = [b for b in filled[: len(filled) // 2] if rng.random() < 0.5]
    inside = {i for b in injected for i in b}
    child, displaced = Bins(lengths, capacity), []
    for b in injected:
        child.add(list(b))
    # The emptiest bins of the parent are opened too, so that what they hold can move.
    kept = [b for b in one if inside.isdisjoint(b)]
    opened = set(sorted(range(len(kept)), key=lambda n: sum(lengths[i] for i in kept[n]))[: 2 + len(kept) // 50])
    for n, b in enumerate(kept):
        if n in opened:
            displaced += b
        else:
            child.add(list(b))
    displaced += [i for b in one if not inside.isdisjoint(b) for i in b if i not in inside]
    for item in sorted(displaced, key=lambda i: (-lengths[i], i)):
        child.best_fit(item)
    return child.bins


def evolve(lengths: list[int], elites: list[list[list[int]]], capacity: int, seed: str,
           generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing of one island after an epoch; stops where no packing can have fewer bins."""
    rng, n = random.Random(seed), len(lengths)
    least = -(-sum(lengths) // capacity)
    members = [list(map(list, e)) for e in elites if e]
    if not members:
        members.append(best_fit(sorted(range(n), key=lambda i: (-lengths[i], i)), lengths, capacity))
    if min(map(len, members)) > least:
        while len(members) < population:
            noise = [length * (1 + rng.uniform(-0.15, 0.15)) for length in lengths]
            members.append(best_fit(sorted(range(n), key=lambda i: -noise[i]), lengths, capacity))
    scored = sorted(((fitness(m, lengths, capacity), k, m) for k, m in enumerate(members)), reverse=True)
    for generation in range(generations):
        if -scored[0][0][0] <= least:
            break
        first, second = rng.sample(range(len(scored)), 2)
        first, second = min(first, second), max(first, second)
        for a, b in ((first, second), (second, first)):
            child = crossover(scored[a][2], scored[b][2], lengths, capacity, rng)
            scored.append((fitness(child, lengths, capacity), population + 2 * generation + (a > b), child))
        scored = sorted(scored, reverse=True)[:population]
    return scored[0][2]


def as_numbers(bins: list[list[int]], n: int) -> list[int]:
    """A packing as one list: the bin of every piece."""
    numbers = [0] * n
    for number, held in enumerate(bins):
        for item in held:
            numbers[item] = number
    return numbers


def as_bins(numbers: Iterable[int]) -> list[list[int]]:
    """The other way round."""
    bins: dict[int, list[int]] = {}
    for item, number in enumerate(numbers):
        bins.setdefault(int(number), []).append(item)
    return list(bins.values())


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Every island's best packing after one more epoch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                elites = [as_bins(e) for e in row.elites]
                best = evolve(lengths, elites, capacity, f"{row.shard}/{row.island}/{epoch}")
                count, fill = fitness(best, lengths, capacity)
                yield pd.DataFrame(
                    {"shard": [row.shard], "island": [row.island], "lengths": [lengths],
                     "best": [as_numbers(best, len(lengths))],
                     "bins": [-count], "fill": [fill]}
                )

    return islands.mapInPandas(
        run, "shard long, island int, lengths array<int>, best array<int>, bins long, fill double"
    )


def _pack_shards(items: DataFrame, shards: int, capacity: int, level: int, first: int) -> DataFrame:
    """(uid, length, sequence_id, offset, filled) with every shard packed by its islands; ``first`` shards have ids already."""
    dealt = items.select(
        "uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard")
    )
    order = Window.partitionBy("shard").orderBy(F.desc("length"), "uid")
    numbered = dealt.withColumn("item", F.row_number().over(order) - 1)
    lists = numbered.groupBy("shard").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item", "length"))), lambda x: x["length"].cast("int")).alias("lengths")
    )
    empty = F.array().cast("array<array<int>>")
    islands = lists.withColumn("island", F.explode(F.array([F.lit(i) for i in range(ISLANDS)]))).withColumn("elites", empty)
    # An island is a task's worth of work: rows are few and heavy, so each shuffle partition gets a few.
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(EPOCHS):
        spread = islands.repartition(max(tasks, shards // 8), "shard", "island")
        bests = written(_epoch(spread, capacity, epoch), "islands")
        moves = F.array(
            F.struct(F.col("island").alias("to"), "best"),
            F.struct(((F.col("island") + 1) % ISLANDS).cast("int").alias("to"), "best"),
        )
        moved = bests.select("shard", F.explode(moves).alias("m")).select("shard", "m.to", "m.best")
        gathered = moved.groupBy("shard", F.col("to").alias("island")).agg(F.collect_list("best").alias("elites"))
        islands = bests.select("shard", "island", "lengths").join(gathered, ["shard", "island"])
    score = F.struct((-F.col("bins")).alias("few"), "fill", (-F.col("island")).alias("first"))
    taken = bests.groupBy("shard").agg(F.max_by(F.struct("lengths", "best"), score).alias("t")).select("shard", "t.*")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = []
                for number, held in enumerate(as_bins(row.best)):
                    offset, filled = 0, sum(int(row.lengths[i]) for i in held)
                    for item in sorted(held):
                        rows.append((row.shard, int(item), number, offset, filled))
                        offset += int(row.lengths[item])
                yield pd.DataFrame(rows, columns=["shard", "item", "bin", "offset", "filled"])

    placed = taken.mapInPandas(places, "shard long, item int, bin long, offset long, filled long")
    joined = numbered.join(placed, ["shard", "item"])
    sequence = F.shiftleft(F.col("shard") + F.lit(first).cast("long"), 20) + F.col("bin")
    return joined.select("uid", "length", sequence.alias("sequence_id"), "offset", "filled")


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, sequence_id, offset) for stored rows (uid, length); uids are distinct longs, lengths 1 to ``capacity``."""
    whole = rows.where(F.col("length") == capacity)
    parts = [whole.select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level, first = rows.where(F.col("length") < capacity).select("uid", "length"), 1, 0
    count = left.count()
    while count:
        # Dealt by a hash, shards hold at most that many on the mean, at every level.
        shards = -(-count // shard_pieces)
        packed = written(_pack_shards(left, shards, capacity, level, first), "packed")
        poor = F.col("filled") < F.lit(SETTLED * capacity)
        again = 0 if shards == 1 else packed.where(poor).count()
        # Each level has at most 1 - WORTH of the last one's pieces, so levels end and ids stay below 2 ** 63.
        last = count - again < WORTH * count or shards == 1
        parts.append((packed if last else packed.where(~poor)).select("uid", "sequence_id", "offset"))
        if last:
            break
        left, level, first, count = packed.where(poor).select("uid", "length"), level + 1, first + shards, again
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``spec`` is the content of a byte-level tokenizer's JSON file. Null and
    empty texts give one piece that holds the end id alone. Rows may repeat
    (each is packed on its own) and doc_id may be null; an empty table gives an
    empty result; other columns are not read.
    """
    cut = pieces(docs, spec, capacity, end, doc_id, text)
    stored = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(stored.select("uid", "length"), capacity)
    return stored.join(placed, "uid").drop("uid")
