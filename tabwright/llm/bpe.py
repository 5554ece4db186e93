"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as a list of part ids and, beside it, the list of the ranks at
which adjacent parts would merge. The smallest rank is found by scanning, its
boundary is deleted and the two neighbouring ranks are looked up again. For the
short words of ordinary text these scans over a few contiguous numbers cost less
than a heap; words beyond ``SCAN_PARTS`` parts use a heap of (rank, place), which
gives the same merges without the quadratic scan.

The vocabulary is the JSON file of a public word-end BPE tokenizer. It is read
by the driver and broadcast (a few MB, fixed by the vocabulary). Texts are
encoded whole, batch by batch, in Arrow batches that Spark hands out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tabwright.llm.common import worker_cache

SCAN_PARTS = 96
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
NEVER = 1 << 60
# White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary; made once per task."""

    def __init__(self, spec: str):
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.merges: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault((self.vocab[left], self.vocab[right]), rank)
            self.merged.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = tokenizer["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.spec = spec
        self.library: Tokenizer | None = None
        self.cache = worker_cache(f"spelt_{zlib.crc32(spec.encode())}", CACHED_WORDS)

    def merge(self, parts: list[int]) -> list[int]:
        """Merge adjacent parts, lowest rank and leftmost first, until none can be."""
        if len(parts) > SCAN_PARTS:
            return self._merge_long(parts)
        find = self.merges.get
        ranks = [find(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [self.merged[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = find((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = find((parts[at], parts[at + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        find, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := find((parts[i], parts[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := find((parts[a], parts[b]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one run that holds no white space.

        Characters that this Python's Unicode tables do not know may be letters,
        with a case and a decomposition, in those of the library; a word with
        one is encoded by the library itself.
        """
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return self._newer(word)
        ids: list[int] = []
        text = unicodedata.normalize("NFC", word)
        # Letter by letter where the final form of sigma would depend on the context.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        for piece in self.pieces.findall(text):
            parts = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
            parts[-1] += self.end
            ids += self.merge([self.vocab[p] for p in parts])
        return ids

    def _newer(self, word: str) -> list[int]:
        if self.library is None:
            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(word, add_special_tokens=False).ids

    def _entry(self, word: str) -> tuple[int, str, str]:
        known = self.cache.recall(word)
        if known is not None:
            return known
        ids = self.encode_word(word)
        entry = (len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids))
        if len(word) <= CACHED_LENGTH:
            self.cache.young[word] = entry
        return entry

    def _words(self, text: str) -> Iterator[tuple[int, str, str]]:
        self.cache.turn()
        found = self.cache.young.get
        runs = self.at_special.split(text) if self.at_special and "<|" in text else [text]
        for run in runs:
            if run in self.special:
                yield 1, str(self.special[run]), run
                continue
            words = run.split() if not regex.search("[\x1c-\x1f]", run) else self.spaces.split(run)
            for word in words:
                entry = found(word) or self._entry(word) if word else (0, "", "")
                if entry[0]:
                    yield entry

    def spell(self, text: str) -> tuple[int, str, str]:
        """Of a whole text: the number of ids, the ids and the tokens, both joined by spaces."""
        entries = list(self._words(text))
        if not entries:
            return 0, "", ""
        counts, ids, tokens = zip(*entries)
        return sum(counts), " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        ids = self.spell(text)[1]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The ids' tokens as the library joins them where a vocabulary names no decoder: by spaces."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def decode_text(self, ids: list[int]) -> str:
        """The normalised text of the ids: bytes restored, a space at each word end."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = bytearray()
        for i in ids:
            token = self.tokens.get(i, "")
            if token in self.special:
                out += token.encode()
                continue
            ends = bool(self.end) and token.endswith(self.end)
            out += bytes(back[c] for c in (token[: -len(self.end)] if ends else token)) + b" " * ends
        return out.decode("utf-8", "replace").removesuffix(" ")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) with the whole text of every row encoded; ids is an array of int.

    ``spec`` is the content of the tokenizer's JSON file. Null and empty texts
    give an empty array; rows and ids may repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t or "") for t in batch["text"]]})

    kind = dict(docs.dtypes)[doc_id]
    base = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return base.mapInPandas(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    The digests cover the ids as decimals joined by one space and the text that
    the library's decode gives for them. Null counts as empty (no ids).
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(shared.value)
        for batch in batches:
            rows = []
            for whole in batch["text"]:
                count, ids, tokens = bpe.spell(whole or "")
                rows.append((count, _sha(ids), _sha(tokens)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[doc_id]
    base = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return base.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
