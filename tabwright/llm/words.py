"""Words of whole texts as numbers, in bounded memory."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of a text that are parted into words at once.
PIECE = 1 << 20


def byte_map(is_word: Callable[[int], bool], lower: bool = False) -> bytes:
    """A translation table: bytes outside words become spaces; with ``lower``, A-Z become a-z. Lengths stay."""
    out = bytearray()
    for b in range(256):
        small = b + 32 if lower and 65 <= b <= 90 else b
        out.append(small if is_word(small) else 32)
    return bytes(out)


#: Words are runs of what is no ASCII white space.
BETWEEN_WHITE = byte_map(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are runs of digits, letters a-z (A-Z lower-cased) and all that is not ASCII.
ALPHANUMERIC = byte_map(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b > 127, lower=True)


def raw_of(text: str | None) -> bytes:
    """A text's UTF-8; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def word_lists(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    spaced = raw.translate(table)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + PIECE) if len(spaced) - at > PIECE else -1
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


class Numbering:
    """Numbers from 0 for distinct words, in the order in which they come."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def encode(self, raw: bytes, table: bytes) -> np.ndarray:
        """The numbers of a text's words; new words are numbered."""
        parts = [np.fromiter(map(self.numbers.__getitem__, w), dtype=np.int32, count=len(w)) for w in word_lists(raw, table)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def words(self) -> list[bytes]:
        """The word of every number."""
        return list(self.numbers)
