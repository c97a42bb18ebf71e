"""Vectorised word scanning: one numpy pass gives every word of many texts, hashed.

Words are maximal runs of bytes outside a set of separators.  For UTF-8 text and
ASCII separators that is the same as splitting the code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: Words that are hashed at once.
AT_ONCE = 1 << 15

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of uint64 that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _FACTOR)
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, dtype=_U))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _POWERS[0], dtype=_U))


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


SPACE_TABLE = separators(SPACES)


@dataclass
class Words:
    """Words of a list of texts, in order; ``doc`` is each word's index in that list."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text: index of its first word; one more at the end

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int, factor: int = 0x2545F4914F6CDD1D) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where ``whole(k)`` is false."""
        n = max(0, len(self) - k + 1)
        out = np.zeros(n, dtype=_U)
        for j in range(k):
            out *= _U(factor)
            out += self.hash[j : j + n]
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        n = max(0, len(self) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def scan(texts: list[bytes], table: np.ndarray = SPACE_TABLE) -> Words:
    """Find and hash the words of all texts at once."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = table[data]
    gap_before = np.empty_like(gap)
    gap_before[0] = True
    gap_before[1:] = gap[:-1]
    start = np.flatnonzero(gap_before & ~gap)
    end = np.flatnonzero(gap & ~gap_before)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    return Words(data, start, end, doc, _hashes(data, gap, start, end), first)


def _hashes(data: np.ndarray, gap: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word; a part of the words at a time, since the steps take 30 bytes a character."""
    out = np.empty(len(start), dtype=_U)
    for i in range(0, len(start), AT_ONCE):
        lengths = end[i : i + AT_ONCE] - start[i : i + AT_ONCE]
        a, b = int(start[i]), int(end[min(i + AT_ONCE, len(end)) - 1])
        own = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(own, lengths)
        parts = _TABLE[data[a:b][~gap[a:b]]] * _powers(int(lengths.max()))[place]
        out[i : i + AT_ONCE] = mix(np.add.reduceat(parts, own))
    return out


def hash_word(word: bytes) -> int:
    return int(scan([word]).hash[0])


def chunks(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encoded(column, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty; A-Z lower-cased on demand."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = pc.fill_null(pc.cast(column, pa.large_binary()), b"").to_pylist()
    return [v.lower() for v in values] if lower else values
