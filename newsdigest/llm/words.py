"""Word splitting and word-sequence hashing on whole batches of texts with numpy.

Words are maximal runs of bytes other than U+0020 and U+0009-U+000D in the UTF-8 text, unchanged.  A null text
has no words.  Hashes depend on the words only, so they are equal in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

BYTE_BASE = 0x9E3779B97F4A7C15
SEQ_BASES = (0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base & _MASK, dtype=np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: spreads polynomial sums over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, independent of where the span stands."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts]


@dataclass
class Words:
    """The words of a batch: byte spans in ``data``, a 64-bit hash each, and the first word of every document."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray          # len = documents + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of ``size`` words inside one document, and each window's document."""
        doc = self.doc_of()
        at = np.arange(len(doc))
        ok = at + size <= self.first[1:][doc]
        return at[ok], doc[ok]

    def sequence_hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the word sequences [start, end); ``which`` selects one of two independent hashes."""
        return mix(span_sums(self.hashes, starts, ends, SEQ_BASES[which]) ^ np.uint64(0xA5A5 + which))


def split_words(texts: list[str | None]) -> Words:
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts) + b"\n"
    buf = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(np.concatenate(([not space[0]], space[1:] != space[:-1])))
    starts, ends = edges[0::2], edges[1::2]
    begin = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    first = np.searchsorted(starts, begin)
    values = buf.astype(np.uint64) + np.uint64(1)
    hashes = mix(span_sums(values, starts, ends, BYTE_BASE)) if len(starts) else np.zeros(0, np.uint64)
    return Words(data, starts, ends, hashes, first)


def text_chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` characters (a longer text stands alone): bounds a task's memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each ``values[i:i + width]``."""
    n = len(values) - width + 1
    best = np.arange(n)
    low = values[:n].copy()
    for step in range(1, width):
        other = values[step:step + n]
        less = other < low
        low[less] = other[less]
        best[less] = (np.arange(step, step + n))[less]
    return best
