"""What the operators share: tables in the shared folder and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settled as store

__all__ = ["WORD", "Powers", "hash_words", "mix", "only", "pieces", "rolling", "span_hash", "store", "text_buffers"]

#: What separates words: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes each (at least one document)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, base, _U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=_U))
        return self.up[:n], self.down[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_byte_powers, _word_powers = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)


def _hash_chunk(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data; no word goes across a break (offsets)."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    edge[0] = edge[n] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = _byte_powers.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F)), starts


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the documents in order, and per document the offset of its
    first (n + 1 offsets). The bytes are taken in chunks that end between words, so that one very
    long text needs little memory beside its 8 bytes a word."""
    table = _LOWER if lower else _BYTES
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        to = min(n, at + chunk)
        while to < n and not _SPACE[data[to]]:
            stop = min(n, to + 4096)
            gap = np.flatnonzero(_SPACE[data[to:stop]])
            to = to + int(gap[0]) if len(gap) else stop
        lo, hi = np.searchsorted(offsets, (at, to))
        h, s = _hash_chunk(data[at:to], offsets[lo:hi] - at, table)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def rolling(words: np.ndarray, k: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hashes of each k consecutive words (across documents too: the caller picks)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _U(base)
        out += words[i : i + n]
    return mix(out)


def span_hash(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges [lo, hi)."""
    up, down = _word_powers.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(_U) * _U(0x8CB92BA72F3D8DD7))
