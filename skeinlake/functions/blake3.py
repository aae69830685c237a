"""BLAKE3 of many byte strings at once: the compression function over arrays of states in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: initial words, order of the message words of the next round, flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, ROUNDS = 64, 1024, 7
#: Chunks that are compressed together.
TOGETHER = 1 << 14


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _mix(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word
        v[d] = _turn(v[d] ^ v[a], first)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], second)


def _compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8 x n) of n states at once; words: 16 x n."""
    n = value.shape[1]
    v = [*value, *(np.full(n, x, np.uint32) for x in IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for i in range(ROUNDS):
        for j, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            _mix(v, a, b, c, d, m[2 * j], m[2 * j + 1])
        if i < ROUNDS - 1:
            m = [m[k] for k in PERMUTATION]
    return np.array([v[i] ^ v[i + 8] for i in range(8)])


def _chunks(data: np.ndarray, size: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8 x n) of n chunks (n x 1024, zeros behind `size`), block by block."""
    value = np.repeat(IV[:, None], len(data), 1)
    words = np.ascontiguousarray(data).view("<u4").astype(np.uint32).reshape(len(data), -1, 16)
    blocks = np.maximum(1, -(-size // BLOCK))
    for i in range(int(blocks.max())):
        at = np.flatnonzero(blocks > i)
        last = blocks[at] == i + 1
        flags = np.where(last, CHUNK_END | np.where(alone[at], ROOT, 0), 0) | (CHUNK_START if i == 0 else 0)
        length = np.where(last, size[at] - i * BLOCK, BLOCK)
        value[:, at] = _compress(value[:, at], words[at, i].T, counter[at], length, flags)
    return value


def blake3(values: list[bytes | None]) -> list[bytes | None]:
    """The 32-byte hashes; null stays null. Chunks of all values are compressed together, then the
    pairs of each level of all trees; an odd node moves up as it is."""
    known = [v for v in values if v is not None]
    size = np.array([len(v) for v in known], np.int64)
    count = np.maximum(1, -(-size // CHUNK))
    row, place = np.repeat(np.arange(len(known)), count), np.concatenate([np.arange(c) for c in count]) if len(known) else np.zeros(0, np.int64)
    nodes = np.zeros((8, len(row)), np.uint32)
    for lo in range(0, len(row), TOGETHER):
        some = range(lo, min(len(row), lo + TOGETHER))
        data = np.zeros((len(some), CHUNK), np.uint8)
        for i, k in enumerate(some):
            part = known[row[k]][place[k] * CHUNK : (place[k] + 1) * CHUNK]
            data[i, : len(part)] = np.frombuffer(part, np.uint8)
        at = slice(lo, some.stop)
        nodes[:, at] = _chunks(data, np.clip(size[row[at]] - place[at] * CHUNK, 0, CHUNK), place[at], count[row[at]] == 1)
    while (count > 1).any():
        starts = np.cumsum(count) - count
        index = np.arange(len(row)) - starts[row]
        left = np.flatnonzero((index % 2 == 0) & (index + 1 < count[row]))
        root = count[row[left]] == 2
        n = len(left)
        made = _compress(
            np.repeat(IV[:, None], n, 1), np.concatenate([nodes[:, left], nodes[:, left + 1]]), np.zeros(n, np.int64), np.full(n, BLOCK), np.where(root, PARENT | ROOT, PARENT)
        )
        nodes[:, left] = made
        stays = index % 2 == 0
        nodes, row, count = nodes[:, stays], row[stays], -(-count // 2)
    found = iter(nodes.T.astype("<u4").tobytes()[i : i + 32] for i in range(0, 32 * len(known), 32))
    return [None if v is None else next(found) for v in values]


@F.pandas_udf(StringType())
def _hashed(content: pd.Series) -> pd.Series:
    values = [v if v is None or isinstance(v, bytes) else bytes(v) for v in content]
    return pd.Series([None if h is None else "blake3:" + h.hex() for h in blake3(values)])


def blake3_hash(content: Column) -> Column:
    """`blake3:` and the hash of a binary or string column in hexadecimal digits; null stays null."""
    return _hashed(content.cast("binary"))
