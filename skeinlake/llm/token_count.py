"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Words up to this long are remembered, so many at most (a bound on memory alone).
CACHED_CHARS, CACHED_WORDS = 32, 700_000
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MEET = re.compile(r"\s\s").search


class Merges(dict):
    """word -> number of tokens; the words met first are remembered."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # symbols are numbers here: bytes as they are, then one for each merge by rank
        number = {c: b for b, c in enumerate(alphabet)}
        self.ranks = {}
        for i, (a, b) in enumerate(pairs):
            self.ranks[number[a] << 20 | number[b]] = i
            number.setdefault(a + b, 256 + i)
        self.made = [number[a + b] for a, b in pairs]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.pieces = Pieces(self)

    def __missing__(self, word: str) -> int:
        n = self.merge(word.encode("utf-8", "surrogatepass"))
        if len(word) <= CACHED_CHARS and len(self) < CACHED_WORDS:
            self[word] = n
        return n

    def merge(self, word: bytes) -> int:
        """Symbols left when the lowest-ranked adjacent pair (the leftmost of equals) has been
        merged again and again: initial symbols minus merges."""
        n = len(word)
        if n < 2:
            return n
        get, symbol = self.ranks.get, list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that starts at each place, -1 if none: an entry of the heap with
        # another rank is out of date
        rank = [get(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:])]
        heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFFFF, x >> 40
            if rank[i] != r:
                continue
            merges += 1
            s = symbol[i] = self.made[r]
            j = after[i]
            rank[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = rank[i] = get(s << 20 | symbol[k], -1)
                if q >= 0:
                    push(heap, q << 40 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                q = rank[h] = get(symbol[h] << 20 | s, -1)
                if q >= 0:
                    push(heap, q << 40 | h)
        return n - merges

    def count(self, text: str) -> int:
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        """Where no two white-space characters meet, each space opens a piece that the pattern
        splits on its own, and so does each line end: pieces can be remembered whole."""
        if not text or _MEET(text):
            return sum(map(self.__getitem__, self.find(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return sum(map(self.__getitem__, self.find(first))) + sum(map(self.pieces.__getitem__, rest))


class Pieces(dict):
    """What follows a space (or a line end, which it then starts with) -> number of tokens."""

    def __init__(self, words: Merges) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, piece: str) -> int:
        n = sum(map(self.words.__getitem__, self.words.find(piece if piece[:1] == "\n" else " " + piece)))
        if len(piece) <= CACHED_CHARS and len(self) < CACHED_WORDS:
            self[piece] = n
        return n


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where
    printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, repeated ones too.

    A null text counts as empty: 0 bytes, 0 tokens, not over. Whole texts of any length are
    counted; special strings in a text are one token each. Extra columns are ignored; an empty
    table gives an empty one. path: the vocabulary file, readable on every executor.
    """

    def rows(batches):
        table = merges(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            count = [table.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(count, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = only(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
