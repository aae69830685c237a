"""Phrase collocations: sketches bound the counts from above, automata count what may be frequent.

1. Count-min sketches, first of words, then of pairs of words that pass, then of the phrases of three
   to five words whose pairs all pass. A task sends the cells that its texts hit, packed by ranges of
   cells; Spark deals the ranges, where the counts of all tasks are summed, and only one bit a cell
   comes back: whether the sum reaches the threshold.
2. Phrases all of whose cells pass are candidates. They and their words are dealt into parts of a
   bounded size, and each part becomes a pyahocorasick automaton over words: three symbols stand for
   a word of a language that the part has, one for any other and for a break, so that a key has few
   nodes. Matches are of whole words only, overlaps included; words are told apart by 64-bit hashes.
3. Every part scans all texts; the counts of the tasks are summed by ranges of keys, and thresholds
   go by these.

A sketch never counts too little, so that the counts are exact however narrow it is: a narrower one
only sends more candidates to the automata.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import islice
from operator import itemgetter
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import hash_words, mix, store, text_buffers

#: Least count of a phrase, longest phrase in words, rows of a language's list.
LEAST, WORDS, TOP = 100, 5, 2000
#: Bytes of text a cell of a row of the sketch stands for, and the least and most cells as powers of two.
BYTES_A_CELL, CELLS = 32, (16, 27)
#: Ranges of cells and of candidates, keys of a range of counts, bytes of text hashed at once, bytes of
#: the keys of a part, candidates and hashes that a task holds before it sends or sums them.
RANGES, KEYS, CHUNK, PART, HELD = 64, 16_384, 4 << 20, 12 << 20, 1 << 22

#: Piece breaks besides line breaks, which all become the same line break; then blanks.
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO = bytes.maketrans(_BREAKS + _BLANKS + _UPPER, b"\n" * len(_BREAKS) + b" " * len(_BLANKS) + _LOWER)
_MAP = np.frombuffer(_TO, np.uint8)
_U = np.uint64
_SKETCH_SQL = "lang string, n long, row int, range int, cells binary"
_SKETCH = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("row", pa.int32()), ("range", pa.int32()), ("cells", pa.binary())])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets of the texts in them and rows of the batch that these are, in chunks that end at
    a text's end or a piece break, so that no phrase is cut and a long text is many chunks."""
    data, offsets = text_buffers(batch.column(1))
    data = _MAP[data]
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            stop = int(offsets[np.searchsorted(offsets, to)])
            while to < stop:
                gap = np.flatnonzero(data[to : min(stop, to + 65_536)] == 10)
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(stop, to + 65_536)
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to)
        inner = np.clip(offsets[first : last + 1] - at, 0, to - at)
        yield data[at:to], inner, np.arange(first, last)
        at = to


class _Words:
    """The words of a chunk: hashes with their language, starts and ends, pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.data = data
        hashes, firsts = hash_words(data, offsets)
        blank = (data == 32) | (data == 10)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        self.starts = np.flatnonzero(~blank & (before | edge[:-1]))
        self.ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        self.text = text
        self.hashes = mix(hashes ^ langs[text])
        self.piece = np.cumsum(data == 10)[self.starts] + text

    def phrases(self, k: int, shorter: np.ndarray | None) -> np.ndarray:
        """Hashes of the k words from each place on, from those of k - 1 words."""
        if k == 1:
            return self.hashes
        return mix(shorter[: max(0, len(self.hashes) - k + 1)] * _U(0x9FB21C651E98DF25) + self.hashes[k - 1 :])

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each place on stand in one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i + k - 1]].tobytes().split()).decode()


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = _U(64 - bits)
    return (hashes >> down).astype(np.int64), (mix(hashes ^ _U(0x5851F42D4C957F2D)) >> down).astype(np.int64)


def _passes(hashes: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for cell, packed in zip(_cells(hashes, bits), sketch):
        ok &= (packed[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return ok


def _places(words: _Words, lengths: tuple[int, ...], sketches: list, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the phrases of each length that the sketches of shorter ones let pass:
    for two words that of words, for more that of pairs."""
    found, ok = None, None
    for k in range(1, max(lengths) + 1):
        found = words.phrases(k, found)
        if k == 2 and sketches:
            one = _passes(words.hashes, sketches[0], bits)
            ok = one[:-1] & one[1:] & words.whole(2)
            if len(sketches) > 1:
                ok &= _passes(found, sketches[1], bits)
            pairs = ok
        elif k > 2:
            n = max(0, len(words.hashes) - k + 1)
            ok = ok[:n] & pairs[k - 2 :][:n] & words.whole(k)
        if k in lengths:
            places = np.arange(len(found)) if k == 1 else np.flatnonzero(ok)
            yield k, places, found[places]


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    names = batch.column(0).to_pylist()
    return names, _seeds(names)


def _seeds(names: list[str]) -> np.ndarray:
    seeds = {x: int.from_bytes(sha256(x.encode()).digest()[:8], "little") for x in set(names)}
    return np.array([seeds[x] for x in names], _U)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of what they count."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Tally:
    """Hashes and how often they were added, in memory that goes with the distinct ones."""

    def __init__(self) -> None:
        self.keys, self.n, self.fresh, self.held = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.fresh.append(hashes)
        self.held += len(hashes)
        if self.held > max(HELD, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        self.keys, self.n = _sums(np.concatenate([self.keys, *self.fresh]), np.concatenate([self.n, np.ones(self.held, np.int64)]))
        self.fresh, self.held = [], 0
        return self.keys, self.n


def _packed(cells: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """Sorted cells of a range of `size` and their counts: how many lie in each 65,536 cells, the low
    16 bits of each, a byte for each count, and those of 255 and more in full."""
    held = np.bincount(cells >> 16, minlength=-(-size >> 16)).astype("<u4")
    return b"".join(x.tobytes() for x in (held, (cells & 0xFFFF).astype("<u2"), np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype("<i8")))


def _unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = -(-size >> 16)
    held = np.frombuffer(data, "<u4", parts).astype(np.int64)
    total, at = int(held.sum()), 4 * parts
    cells = np.repeat(np.arange(parts) << 16, held) + np.frombuffer(data, "<u2", total, at)
    n = np.frombuffer(data, np.uint8, total, at + 2 * total).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", -1, at + 3 * total) if (n == 255).any() else 0
    return cells, n


def _counted(lengths: tuple[int, ...], sent: Broadcast | None, bits: int):
    """Texts -> the ranges of this task's sketch of the phrases of these lengths and, with the words,
    how many words each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = sent.value if sent is not None else []
        tally, total = _Tally(), {}
        for batch in batches:
            names, seeds = _languages(batch)
            for data, offsets, rows in _chunks(batch):
                words = _Words(data, offsets, seeds[rows])
                if 1 in lengths:
                    for row, n in zip(rows, np.bincount(words.text, minlength=len(rows))):
                        total[names[row]] = total.get(names[row], 0) + int(n)
                for _, _, hashes in _places(words, lengths, sketches, bits):
                    tally.add(hashes)
        out = [(x, n, None, None, None) for x, n in total.items()]
        hashes, n = tally.settle()
        size = (1 << bits) // RANGES
        for row, cells in enumerate(_cells(hashes, bits)):
            cells, sums = _sums(cells, n)
            edges = np.searchsorted(cells, np.arange(RANGES + 1) * size)
            for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                if lo < hi:
                    out.append((None, None, row, r, _packed(cells[lo:hi] - r * size, sums[lo:hi], size)))
        for at in range(0, len(out), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 16]), _SKETCH)], schema=_SKETCH)

    return run


def _summed(least: int, size: int):
    """Ranges of all tasks, dealt by row and range -> one bit a cell: whether its sum reaches least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, r, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                into = sums.setdefault((row, r), np.zeros(size, np.int32))
                cells, n = _unpacked(data, size)
                into[cells] = np.minimum(into[cells] + n, least)
        for (row, r), held in sums.items():
            bits = np.packbits(held >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "range": pa.array([r], pa.int32()), "bits": [bits]})

    return run


def _sketch(texts: DataFrame, lengths: tuple[int, ...], sent: Broadcast | None, bits: int, least: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The passing cells of both rows, at most 2 ** CELLS[1] bits each, and the words of languages."""
    size = (1 << bits) // RANGES
    made = texts.mapInArrow(_counted(lengths, sent, bits), _SKETCH_SQL)
    made = store(made) if 1 in lengths else made
    dealt = made.where("range is not null").select("row", "range", "cells").repartition("row", "range")
    packed = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for r in store(dealt.mapInArrow(_summed(least, size), "row int, range int, bits binary")).toLocalIterator():
        packed[r.row][r.range * size // 8 : (r.range + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return tuple(packed), made.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))


def _named(sent: Broadcast, bits: int, longest: int):
    """Texts -> range, langs, phrases: the phrases of two words on that pass all sketches, most of them
    once a task, gathered by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, seen, out = sent.value, set(), [([], []) for _ in range(RANGES)]

        def flush() -> pa.RecordBatch:
            some = [r for r in range(RANGES) if out[r][0]]
            made = pa.RecordBatch.from_pydict({
                "range": pa.array(some, pa.int32()), "langs": pa.array([out[r][0] for r in some], pa.list_(pa.string())),
                "phrases": pa.array([out[r][1] for r in some], pa.list_(pa.string())),
            })
            seen.clear()
            for langs, phrases in out:
                langs.clear()
                phrases.clear()
            return made

        for batch in batches:
            names, seeds = _languages(batch)
            for data, offsets, rows in _chunks(batch):
                words = _Words(data, offsets, seeds[rows])
                for k, places, hashes in _places(words, tuple(range(2, longest + 1)), sketches, bits):
                    if k > 2:
                        ok = _passes(hashes, sketches[2], bits)
                        places, hashes = places[ok], hashes[ok]
                    hashes, first = np.unique(hashes, return_index=True)
                    for h, i in zip(hashes.tolist(), places[first].tolist()):
                        if h not in seen:
                            seen.add(h)
                            langs, phrases = out[h % RANGES]
                            langs.append(names[rows[words.text[i]]])
                            phrases.append(words.phrase(i, k))
                if len(seen) > HELD // 8:
                    yield flush()
        if seen:
            yield flush()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """range, langs, phrases, dealt by range -> lang, phrase, most of them once."""
    seen: set[tuple[str, str]] = set()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in seen], pa.string()), "phrase": pa.array([p for _, p in seen], pa.string())})
        seen.clear()
        return made

    for batch in batches:
        for langs, phrases in zip(batch.column(1), batch.column(2)):
            seen.update(zip(langs.as_py(), phrases.as_py()))
            if len(seen) > HELD // 8:
                yield flush()
    if seen:
        yield flush()


class _Phrases:
    """The automaton of a part's keys (lang, phrase), whose values are their places."""

    def __init__(self, keys: list[tuple[str, str]]) -> None:
        seeds = _seeds([x for x, _ in keys])
        texts = [p.encode() + b"\n" for _, p in keys]
        words = _Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), seeds)
        self.vocabulary = np.unique(words.hashes)
        self.base = 2
        while self.base**3 < len(self.vocabulary):
            self.base += 1
        coded = self._symbols(words.hashes)[1].astype("<u4").tobytes().decode("utf-32-le")
        ends = 3 * np.searchsorted(words.text, np.arange(len(keys) + 1))
        self.automaton = ahocorasick.Automaton()
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            self.automaton.add_word(coded[lo:hi], i)
        self.automaton.make_automaton()

    def _symbols(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its three symbols, each from a range of its own."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        b, three = self.base, np.empty((len(at), 3), np.uint32)
        known = self.vocabulary[at] == hashes
        for i in (2, 1, 0):
            at, three[:, i] = np.divmod(at, b)
        three += np.array([2, 2 + b, 2 + 2 * b], np.uint32)
        return known, three

    def matches(self, words: _Words) -> Iterator[int]:
        known, three = self._symbols(words.hashes)
        new = np.ones(len(known), bool)
        new[1:] = words.piece[1:] != words.piece[:-1]
        all_ = np.concatenate([np.ones((len(known), 1), np.uint32), three], 1)
        held = np.stack([new | ~known, known, known, known], 1)
        return map(itemgetter(1), self.automaton.iter(all_[held].astype("<u4").tobytes().decode("utf-32-le")))


#: The last automaton that this worker built, by the name of its part: many tasks of one scan use it.
_built: dict[str, tuple[_Phrases, int]] = {}


def _matched(sent: Broadcast, name: str):
    """Texts -> range, counts: matches of the keys (lang, phrase) that were sent, by ranges of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            if not sent.value:  # by hash a small part may have no keys
                return
            _built.clear()
            _built[name] = _Phrases(sent.value), len(sent.value)
        phrases, n = _built[name]
        counts = np.zeros(n, np.int64)
        for batch in batches:
            _, seeds = _languages(batch)
            for data, offsets, rows in _chunks(batch):
                words = _Words(data, offsets, seeds[rows])
                if not len(words.hashes):
                    continue
                ids = phrases.matches(words)
                while len(some := np.fromiter(islice(ids, 1 << 20), np.int64)):
                    counts += np.bincount(some, minlength=n)
        for r, at in enumerate(range(0, n, KEYS)):
            held = counts[at : at + KEYS]
            if held.any():
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "counts": [held.tobytes()]})

    return run


def _totals(sent: Broadcast):
    """range, counts of all tasks, dealt by range -> lang, phrase, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = sent.value, {}
        for batch in batches:
            for r, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[r] = sums.get(r, 0) + np.frombuffer(held, np.int64)
        for r, f in sums.items():
            mine = keys[r * KEYS : (r + 1) * KEYS]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in mine], pa.string()), "phrase": pa.array([p for _, p in mine], pa.string()), "f": f})

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = WORDS, part: int = PART, bytes_a_cell: int = BYTES_A_CELL) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f: exact counts of all phrases of two to `longest` words that occur `least` times
    or more, of their parts and words, and of some others) and (lang, n: words of the language)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(CELLS[1], max(CELLS[0], (size // bytes_a_cell).bit_length()))
    sketches, sent, words = [], None, None
    for lengths in [(1,), (2,), tuple(range(3, longest + 1))]:
        found, n = _sketch(texts, lengths, sent, bits, least)
        words = n if words is None else words
        sketches.append(found)
        if sent is not None:
            sent.unpersist()
        sent = spark.sparkContext.broadcast(sketches)
    gathered = texts.mapInArrow(_named(sent, bits, longest), "range int, langs array<string>, phrases array<string>")
    named = store(gathered.repartition("range").mapInArrow(_once, "lang string, phrase string").distinct())
    sent.unpersist()
    single = named.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    keys = store(named.unionByName(single))
    # a part is a share of the keys by hash: its size follows from the number of parts
    held = keys.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    parts, counts = -(-held // part), []
    for i in range(parts):
        mine = keys.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)) == i)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.toLocalIterator()])
        matched = texts.mapInArrow(_matched(sent, uuid4().hex), "range int, counts binary").repartition("range")
        counts.append(store(matched.mapInArrow(_totals(sent), "lang string, phrase string, f long")))
        sent.unpersist()
    none = keys.select("lang", "phrase", F.lit(0).cast("long").alias("f")).where("false")
    return reduce(DataFrame.unionByName, counts, none), words


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = WORDS, top: int = TOP, part: int = PART, bytes_a_cell: int = BYTES_A_CELL
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by their
    lowest-scoring cut, score = floor(1000 a n / (l r)).

    a: occurrences of the phrase within pieces, overlaps included; l and r: those of the two sides of
    the cut; n: words of the language. A phrase goes if a longer candidate holds it as often as it
    occurs. Null texts are empty, a null lang is `und`. Repeated rows count each; ids are not looked
    at. Ties: smallest cut; then a, then code point. Extra columns are ignored; an empty table, or one
    where nothing occurs often enough, gives an empty one. A long text is counted in chunks that end
    at piece breaks. The scans number as many as the parts of `part` bytes that the keys fill.
    """
    with scratch(docs.sparkSession) as kept:
        f, words = phrase_counts(docs, least, longest, part, bytes_a_cell)
        often = store(f.where(F.col("f") >= least))
        w = F.split("phrase", " ")
        found = often.withColumn("w", w).where("size(w) > 1").withColumnRenamed("f", "a")
        cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
        side = lambda start, n: F.array_join(F.slice("w", start, n), " ")
        cuts = cuts.select("lang", "phrase", "a", "cut", side(F.lit(1), F.col("cut")).alias("left"), side(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
        cuts = cuts.join(often.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        cuts = cuts.join(often.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        cuts = cuts.join(words, "lang")
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        cuts = cuts.withColumns({"num": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n"), "den": wide("l") * wide("r")})
        cuts = cuts.withColumn("score", F.expr("num div den"))
        best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

        starts = lambda k: F.sequence(F.lit(1), F.size("w") - k + 1)
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(starts(k), lambda i: F.array_join(F.slice("w", i, k), " "))))
        inner = found.where("size(w) > 2").select("lang", "a", F.explode(spans).alias("phrase"))
        inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        best = best.join(inner, ["lang", "phrase"], "left").where("around is null or around < a")
        order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = store(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"))
        kept.append(out)
    return out
