"""N-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence.

The product's entry for two documents is their overlap. Only blocks that can hold an entry over
the bound are formed:

* Equal sets are one class, and a class is one row of the incidence. Of the copies that a batch
  holds, one alone brings its columns.
* Rows are put in one global order, rare n-grams first. Two sets with overlap o >= ceil(t * size)
  share at least l n-grams among the first size - ceil(t * size) + l of each, so these columns
  alone (a bit more than a quarter) are dealt out by n-gram. They travel in packed slices of the
  key range, sorted and matched as arrays; an n-gram that several documents of one batch have sends
  one entry for all of them, so that a frequent one brings a row a batch and not one a document.
* A class of whose columns fewer than the bound occur elsewhere links to nothing and goes.
* The entries left are counted in full, from the whole sets.

Every document is first compared with one hub (of those it shares columns with the one with the
fewest columns of its own). Entries between documents that are then in one component are never
formed. Of the rest, those go whose whole sets have too few n-grams in other components for a link.
Then n-grams of few documents give pairs; where many documents share one, blocks of
them are multiplied as dense slices, and a block gives only the links that connect it. No link is
lost, and no group is ever written out as pairs.

Columns and whole sets are taken in rounds of a bounded number, by hash of what they meet at, and what
a round deals out goes with it: disk beside the tables of columns does not grow with the rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, only, pieces, rolling, store, text_buffers
from ..plans.tables import forget, scratch
from .graph import connected_components, more_components

_U = np.uint64
#: n-grams held to be frequent at most: the bound on what is sent to the workers (16 bytes each).
FREQUENT = 1 << 15
_PIECE = 1 << 21
#: Sets that link share size / _PART + 1 n-grams within their prefixes, size of the smaller one.
_PART = 16
#: Rows that are sent to the workers at most, of documents or of 64 ids each; more are joined by a shuffle.
BROADCAST = 1 << 20
#: n-grams of whole sets, and columns, that a round deals out.
SETS, CELLS = 1 << 28, 1 << 25
#: More documents than this that share an n-gram are compared as blocks of so many at most.
_DENSE, _BLOCK = 16, 512
#: Partners of a document whose sets are compared with its own in one task, or about so many.
_PARTNERS = 256


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram hashes of whole documents, one after the other, the offset of each document's first,
    and how many words it has."""
    words, at = hash_words(data, offsets, lower=True)
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.zeros(count.sum(), _U)
    first = np.r_[0, np.cumsum(count)]
    if len(words) >= n:
        doc = np.repeat(np.arange(len(size)), size)[: len(words) - n + 1]
        full = np.arange(len(doc)) - at[:-1][doc] + n <= size[doc]
        out[np.repeat(size >= n, count)] = rolling(words, n)[full]
    for i in np.flatnonzero((size > 0) & (size < n)):
        out[first[i]] = mix(rolling(words[at[i] : at[i + 1]], int(size[i])) + _U(size[i]))[0]
    return out, first, size


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _grams, but the distinct ones of each document in the order of their values."""
    flat, first, words = _grams(data, offsets, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[first[:-1][first[:-1] < len(flat)]] = True
    return flat[keep], np.r_[0, np.cumsum(keep)][first], words


def _pieces(column: pa.Array):
    """Texts of a batch a piece at a time: first and last row, bytes, offsets."""
    data, offsets = text_buffers(column)
    for a, b in pieces(offsets, _PIECE):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _frequent(docs: DataFrame, n: int, percent: int, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The n-grams most often met in several documents of one batch, over all documents, and the columns
    of all prefixes. They only set the order of the columns: any order gives the same links."""

    def count(batches):
        for batch in batches:
            held, columns = [], 0
            for _, to, data, offsets in _pieces(batch.column(0)):
                flat, first, _ = _sets(data, offsets, n)
                held.append(flat)
                columns += int(_width(np.diff(first), percent).sum())
                if sum(map(len, held)) > 1_500_000 or to == batch.num_rows:
                    gram, times = _repeats(np.concatenate(held))
                    yield pa.RecordBatch.from_arrays([pa.array([*gram.view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[times, columns])], ["gram", "n"])
                    held, columns = [], 0

    found = docs.select(F.col(text).alias("t")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = store(found)
    columns = sum(r["n"] for r in found.where("gram is null").collect())
    found = found.where("gram is not null")
    # the lowest power of two above which few enough stand: the driver gets these alone
    level, held = 63, 0
    for r in sorted(found.groupBy(F.floor(F.log2("n")).cast("int").alias("l")).count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        level = r["l"]
    rows = found.where(F.floor(F.log2("n")) >= level).toPandas()
    grams = rows["gram"].to_numpy(np.int64).view(_U)
    order = np.argsort(grams)
    return grams[order], rows["n"].to_numpy(np.int64)[order], columns


def _width(m: np.ndarray, percent: int) -> np.ndarray:
    """Columns of the prefix of a set of that size."""
    return np.where(m > 0, np.minimum(m, m + (-m * percent) // 100 + m // _PART + 1), 0)


def _repeats(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.sort(v)
    edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    c = np.diff(np.r_[edge, len(v)])
    keep = c >= 4
    return v[edge][keep], c[keep].astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document, modulo 2^64."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _prefixes(data: np.ndarray, offsets: np.ndarray, n: int, percent: int, grams: np.ndarray, counts: np.ndarray):
    """For each document: words, set size, two hashes of the set, width of the prefix, how many of it
    are not frequent, and the prefixes, rare n-grams first, with their offsets."""
    flat, first, words = _sets(data, offsets, n)
    m = np.diff(first)
    h1, h2 = _sums(mix(flat), first), _sums(mix(flat ^ _U(0x5851F42D4C957F2D)), first)
    width = _width(m, percent)
    light = width.copy()
    doc = np.repeat(np.arange(len(m)), m)
    if len(grams) and len(flat):
        at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
        often = np.where(grams[at] == flat, counts[at], 0)
        for i in np.unique(doc[often > 0]).tolist():
            a, b = first[i], first[i + 1]
            order = np.argsort(often[a:b], kind="stable")
            flat[a:b] = flat[a:b][order]
            light[i] = np.count_nonzero(often[a:b][order[: width[i]]] == 0)
    keys = flat[np.arange(len(flat)) - first[:-1][doc] < width[doc]]
    return words, m, h1, h2, width, light, keys, np.r_[0, np.cumsum(width)]


_SETS = "doc_id long, words long, n int, h1 long, h2 long, width int"
_PACKED = "slice long, base long, keys binary, cls binary, many binary, both binary, docs binary"
_LOW = _U(0xFFFFFFFF)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _incidence(docs: DataFrame, n: int, percent: int, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two kinds of rows. Without a slice, one a document: doc_id, words, n (set size), h1, h2 (of the
    set), width (of the prefix) and the carried columns. With one, a batch's prefix columns in a slice
    of the key range: keys and cls (document) of those that one document of the batch has; many: keys
    that more have; both, docs: the cells of these and of the frequent keys, which need meet no others
    and are spread over the slices evenly. They are packed as bytes (see _packed). Of equal sets in one batch the one with the smallest doc_id
    brings its columns, the others none."""
    grams, counts, columns = _frequent(docs, n, percent, text)
    slices = 1 + (columns >> 16)  # of about 65 000 columns each
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    more = "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(picked.schema.fields[2:]))
    names = [*_names(_SETS), *(f"c{i}" for i in range(len(carry))), *_names(_PACKED)]

    def rows(batches):
        for batch in batches:
            parts = [_prefixes(data, offsets, n, percent, grams, counts) for _, _, data, offsets in _pieces(batch.column(1))]
            if not parts:
                continue
            words, m, h1, h2, width, light, keys = (np.concatenate([p[i] for p in parts]) for i in range(7))
            first: dict[tuple, tuple] = {}  # by set: smallest doc_id and its place
            ids = batch.column(0).to_pylist()
            for i, (*of, d) in enumerate(zip(m.tolist(), h1.tolist(), h2.tolist(), ids)):
                of = tuple(of)
                if of[0] and d is not None and (of not in first or d < first[of][0]):
                    first[of] = d, i
            of_set = [batch.column(0), *map(pa.array, (words.astype(np.int64), m.astype(np.int32), h1.view(np.int64), h2.view(np.int64), width.astype(np.int32))), *batch.columns[2:]]
            none = [*(pa.nulls(len(ids), pa.int64()) for _ in range(2)), *(pa.nulls(len(ids), pa.binary()) for _ in range(5))]
            yield pa.RecordBatch.from_arrays(of_set + none, names)
            has = np.zeros(len(m), bool)
            has[[i for _, i in first.values()]] = True
            owner = batch.column(0).fill_null(0).to_numpy()
            place = np.arange(len(keys)) - np.repeat(np.cumsum(width) - width, width)
            mine, rare = np.repeat(has, width), place < np.repeat(light, width)
            packed = _packed(keys[mine], np.repeat(owner, width)[mine], rare[mine], slices)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(packed[0]), a.type) for a in of_set), *packed], names)

    return picked.mapInArrow(rows, f"{_SETS}{more}, {_PACKED}")


def _packed(keys: np.ndarray, cls: np.ndarray, rare: np.ndarray, slices: int) -> list[pa.Array]:
    """The columns of _PACKED. A key is its slice and, below, 32 bits of the n-gram's hash: a slice has about
    65 000 columns, so that few differing n-grams share a key. They are candidates more, never links: cells are
    upper bounds, and links are counted over whole sets. In a slice, keys and many have the 32 bits alone.
    Documents count from base, in 4 bytes where the batch's ids allow it, else in 8."""
    keys = ((keys >> _U(32)) * _U(slices) >> _U(32) << _U(32)) | (keys & _LOW)
    base = cls.min(initial=np.iinfo(np.int64).max)
    cls = cls.view(_U) - np.asarray(base).view(_U)
    cls = cls.astype(np.uint32 if cls.max(initial=0) <= _LOW else _U)
    hot, hot_cls = keys[~rare], cls[~rare]
    keys, cls = keys[rare], cls[rare]
    order = np.argsort(keys)
    keys, cls = keys[order], cls[order]
    n = _run_lengths(keys)
    many = keys[n > 1]
    both, docs = np.r_[many, hot], np.r_[cls[n > 1], hot_cls]
    many = many[np.r_[True, many[1:] != many[:-1]]] if len(many) else many
    keys, cls = keys[n == 1], cls[n == 1]
    at, more = keys >> _U(32), many >> _U(32)
    which = np.union1d(at, more)
    if len(both) and not len(which):
        which = np.zeros(1, _U)
    ends = lambda x: np.r_[np.searchsorted(x, which), len(x)]
    at, more, even = ends(at), ends(more), np.linspace(0, len(both), len(which) + 1).astype(np.int64)

    low = lambda x: (x & _LOW).astype(np.uint32)
    lists = ((at, low(keys)), (at, cls), (more, low(many)), (even, both), (even, docs))
    return [pa.array(which.astype(np.int64)), pa.array(np.full(len(which), base)), *(_cut(*x) for x in lists)]


def _cut(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values between each two ends as bytes."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _run_lengths(sorted_: np.ndarray) -> np.ndarray:
    """For each entry how many equal it."""
    edge = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(sorted_)])
    return np.repeat(size, size)


def _shared_cells(packed: DataFrame) -> DataFrame:
    """key, cls: the columns that more than one document has, and those of frequent n-grams."""

    def flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).astype(_U)

    def documents(got: pa.Table, name: str, beside: str, size: int) -> np.ndarray:
        """Of each cell; `beside` has `size` bytes a cell."""
        out = []
        for base, ids, x in zip(got.column("base").to_numpy(), got.column(name).to_pylist(), got.column(beside).to_pylist()):
            kind = np.uint32 if len(ids) * size == len(x) * 4 else _U
            out.append(np.frombuffer(ids, kind).astype(_U) + base.view(_U))
        return np.concatenate(out).view(np.int64)

    def matched(got: pa.Table) -> pa.Table:
        keys, cls = flat(got.column("keys"), np.uint32), documents(got, "cls", "keys", 4)
        all_ = np.concatenate([keys, flat(got.column("many"), np.uint32)])
        order = np.argsort(all_)
        again = order[(_run_lengths(all_[order]) > 1) & (order < len(keys))]
        key = np.r_[keys[again] | got.column("slice").to_numpy()[:1].view(_U) << _U(32), flat(got.column("both"), _U)]
        return pa.table({"key": key.view(np.int64), "cls": np.r_[cls[again], documents(got, "docs", "both", 8)]})

    return packed.groupBy("slice").applyInArrow(matched, "key long, cls long")


def picked(docs: DataFrame, ids: DataFrame, by: str, how: str) -> DataFrame:
    """docs whose whole number `by` is in ids (how: left_semi) or is not (left_anti). Sent are bits, a row for
    the ids of each 64 numbers, so that ids that lie close take a bit or two each. More rows than BROADCAST are
    joined by a shuffle, with equal rows."""
    place = f"cast(`{by}` & 63 as int)"
    bits = store(ids.groupBy(F.expr(f"shiftright(`{by}`, 6)").alias("_block")).agg(F.expr(f"bit_or(shiftleft(1L, {place}))").alias("_bits")))
    if bits.count() > BROADCAST:
        return docs.join(ids, by, how)
    return docs.join(F.broadcast(bits), F.expr(f"shiftright(`{by}`, 6) = _block and shiftright(_bits, {place}) & 1 = 1"), how)


def _whole_sets(docs: DataFrame, ids: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """cls, the other columns of ids, grams (sorted, 8 bytes each): the whole sets of the documents in ids."""

    def rows(batches):
        for batch in batches:
            for a, b, data, offsets in _pieces(batch.column(1)):
                flat, first, _ = _sets(data, offsets, n)
                grams = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(first.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(c.slice(a, b - a) for c in batch.columns[2:]), grams.cast(pa.binary())], names)

    read = docs.select(F.col(doc_id).cast("long").alias("cls"), F.col(text).alias("t"))
    more = [c for c in ids.columns if c != "cls"]
    names = ["cls", *more, "grams"]
    schema = ", ".join(["cls long", *(f"`{c}` {ids.schema[c].dataType.simpleString()}" for c in more), "grams binary"])
    if not more:
        return picked(read, ids, "cls", "left_semi").mapInArrow(rows, schema)
    # what is a little too much to be sent at once is sent in a few parts, of which each reads the texts
    parts = -(-ids.count() // max(BROADCAST, 1))
    if parts > 4:
        return read.join(ids, "cls").select("cls", "t", *more).mapInArrow(rows, schema)
    each = [ids.where(F.pmod(F.xxhash64("cls"), F.lit(parts)) == i) if parts > 1 else ids for i in range(max(1, parts))]
    return reduce(DataFrame.union, [read.join(F.broadcast(x), "cls").select("cls", "t", *more).mapInArrow(rows, schema) for x in each])


def _met(docs: DataFrame, meets: DataFrame, key: tuple[str, ...], give, schema: str, n: int, doc_id: str, text: str) -> DataFrame:
    """What `give` makes of the whole sets of the documents that meet at each key. meets: cls, size of its set,
    the columns of the key and others; a document may meet others at many keys."""
    meets = store(meets)
    rounds = 1 + (meets.agg(F.sum("size")).first()[0] or 0) // SETS
    names, out = [c for c in meets.columns if c not in ("cls", "size")], []
    for i in range(rounds):
        mine = meets.where(F.pmod(F.xxhash64(*key, F.lit("round")), F.lit(rounds)) == i) if rounds > 1 else meets
        mine = store(mine.groupBy("cls").agg(F.collect_list(F.struct(*names)).alias("at")))
        dealt = _whole_sets(docs, mine, n, doc_id, text).select("cls", "grams", F.explode("at").alias("at"))
        out.append(store(dealt.select("cls", "grams", "at.*").groupBy(*key).applyInArrow(give, schema)))
        forget(mine)
    forget(meets)
    return reduce(DataFrame.union, out)


def _verified(pairs: DataFrame, percent: int, docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets link: the masked product, counted over the whole sets. pairs: also na, nb,
    sizes of their sets. The partners a of one b are dealt into parts, each with the set of b."""
    pairs = store(pairs.select("a", "b", "na", "nb"))
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / _PARTNERS).cast("int").alias("parts"), F.max("nb").alias("size"))
    some = pairs.join(parts.drop("size"), "b").select(F.col("a").alias("cls"), F.col("na").alias("size"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    one = parts.select(F.col("b").alias("cls"), "size", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def linked(got: pa.Table) -> pa.Table:
        b = got.column("b")[0].as_py()
        ids, sets = got.column("cls").to_pylist(), [np.frombuffer(g, _U) for g in got.column("grams").to_pylist()]
        of_b, out = [g for d, g in zip(ids, sets) if d == b], set()
        for d, g in zip(ids, sets):
            if d == b or not len(g):
                continue
            for h in of_b:
                if 100 * min(len(g), len(h)) >= percent * max(len(g), len(h)) and len(h):
                    shared = int(np.count_nonzero(h[np.minimum(np.searchsorted(h, g), len(h) - 1)] == g))
                    if (100 + percent) * shared >= percent * (len(g) + len(h)):
                        out.add(d)
        return pa.table({"a": pa.array(sorted(out), pa.int64()), "b": pa.array([b] * len(out), pa.int64())})

    return _met(docs, some.union(one), ("b", "part"), linked, "a long, b long", n, doc_id, text)


def _possible(n: str, top: str, alone: str, percent: int) -> str:
    """Whether a set of n to top n-grams, `alone` of which no candidate has, can link at all."""
    return f"100 * ({top} - {alone}) >= {percent} * {n}"


def _near(percent: int) -> str:
    """Whether the overlap that two documents can have reaches what their sizes ask for."""
    bound = "least(top - alone, top2 - alone2)"
    return f"100 * top2 >= {percent} * n and 100 * top >= {percent} * n2 and {100 + percent} * {bound} >= {percent} * (n + n2)"


def _open_cells(cells: list[DataFrame], kept: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The cells by which links between different components may still be missing: those of keys
    that several components share, of documents (kept) that have enough of them for a link. cells: in
    rounds of whole keys."""
    label = found.withColumnRenamed("node", "cls")
    left = [x.select("key", "cls").join(label, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp")) for x in cells]
    for last in (False, True):
        before, left = left, []
        for x in before:
            mixed = x.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
            left.append(store(x.join(mixed, "key")))
            forget(x)
        enough = reduce(DataFrame.union, left).groupBy("cls").agg(F.count("*").alias("c")).join(kept.select("cls", "n", "top", "width"), "cls")
        enough = enough.where(f"c >= (cast(ceil(n * {percent} / 100) as int) div {_PART}) + 1").select("cls", "n", "top", F.greatest(F.lit(0), F.col("width") - F.col("c")).cast("int").alias("alone"))
        enough = store(enough.where(_possible("n", "top", "alone", percent)))
        if not last:
            before, left = left, [store(x.join(enough.select("cls"), "cls", "left_semi")) for x in left]
            for x in before:
                forget(x)
    out = store(reduce(DataFrame.union, left).join(enough, "cls"))
    for x in left:
        forget(x)
    return out


_DEALT = "slice long, base long, keys binary, cls binary, comp binary"


def _open_documents(documents: DataFrame, percent: int, docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """cls of the documents (cls, comp, n, top) with enough n-grams for a link that documents of other
    components have too: whole sets are dealt out, so that a shared passage alone keeps no document."""
    total = documents.agg(F.sum("top")).first()[0] or 0
    slices, rounds, out = 1 + (total >> 18), 1 + total // SETS, []
    buckets = _U(1 + (total >> 22))  # of documents, whose counts are packed as bytes

    def deal(i: int):
        def rows(batches):
            for batch in batches:
                cls, comp = (batch.column(k).to_numpy() for k in (0, 1))
                grams = batch.column(2).to_pylist()
                keys = np.frombuffer(b"".join(grams), _U)
                doc = np.repeat(np.arange(len(cls)), [len(g) // 8 for g in grams])
                at = (keys >> _U(32)) * _U(slices) >> _U(32)
                order = np.argsort(at, kind="stable")
                if rounds > 1:
                    order = order[at[order] % _U(rounds) == i]
                if not len(order):
                    continue
                base = min(cls.min(), comp.min())
                cls, comp = (x.view(_U) - base.view(_U) for x in (cls, comp))
                kind = np.uint32 if max(cls.max(), comp.max()) <= _LOW else _U
                which, first = np.unique(at[order], return_index=True)
                ends = np.r_[first, len(order)]
                values = ((keys[order] & _LOW).astype(np.uint32), cls.astype(kind)[doc[order]], comp.astype(kind)[doc[order]])
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(np.full(len(which), base)), *(_cut(ends, v) for v in values)], _names(_DEALT))

        return rows

    def mixed(got: pa.Table) -> pa.Table:
        parts = [[], [], []]
        for base, *three in zip(*(got.column(c).to_pylist() for c in _names(_DEALT)[1:])):
            kind = np.uint32 if len(three[0]) == len(three[1]) else _U
            base = np.asarray(base).view(_U)
            for into, x, of in zip(parts, three, (np.uint32, kind, kind)):
                into.append(np.frombuffer(x, of) if into is parts[0] else (np.frombuffer(x, of).astype(_U) + base).view(np.int64))
        keys, cls, comp = map(np.concatenate, parts)
        order = np.argsort(keys)
        keys, cls, comp = keys[order], cls[order], comp[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        several = np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first)
        cls, c = np.unique(cls[np.repeat(several, np.diff(np.r_[first, len(keys)]))], return_counts=True)
        at = mix(cls.view(_U)) % buckets
        order = np.argsort(at, kind="stable")
        which, first = np.unique(at[order], return_index=True)
        ends = np.r_[first, len(order)]
        return pa.table({"bucket": which.astype(np.int64), "cls": _cut(ends, cls[order]), "c": _cut(ends, c[order].astype(np.uint32))})

    def summed(got: pa.Table) -> pa.Table:
        cls, c = (np.frombuffer(b"".join(got.column(x).to_pylist()), kind) for x, kind in (("cls", np.int64), ("c", np.uint32)))
        cls, at = np.unique(cls, return_inverse=True)
        return pa.table({"cls": cls, "c": np.bincount(at, c, len(cls)).astype(np.int64)})

    for i in range(rounds):
        sets = _whole_sets(docs, documents.select("cls", "comp"), n, doc_id, text)
        counts = sets.mapInArrow(deal(i), _DEALT).groupBy("slice").applyInArrow(mixed, "bucket long, cls binary, c binary")
        out.append(store(counts.groupBy("bucket").applyInArrow(summed, "cls long, c long")))
    counts = reduce(DataFrame.union, out).groupBy("cls").agg(F.sum("c").alias("c"))
    return store(counts.join(documents, "cls").where(f"100 * c >= {percent} * n").select("cls"))


def _product(grams: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray, cols: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of enough links between the documents `rows` and `cols` to connect all that
    link: the overlaps are the product of their incidences, a slice of n-grams at a time."""
    flat = np.concatenate([grams[i] for i in (*rows, *cols)])
    doc = np.repeat(np.arange(len(rows) + len(cols)), [len(grams[i]) for i in (*rows, *cols)])
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[gram] > 1
    _, gram = np.unique(gram[keep], return_inverse=True)
    doc = doc[keep]
    overlap = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    for lo in range(0, int(gram.max(initial=-1)) + 1, width):
        at = (gram >= lo) & (gram < lo + width)
        x = np.zeros((len(rows) + len(cols), width), np.float32)
        x[doc[at], gram[at] - lo] = 1
        overlap += x[: len(rows)] @ x[len(rows) :].T
    a, b = sizes[rows][:, None], sizes[cols][None, :]
    link = (100 * overlap >= percent * (a + b - overlap)) & (comp[rows][:, None] != comp[cols][None, :])
    label, out = comp.copy(), []
    for i in np.flatnonzero(link.any(1)):
        for j in np.flatnonzero(link[i]):
            x, y = label[rows[i]], label[cols[j]]
            if x != y:
                label[label == x] = y
                out.append((int(rows[i]), int(cols[j])))
    return out


def _block_links(dense: DataFrame, percent: int, docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between the documents of each dense group, enough to connect all that link.
    dense: cls, first (a document that shares an n-gram with it), comp (what is known to link), top.

    A group is dealt into blocks by hash, and each pair of its blocks is one task of bounded size."""
    group = connected_components(dense.select(F.col("cls").alias("a"), F.col("first").alias("b")))
    members = dense.groupBy(F.col("cls").alias("node")).agg(F.min("comp").alias("comp"), F.max("top").alias("size")).join(group, "node")
    members = store(members.select(F.col("node").alias("cls"), "comp", "size", F.col("component").alias("family")))
    size = members.groupBy("family").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    members = members.join(size, "family").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cls", "size", "family", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "comp")

    def multiply(got: pa.Table) -> pa.Table:
        comp = np.unique(got.column("comp").to_numpy(), return_inverse=True)[1]
        out = []
        if len(comp) and comp.max() > 0:
            grams, ids = [np.frombuffer(g, np.int64) for g in got.column("grams").to_pylist()], got.column("cls").to_numpy()
            block, x, y = (got.column(c).to_numpy() for c in ("block", "x", "y"))
            sizes, first = np.array([len(g) for g in grams]), block == x
            rows = np.flatnonzero(first)
            cols = rows if x[0] == y[0] else np.flatnonzero(~first)
            # a block that hashing made larger than meant is taken in parts
            for i in range(0, len(rows), 2 * _BLOCK):
                for j in range(0, len(cols), 2 * _BLOCK):
                    out += [(ids[a], ids[b]) for a, b in _product(grams, sizes, rows[i : i + 2 * _BLOCK], cols[j : j + 2 * _BLOCK], comp, percent)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return _met(docs, members, ("family", "x", "y"), multiply, "a long, b long", n, doc_id, text)


def _same_documents(left: DataFrame) -> DataFrame:
    """key, m, first, weight: one of the keys of each set of the cells' documents, and how many there
    are; n-grams of the same documents, as those of a passage are, count together. Sums of 32-bit
    halves of hashes: unlike an exclusive or they do not cancel a cls that a key holds twice, as
    under a repeated doc_id, and they cannot overflow."""
    sign = []
    for i in (0, 1):
        h = F.xxhash64("cls", F.lit(i))
        sign += [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"s{i}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"t{i}")]
    m = left.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("first"), *sign).where("m > 1")
    return m.groupBy("s0", "s1", "t0", "t1", "m", "first").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "m", "first", "weight")


def ngram_jaccard_join(
    docs: DataFrame, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), measures: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; with measures also n_words and set_hash
    (equal for equal sets), and the columns in `carry`.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A row's set: its
    distinct n-word shingles; with fewer words the whole sequence; null, empty or blank text: the
    empty set, linked with nothing (component: itself). Rows link when 100 * intersection >=
    percent * union; percent from 50 to 100. A null doc_id takes no part and has a null component.
    Rows that repeat a doc_id are one node. Extra columns are ignored; an empty table gives an empty
    one. Shingles are compared by 64-bit hashes, classes of equal sets by 128 bits.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100, not {percent}: below, links may share too few columns of their prefixes")
    with scratch(docs.sparkSession) as kept:
        out = _components(only(docs, doc_id, text, *carry), n, percent, doc_id, text, carry)
        names = ["doc_id", "n_shingles", "component_id"] + ["n_words", "set_hash"] * measures
        out = store(out.select(*names, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]))
        kept.append(out)
    return out


def _components(docs: DataFrame, n: int, percent: int, doc_id: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    both = store(_incidence(docs, n, percent, doc_id, text, carry))
    rows = store(both.where("slice is null").drop(*_names(_PACKED)))
    shared = store(_shared_cells(both.where("slice is not null").select(*_names(_PACKED))))
    forget(both)  # the largest table of all: most columns are in no other document
    real = rows.where("n > 0 and doc_id is not null")
    classes = store(real.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cls")))

    reps = real.select("doc_id", "h1", "h2", "n", "width").join(classes.select(F.col("cls").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    sizes = reps.groupBy(F.col("doc_id").alias("cls")).agg(F.min("n").alias("n"), F.max("n").alias("top"), F.max("width").alias("width"))
    least = F.expr(f"(cast(ceil(n * {percent} / 100) as int) div {_PART}) + 1")  # of the smallest partner
    # sizes has classes alone: a copy from another batch than the first of its class goes here
    kept = shared.groupBy("cls").agg(F.count("*").alias("c")).join(sizes, "cls").where(F.col("c") >= least)
    alone = F.greatest(F.lit(0), F.col("width") - F.col("c")).cast("int").alias("alone")
    kept = kept.select("cls", "n", "top", "width", alone).where(_possible("n", "top", "alone", percent))
    # smaller for fewer columns alone; ties by hash, and two that share a code are two hubs
    code = F.shiftleft(F.least(F.col("alone"), F.lit((1 << 20) - 1)).cast("long"), 43).bitwiseOR(F.xxhash64("cls").bitwiseAND((1 << 43) - 1))
    kept = store(kept.withColumn("code", code))
    cells = shared.join(kept.select("cls", "code"), "cls").select("cls", "key", "code")
    rounds = 1 + shared.count() // CELLS
    if rounds > 1:
        cells = cells.withColumn("round", F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds)).cast("int")).sortWithinPartitions("round", "cls")
    cells = store(cells, by="round" if rounds > 1 else None)
    forget(shared)
    each = [cells.where(F.col("round") == i).drop("round") for i in range(rounds)] if rounds > 1 else [cells]
    whole = (percent, docs, n, doc_id, text)

    near = _near(percent)
    # each document meets the hub of most of its columns: the one with the fewest of its own
    met = []
    for x in each:
        hubs = x.groupBy("key").agg(F.count("*").alias("m"), F.min("code").alias("hub")).where("m > 1").select("key", "hub")
        x = x.join(hubs, "key").where("code <> hub").groupBy("cls", "hub").agg(F.count("*").alias("c"))
        met.append(store(x) if rounds > 1 else x)
    met = reduce(DataFrame.union, met).groupBy("cls", "hub").agg(F.sum("c").alias("c")) if rounds > 1 else met[0]
    hub = kept.select(F.col("code").alias("hub"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("top").alias("top2"), F.col("alone").alias("alone2"))
    met = met.join(kept.select("cls", "n", "top", "alone"), "cls").join(hub, "hub").where(near)
    met = met.groupBy("cls").agg(F.max("top").alias("na"), F.max_by(F.struct("cls2", "top2"), F.struct("c", "cls2")).alias("to"))
    links = store(_verified(met.select(F.col("cls").alias("a"), F.col("to.cls2").alias("b"), "na", F.col("to.top2").alias("nb")), *whole))
    found = connected_components(links)

    left = _open_cells(each, kept, found, percent)
    forget(cells)
    open_ = store(left.groupBy("cls").agg(F.min("comp").alias("comp"), F.min("n").alias("n"), F.max("top").alias("top")))
    left = store(left.join(_open_documents(open_, *whole), "cls", "left_semi"))
    m = store(_same_documents(left))
    thin = left.join(m.where(f"m <= {_DENSE}").select("key", "weight"), "key")
    other = thin.select("key", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("top").alias("top2"), F.col("alone").alias("alone2"), F.col("comp").alias("comp2"))
    both = thin.join(other, "key").where("comp < comp2").where(near)
    sizes = [F.least(F.min("n"), F.min("n2")).alias("n"), F.max("top").alias("na"), F.max("top2").alias("nb")]
    pairs = both.groupBy("cls", "cls2").agg(F.sum("weight").alias("c"), *sizes).where(f"c >= n div {_PART} + 1")
    links = _verified(pairs.select(F.col("cls").alias("a"), F.col("cls2").alias("b"), "na", "nb"), *whole)
    dense = store(left.join(m.where(f"m > {_DENSE}"), "key").select("cls", "first", "comp", "top"))
    if not dense.isEmpty():
        links = links.union(_block_links(dense, *whole))
    found = more_components(found, store(links))

    member = real.select("doc_id", "h1", "h2", F.col("n").alias("size")).join(classes, ["h1", "h2"]).where("n = size")
    member = member.join(found.withColumnRenamed("node", "cls"), "cls", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "cls")).alias("c"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("words").alias("n_words"), F.xxhash64("n", "h1", "h2").alias("set_hash"), *[f"c{i}" for i in range(len(carry))])
    return out.join(member, "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
