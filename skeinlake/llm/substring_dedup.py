"""Exact removal of repeated word windows by seed and extend.

Seeds are winnowed: of the k-word sequences in a window the one with the smallest hash (the
rightmost of equals) is the window's anchor, so equal windows have equal anchors. A run of
consecutive windows with one anchor is extended both ways to the span of words that they cover;
this span stands for all of them, and the spans are joined on their anchors:

* A span whose word sequence also stands earlier repeats as a whole. Batches see to that for their
  own documents first, so that a frequent passage leaves one row a batch and not one an occurrence.
* Spans with an anchor that only equal spans have hold nothing else that repeats.
* Where one anchor stands in different spans, the earliest of each is cut to the maximal repeats:
  its windows are compared one by one, and again batches see to their own repeats first.
* An anchor with many different spans in one batch is crowded: its spans there go straight to the
  comparison of windows, and one mark tells the other batches. So no anchor, span or window, however
  frequent, brings more than a bounded number of rows a batch to one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, mix, pieces, rolling, span_hash, store, text_buffers

_U, _I = np.uint64, np.int64
_PIECE = 1 << 21
_PLACE = (1 << 28) - 1
#: Different spans of one anchor in one batch beyond which it is crowded.
CROWD = 64
#: What a batch knows of a span: first of its kind, repeats one of the batch, of a crowded anchor, or
#: no span but the mark of such an anchor. Only the first and the mark are dealt by anchor.
_FIRST, _AGAIN, _CROWDED, _MARK = range(4)


def _runs(words: np.ndarray, at: np.ndarray, window: int, k: int):
    """Per run of windows with one anchor: document, first and last window start (in the document),
    anchor's place in the first window, and the hashes of anchor and span."""
    size = np.diff(at)
    none = np.zeros(0, _I)
    if len(words) < window or size.max(initial=0) < window:
        return none, none, none, none, none.view(_U), none.view(_U)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words)) - at[:-1][doc]
    grams = rolling(words, k)
    low = (grams & _U(~_PLACE & ((1 << 64) - 1))) | (_U(_PLACE) - place[: len(grams)].astype(_U))
    span = window - k + 1
    least, have = low, 1  # sliding minimum over `span` places by doubling
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    starts = np.flatnonzero(place[: len(words) - window + 1] + window <= size[doc[: len(words) - window + 1]])
    if not len(starts):
        return none, none, none, none, none.view(_U), none.view(_U)
    d = doc[starts]
    anchor = at[:-1][d] + (_U(_PLACE) - (least[starts] & _U(_PLACE))).astype(_I)
    # places beyond 2^28 wrap; the anchor is within the window whatever the text's length
    anchor += (starts - anchor + _PLACE) // (_PLACE + 1) * (_PLACE + 1)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1])])
    lo, hi = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    return d[new], lo - at[:-1][d[new]], hi - at[:-1][d[new]], anchor[new] - lo, grams[anchor[new]], span_hash(words, lo, hi + window)


_SPANS = "doc_id long, lo int, hi int, off int, anchor long, span long, state byte"


def _apart(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of its own for every place of every document, for rows that need not meet others."""
    return mix(doc.view(_U) * _U(0x9E3779B97F4A7C15) ^ mix(place.astype(_U)))


def _same_as_before(*sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_[0]):
        return np.zeros(0, bool)
    return np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in sorted_])]


def _spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row for each span, and one for each crowded anchor of a batch."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(_I)
            data, offsets = text_buffers(batch.column(1))
            parts = []
            for a, b in pieces(offsets, _PIECE):
                words, at = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                d, lo, hi, off, anchor, span = _runs(words, at, window, k)
                parts.append((ids[a:b][d], lo.astype(np.int32), hi.astype(np.int32), off.astype(np.int32), anchor, span))
            if not parts:
                continue
            doc, lo, hi, off, anchor, span = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((lo, doc, off, span, anchor))
            doc, lo, hi, off, anchor, span = (x[order] for x in (doc, lo, hi, off, anchor, span))
            state = np.where(_same_as_before(anchor, span, off), _AGAIN, _FIRST).astype(np.int8)
            edge = np.flatnonzero(~_same_as_before(anchor)) if len(anchor) else np.zeros(0, _I)
            of = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(anchor)]))
            crowded = np.bincount(of[state == _FIRST], minlength=len(edge)) > CROWD
            state[crowded[of] & (state == _FIRST)] = _CROWDED
            marks = anchor[edge[crowded]]
            alone = (state == _AGAIN) | (state == _CROWDED)
            # rows that are dealt apart can never be taken for one of the anchor that they fall on
            key, kind, value = np.where(alone, _apart(doc, lo), anchor), np.where(alone, -2 - off, off).astype(np.int32), np.where(alone, _U(0), span)
            none = np.zeros(len(marks), np.int32)
            doc, lo, hi = np.r_[doc, none.astype(_I)], np.r_[lo, none], np.r_[hi, none]
            kind, key, value = np.r_[kind, none - 1], np.r_[key, marks], np.r_[value, none.astype(_U)]
            state = np.r_[state, np.full(len(marks), _MARK, np.int8)]
            for i in range(0, len(doc), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[s], lo[s], hi[s], kind[s], key[s].view(_I), value[s].view(_I), state[s]))], [x.split()[0] for x in _SPANS.split(", ")])

    return docs.mapInArrow(rows, _SPANS)


def _windows(marked: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, start, off, anchor, hash, again of every window of the spans in `at` of each row; again:
    the same window stands earlier in the same piece of a batch."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(_I)
            data, offsets = text_buffers(batch.column(1))
            spans = batch.column(2)
            for a, b in pieces(offsets, _PIECE):
                words, at = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = spans.slice(a, b - a)
                flat = part.flatten()
                lo, hi, off = (flat.field(c).to_numpy(zero_copy_only=False).astype(_I) for c in ("lo", "hi", "off"))
                if not len(lo):
                    continue
                of = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                n = hi - lo + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                which, start, off = np.repeat(of, n), np.repeat(lo, n) + step, np.repeat(off, n) - step
                first = at[:-1][which] + start
                anchor, hashed, doc = rolling(words, k)[first + off], span_hash(words, first, first + window), ids[a:b][which]
                order = np.lexsort((start, doc, off, hashed, anchor))
                doc, start, off, anchor, hashed = (x[order] for x in (doc, start, off, anchor, hashed))
                again = _same_as_before(anchor, hashed, off)
                anchor, off = np.where(again, _apart(doc, start), anchor), np.where(again, -2, off)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (doc, start.astype(np.int32), off.astype(np.int32), anchor.view(_I), hashed.view(_I), again))], ["doc_id", "start", "off", "anchor", "hash", "again"])

    return marked.mapInArrow(rows, "doc_id long, start int, off int, anchor long, hash long, again boolean")


def repeated_spans(docs: DataFrame, window: int = 20, k: int = 6) -> DataFrame:
    """doc_id, lo, hi: ranges of window starts whose window also starts earlier (smaller doc_id, or
    the same document and an earlier start). docs: doc_id (not null, unique), text."""
    by = Window.partitionBy("anchor")
    same = Window.partitionBy("anchor", "span", "off").orderBy("doc_id", "lo")
    # dealt by anchor once; this order also serves the second window
    ranked = _spans(docs, window, k).repartition("anchor").withColumn("at", F.row_number().over(same))
    ranked = ranked.withColumns({"x": F.min("span").over(by), "y": F.max("span").over(by), "v": F.min("off").over(by), "w": F.max("off").over(by)})
    repeated = (F.col("state") == _AGAIN) | (F.col("state") == _FIRST) & (F.col("at") > 1)
    off = F.when(F.col("off") < 0, -2 - F.col("off")).otherwise(F.col("off"))
    ranked = ranked.where(F.col("state") != _MARK).where(repeated | (F.col("state") == _CROWDED) | (F.col("x") != F.col("y")) | (F.col("v") != F.col("w")))
    ranked = store(ranked.select("doc_id", "lo", "hi", off.cast("int").alias("off"), repeated.alias("repeated")))

    unclear = ranked.where("not repeated").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "off")).alias("at"))
    marked = docs.select("doc_id", "text").join(unclear, "doc_id")
    number = F.row_number().over(Window.partitionBy("anchor", "hash", "off").orderBy("doc_id", "start"))
    single = _windows(marked, window, k).withColumn("at", number).where("again or at > 1").select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return ranked.where("repeated").select("doc_id", "lo", "hi").union(single)


def _cut(with_ranges: DataFrame, window: int, keep: bool, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, (keep) kept: the text without the words that the
    ranges cover, and the carried columns, which follow the first three."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep else "")
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in with_ranges.schema.fields[3:])

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw = data.tobytes()
            ranges = batch.column(2)
            n_words, n_removed, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n = len(words)
                gone = 0
                if ranges[i].is_valid and n:
                    flat = ranges[i].values
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, flat.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(step, np.minimum(n, flat.field(1).to_numpy(zero_copy_only=False) + window), -1)
                    stay = np.cumsum(step[:n]) == 0
                    words = [words[j] for j in np.flatnonzero(stay).tolist()]
                    gone = n - len(words)
                text = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                sha.append(hashlib.sha256(text).hexdigest())
                if keep:
                    # a text that loses nothing stays as it is
                    kept.append(raw[offsets[i] : offsets[i + 1]].decode() if not gone else text.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep else []), *carry]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if keep else []) + batch.columns[3:], names)

    return with_ranges.mapInArrow(rows, schema)


def substring_dedup(docs: DataFrame, window: int = 20, k: int = 6, doc_id: str = "doc_id", text: str = "text", texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, (texts) kept and the columns in `carry` for every row
    of docs.

    Words are runs of bytes other than ASCII white space, unchanged; null: none. Every word that a
    window of `window` words covers goes if the same words also start earlier in the table
    (smaller doc_id, or same document and earlier start), judged on the input. kept: what stays,
    joined by one space (the text unchanged where nothing goes). Rows that repeat a doc_id or have
    none take their places by (doc_id, nulls last, text), so that one of two equal rows stays.
    Extra columns are ignored; an empty table gives an empty one.
    """
    other = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    names = [f"c{i}" for i in range(len(carry))]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *other)
    back = None
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        # new ids in the order of the rows: the sort deals ranges, so partitions follow each other
        docs = store(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").select(F.col("doc_id").alias("was"), F.monotonically_increasing_id().alias("doc_id"), "text", *names))
        back, docs = docs.select("doc_id", "was"), docs.select("doc_id", "text", *names)
    # the texts meet the spans and then the ranges in the same columns and rows, so that one shuffle of
    # them serves both joins; what is carried follows by itself
    texts_of = docs.select("doc_id", "text").where("doc_id is not null")
    ranges = repeated_spans(texts_of, window, k)
    per = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = texts_of.join(per, "doc_id", "left")
    if names:
        joined = joined.join(docs.select("doc_id", *names), "doc_id")
    joined = joined.select("doc_id", "text", "ranges", *names)
    out = _cut(joined, window, texts, tuple(names))
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"c{i}", c)
    if back is not None:
        out = out.join(back, "doc_id").select(F.col("was").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])
    return out
