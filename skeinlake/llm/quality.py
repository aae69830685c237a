"""Document quality by Bradley-Terry pairwise ranking.

A document's utility is linear in features of its text. Of a pair of labelled documents the better
one wins with probability sigmoid(difference of utilities), so the weights come from logistic loss
on feature differences. The threshold is the quantile of the training utilities that leaves the
labelled share above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import hash_words, only, pieces, store, text_buffers

_U = np.uint64


def _classes() -> np.ndarray:
    """A class for each byte: the features are the shares of the classes in the text."""
    of = np.full(256, 8, np.int64)
    of[97:123], of[65:91], of[48:58], of[128:], of[32], of[[9, 11, 12, 13]], of[10] = 0, 1, 2, 3, 4, 5, 6
    of[[*map(ord, ".,;:'\"-()?")]] = 7
    for i, c in enumerate("!|%*#$&@/<>{}[]=_+~^\\`"):
        of[ord(c)] = 9 + i
    of[:9] = of[14:32] = of[127] = 31
    return of


CLASSES = _classes()
N_CLASSES = 32
NAMES = [f"class{i}" for i in range(N_CLASSES)] + [
    "log_words", "word_length", "distinct_words", "top_word", "upper_words", "symbol_words", "repeated_lines", "line_words", "sentence_ends", "digits_in_words", "repeated_grams", "stutter", "empty",
]


def _document_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    out[:, -1] = size == 0
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    hist = np.bincount(doc * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(hist / np.maximum(1, size)[:, None])
    words, at = hash_words(data, offsets, lower=True)
    count = np.diff(at)
    many = np.maximum(1, count)
    visible = size - hist[:, 4] - hist[:, 5] - hist[:, 6]
    out[:, N_CLASSES] = np.log1p(count)
    out[:, N_CLASSES + 1] = np.minimum(40, visible / many)
    letters = hist[:, 0] + hist[:, 1] + hist[:, 3]
    out[:, N_CLASSES + 4] = hist[:, 1] / np.maximum(1, letters)
    out[:, N_CLASSES + 5] = np.minimum(4, hist[:, 8:31].sum(1) / many)
    out[:, N_CLASSES + 7] = np.log1p(count / (1 + hist[:, 6]))
    stops = np.bincount(doc[(data == 46) | (data == 63)], minlength=n)
    out[:, N_CLASSES + 8] = np.minimum(1, stops / many)
    out[:, N_CLASSES + 9] = np.minimum(4, hist[:, 2] / many)
    pairs = words[:-3] * _U(3) + words[1:-2] * _U(5) + words[2:-1] * _U(7) + words[3:] * _U(11) if len(words) > 3 else words[:0]
    ends = data == 10
    for i in np.flatnonzero(count):
        w = words[at[i] : at[i + 1]]
        out[i, N_CLASSES + 11] = np.count_nonzero(w[1:] == w[:-1]) / len(w)
        w = np.sort(w)
        edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
        out[i, N_CLASSES + 2] = (len(edge) - 1) / np.sqrt(len(w))
        out[i, N_CLASSES + 3] = np.diff(edge).max() / len(w)
        if len(w) > 3:
            g = pairs[at[i] : at[i + 1] - 3]
            out[i, N_CLASSES + 10] = 1 - len(np.unique(g)) / len(g)
        if hist[i, 6]:
            lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            lines = [x for x in lines if x.strip()]
            out[i, N_CLASSES + 6] = 1 - len(set(lines)) / max(1, len(lines))
    return out


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x (array<float>, one for each of NAMES) from whole texts alone; null: as empty."""

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            x = [_document_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, 1 << 20)]
            flat = np.concatenate(x).astype(np.float32).ravel() if x else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, x array<float>")


def pair_loss(w: np.ndarray, d: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss of the pairs' feature differences (better less worse) with a ridge, its
    gradient and its second derivative."""
    u = np.clip(d @ w, -40, 40)
    p = 1 / (1 + np.exp(u))
    loss = float(np.log1p(np.exp(-u)).mean() + ridge / 2 * (w @ w))
    return loss, ridge * w - (d * p[:, None]).mean(0), (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))


class Ranker:
    """Utilities u(x) = w . (x - mean) / scale and the threshold; score = sigmoid(gain * (u - at)). The
    threshold is the middle of the gap below which the training rows lie as often as label 0 does."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1.0, seed: int = 11) -> None:
        x = np.asarray(x, np.float64).reshape(-1, len(NAMES))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
        self.w, self.at, self.gain = np.zeros(len(NAMES)), 0.0, 1.0
        z = (x - self.mean) / self.scale
        up, down = z[good == 1], z[good != 1]
        if not len(up) or not len(down):  # one label or none: nothing to rank by
            self.at = -1.0 if len(up) else 1.0 if len(down) else 0.0
            return
        draw = np.random.default_rng(seed)
        # every document meets several of the other label
        n = max(pairs, len(up), len(down))
        d = up[draw.permutation(np.arange(n) % len(up))] - down[draw.permutation(np.arange(n) % len(down))]
        for _ in range(40):  # Newton's method
            _, g, h = pair_loss(self.w, d, ridge / 1000)
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        u = z @ self.w
        share = len(down) / len(z)
        # the middle of the gap at the quantile
        s = np.sort(u)
        k = min(len(s) - 1, max(1, round(share * len(s))))
        self.at = float((s[k - 1] + s[k]) / 2)
        self.gain = float(2.0 / max(1e-6, np.std(u)))

    def score(self, x: np.ndarray) -> np.ndarray:
        u = ((np.asarray(x, np.float64) - self.mean) / self.scale) @ self.w
        return 1 / (1 + np.exp(-np.clip(self.gain * (u - self.at), -35, 35)))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 12_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    labels: doc_id, quality (1 good; other numbers not; null: no label); of rows that repeat a
    doc_id the mean decides (0.5 and more is good). Learned from labelled rows whose crc32(doc_id
    as text) mod 3 is not 1, `sample` of them at most, those with the smallest hashes: the bound on
    what the driver gets. Null and empty texts are scored like others. A null doc_id is not held
    out and never labelled. Repeated rows are all scored. Without labels every score is 0.5.
    """
    with scratch(docs.sparkSession) as kept:
        out = store(_scores(docs, labels, sample, doc_id, text, label))
        kept.append(out)
    return out


def _scores(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str, label: str) -> DataFrame:
    features = store(text_features(docs, doc_id, text))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("good"))
    known = known.where(~held)
    order = F.xxhash64("doc_id")
    n = features.select("doc_id").join(known, "doc_id").count()
    # the share of the hashes that holds a bit more than the sample: else every task of the sort
    # would send the driver a whole sample of its own
    part = F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / max(1, n)))
    drawn = features.join(known, "doc_id").where(part).orderBy(order, "doc_id").limit(sample).select("x", "good").toPandas()
    ranker = Ranker(np.array(drawn["x"].tolist()), drawn["good"].to_numpy())

    def rows(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(x))], ["doc_id", "score"])

    out = features.mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
