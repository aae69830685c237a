"""Hybrid retrieval: nearest vectors and keyword ranking fused by weighted reciprocal rank."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from functools import reduce
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..plans.tables import apart, settled
from ..schema import NOTES

#: Candidates of each retriever; results of the fusion; constant of reciprocal ranks.
CANDIDATES, FUSED, RRF_K, DEFAULT_LIMIT, LARGEST_LIMIT = 30, 12, 60, 8, 20
#: (vector, keyword) weights by intent.
WEIGHTS = {"semantic": (0.7, 0.3), "structural": (0.3, 0.7)}
#: Tokens that are counted at a time; one row at least.
PIECE = 1 << 20


def live(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("is_deleted"))


def lookup(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The live chunks of a ranked id list (id, rank, ...): missing and deleted ones drop out and
    the ranks close up. The list is a top-k and so has a bound of its own: it is broadcast."""
    found = live(chunks).join(F.broadcast(ranked), "id").withColumn("language", X.language_of(F.col("file_path")))
    return found.withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = CANDIDATES) -> DataFrame:
    """id, distance, rank of the `limit` vectors with the smallest Euclidean distance (ties by id).
    The order and limit are one TakeOrderedAndProject: each task keeps `limit` rows."""
    scored = vectors.select("id", V.l2_distance(F.col("embedding"), V.literal(query)).alias("distance")).where("distance is not null")
    best = scored.orderBy("distance", "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def nearest_batch(vectors: DataFrame, queries: DataFrame, limit: int = CANDIDATES, rows: int = 4096, asked: int = 512) -> DataFrame:
    """query_id, id, distance, rank for every row of queries (query_id, query): a stated query set
    against all rows. Blocks of both meet, one row each, and each pair of blocks gives its best `limit`
    a query; so neither side need fit in a worker, and no key gathers them. Vectors of different lengths
    have no distance, nor have null or empty ones or those with a component that is no finite number.
    Products of whole blocks bound the distances; those that may be among the best are computed exactly."""
    kind = queries.schema["query_id"].dataType.simpleString()
    a, b = _blocks(vectors, "id", "embedding", rows, "string"), _blocks(queries, "query_id", "query", asked, kind)
    # blocks are few and large: each side is dealt out evenly, whatever the files that it came from
    many = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    a, b = a.repartition(many), b.repartition(8)
    pairs = a.crossJoin(b.select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data")))

    def best(batches):
        for batch in batches:
            for ids, dim, data, q_ids, q_dim, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                if dim != q_dim:
                    continue
                x, y = (np.frombuffer(d, np.float64).reshape(-1, dim) for d in (data, q_data))
                ids, out, k = np.array(ids, object), [[], [], []], min(limit, len(x))
                with np.errstate(over="ignore", invalid="ignore"):
                    xx, yy = (x * x).sum(1), (y * y).sum(1)
                    rough = yy[:, None] + xx[None, :] - 2.0 * (y @ x.T)
                    slack = 1e-9 * dim * (yy + xx.max())  # more than rounding takes
                for q, v, near, more in zip(q_ids, y, rough, slack):
                    at = np.arange(len(x))
                    if np.isfinite(more) and np.isfinite(near).all():
                        at = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1] + more)
                    distance = np.sqrt(((x[at] - v) ** 2).sum(1))
                    held = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                    at, distance = at[held], distance[held]
                    first = np.lexsort((ids[at].astype(str), distance))[:limit]
                    for kept, new in zip(out, ([q] * len(first), ids[at[first]].tolist(), distance[first].tolist())):
                        kept += new
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("q_ids").type.value_type), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["query_id", "id", "distance"])

    found = pairs.mapInArrow(best, f"query_id {kind}, id string, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _blocks(vectors: DataFrame, id_: str, vector: str, most: int, kind: str) -> DataFrame:
    """ids, dim, data: the vectors of one length in blocks of at most `most`, as doubles in bytes; a
    vector that is null, empty or has a component that is null or not finite is left out."""

    def pack(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                for lo in range(0, len(at), most):
                    part = batch.take(pa.array(at[lo : lo + most]))
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([d], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["ids", "dim", "data"])

    good = vectors.select(F.col(id_).cast(kind).alias("id"), V.doubles(F.col(vector)).alias("v"), F.size(vector).alias("dim"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return good.where((F.col("dim") > 0) & ~F.exists("v", odd)).mapInArrow(pack, f"ids array<{kind}>, dim int, data binary")


def postings(chunks: DataFrame) -> DataFrame:
    """tok, id, tf, doc_len: a row for each term of each live chunk."""
    words = live(chunks).select("id", X.tokens(F.col("content")).alias("toks"))
    words = words.select("id", F.size("toks").alias("doc_len"), F.explode("toks").alias("tok"))
    return words.groupBy("tok", "id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places from, to of rows with about `most` in all, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """tok, ids, tf, doc_len: the postings of the live chunks, a row for each term of a piece of the
    chunks, so that a term has few rows. Narrow, but for ids that several rows have: these are counted
    together, as rows of one."""
    rows = live(chunks)
    repeated = settled(rows.groupBy("id").count().where("count > 1").select("id"))
    schema = "tok string, ids array<string>, tf array<bigint>, doc_len array<int>"

    def count(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            for at, end in _cut(sizes, PIECE):
                ids, toks = batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at)
                n, length = end - at, sizes[at:end]
                coded = toks.flatten().dictionary_encode()
                held = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length)
                held, tf = np.unique(held, return_counts=True)
                code, row = np.divmod(held, n)
                starts = pa.array(np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)), pa.int32())
                lists = (ids.take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(length[row], pa.int32()))
                yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.ListArray.from_arrays(starts, x) for x in lists)], ["tok", "ids", "tf", "doc_len"])

    once = rows if repeated.isEmpty() else rows.join(apart(repeated), "id", "left_anti")
    blocks = once.select("id", X.tokens(F.col("content")).alias("toks")).where(F.size("toks") > 0).mapInArrow(count, schema)
    if once is rows:
        return blocks
    rest = postings(rows.join(apart(repeated), "id", "left_semi"))
    return blocks.unionByName(rest.select("tok", F.array("id").alias("ids"), F.array("tf").alias("tf"), F.array("doc_len").alias("doc_len")))


class KeywordIndex(NamedTuple):
    """Postings settled in blocks (see posting_blocks), in folders by a hash of the term, sorted by term
    within; totals: n, avg_len of the live chunks, those without a term too."""

    blocks: DataFrame
    totals: DataFrame
    buckets: int

    @property
    def postings(self) -> DataFrame:
        """tok, id, tf, doc_len."""
        return _apiece(self.blocks)

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of these terms: their folders alone are read."""
        one = lambda t: (F.col("bucket") == _bucket(F.lit(t), self.buckets)) & (F.col("tok") == t)
        return _apiece(self.blocks.where(reduce(lambda a, b: a | b, map(one, terms), F.lit(False))))


def _apiece(blocks: DataFrame) -> DataFrame:
    return blocks.select("tok", F.inline(F.arrays_zip("ids", "tf", "doc_len")).alias("id", "tf", "doc_len"))


def _bucket(tok: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(buckets)).cast("int")


def keyword_index(chunks: DataFrame, buckets: int = 32) -> KeywordIndex:
    """The chunks tokenised once, for any number of keyword queries. A frequent term is split over
    several files of its folder."""
    dealt = posting_blocks(chunks).withColumn("bucket", _bucket(F.col("tok"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "tok")
    held = settled(dealt, by="bucket")
    n = live(chunks).agg(F.count("*").alias("n"))
    words = held.agg(F.coalesce(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).alias("words"))
    return KeywordIndex(held, settled(n.crossJoin(words).select("n", F.try_divide("words", "n").alias("avg_len"))), buckets)


class Keywords(Protocol):
    """An index over chunks: the postings of some terms, and n, avg_len of the live chunks."""

    totals: DataFrame

    def of(self, terms: Sequence[str]) -> DataFrame: ...


def keyword_search(chunks: DataFrame | Keywords, query: str, limit: int = CANDIDATES) -> DataFrame:
    """id, score, rank: BM25 (k1 1.2, b 0.75, inverse frequency at least 1e-6) of the live chunks that
    hold all terms of the query; a null content is an empty one. chunks: an index over them (one of a
    session or of a store), or the chunks themselves, which are then tokenised for this query."""
    terms = X.query_terms(query)
    if not isinstance(chunks, DataFrame):
        hits, totals = chunks.of(terms), chunks.totals
    else:
        words = live(chunks).select("id", X.tokens(F.coalesce("content", F.lit(""))).alias("toks"))
        totals = words.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avg_len"))
        each = words.select("id", F.size("toks").alias("doc_len"), F.explode(F.filter("toks", lambda t: t.isin(*terms))).alias("tok"))
        hits = each.groupBy("tok", "id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    if not terms:
        return hits.where("false").select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    frequency = hits.agg(*[F.count_if(F.col("tok") == t).alias(f"df{i}") for i, t in enumerate(terms)])
    per = hits.groupBy("id").agg(F.count("*").alias("has"), F.first("doc_len").alias("len"), *[F.max(F.when(F.col("tok") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)])
    both = per.where(F.col("has") == len(terms)).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(frequency))  # one row each

    def part(i: int):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        return idf * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))

    scored = both.select("id", reduce(lambda a, b: a + b, map(part, range(len(terms)))).alias("score"))
    return _top(scored, limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def trigram_postings(chunks: DataFrame) -> DataFrame:
    """tri, id: a row for each run of three characters of each live chunk, in lower case."""
    return live(chunks).select("id", F.explode(X.trigrams(F.coalesce("content", F.lit("")))).alias("tri"))


class Candidates(Protocol):
    """An index over chunks: the ids of those that hold all trigrams, and these chunks themselves."""

    def holding(self, tris: Sequence[str]) -> DataFrame: ...

    def chunks_of(self, ids: DataFrame, chunks: DataFrame) -> DataFrame: ...


def all_of(hits: DataFrame, tris: Sequence[str]) -> DataFrame:
    """id of the chunks that each of the trigrams stands in, from tri, id: lists are intersected by a count."""
    return hits.groupBy("id").agg(F.count_distinct("tri").alias("n")).where(F.col("n") == len(tris)).select("id")


def _runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """points, run, row: the distinct runs of three code points in texts, by run and then by text. run:
    the places in `points` of the three, a number to the base len(points); row: the place of the text."""
    length = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    points = np.flatnonzero(np.bincount(flat, minlength=1))
    n, d = len(texts), len(points)
    if n > 1 and d**3 * n >= 1 << 63:
        half = n // 2
        for part, first in ((texts[:half], 0), (texts[half:], half)):
            for points, run, row in _runs(part):
                yield points, run, row + first
        return
    place = np.zeros(int(points[-1]) + 1 if d else 1, np.int64)
    place[points] = np.arange(d)
    c, row = place[flat], np.repeat(np.arange(n), length)
    inside = row[2:] == row[:-2]
    held = np.unique((((c[:-2] * d + c[1:-1]) * d + c[2:]) * n + row[2:])[inside]) if len(c) > 2 else np.zeros(0, np.int64)
    run, row = np.divmod(held, n)
    yield points, run, row


def trigram_blocks(chunks: DataFrame) -> DataFrame:
    """tri, ids: trigram_postings, a row for each trigram of a piece of the chunks. Narrow."""

    def cut(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in _cut(sizes, 2 * PIECE):
                ids = batch.column(0).slice(at, end - at)
                for points, run, row in _runs(batch.column(1).slice(at, end - at).to_pylist()):
                    first = np.flatnonzero(np.diff(run, prepend=-1))
                    a, bc = np.divmod(run[first], len(points) ** 2)
                    b, c = np.divmod(bc, len(points))
                    tri = np.stack([points[x] for x in (a, b, c)], 1).astype("<u4").tobytes().decode("utf-32-le")
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(run)), pa.int32()), ids.take(pa.array(row)))
                    yield pa.RecordBatch.from_arrays([pa.array([tri[i : i + 3] for i in range(0, len(tri), 3)], pa.string()), lists], ["tri", "ids"])

    low = live(chunks).select("id", F.lower("content").alias("low"))
    return low.where(F.length("low") > 2).mapInArrow(cut, "tri string, ids array<string>")


class TrigramIndex(NamedTuple):
    """Trigram postings settled in blocks, in folders by a hash of the trigram, sorted by trigram within."""

    blocks: DataFrame
    buckets: int

    def holding(self, tris: Sequence[str]) -> DataFrame:
        one = lambda t: (F.col("bucket") == _bucket(F.lit(t), self.buckets)) & (F.col("tri") == t)
        return all_of(self.blocks.where(reduce(lambda a, b: a | b, map(one, tris))).select("tri", F.explode("ids").alias("id")), tris)

    def chunks_of(self, ids: DataFrame, chunks: DataFrame) -> DataFrame:
        return live(chunks).join(ids, "id", "left_semi")


def trigram_index(chunks: DataFrame, buckets: int = 32) -> TrigramIndex:
    """The trigrams of the chunks, for any number of substring queries."""
    dealt = trigram_blocks(chunks).withColumn("bucket", _bucket(F.col("tri"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "tri")
    return TrigramIndex(settled(dealt, by="bucket"), buckets)


def substring_search(chunks: DataFrame, query: str, limit: int = CANDIDATES, index: Candidates | None = None) -> DataFrame:
    """id, score, rank: live chunks that contain the phrase whatever its case; phrases under three
    characters find nothing. Score: 1 / (1 + place of the first hit), so early hits come first.
    index: over the trigrams of these chunks; only chunks that hold all of the phrase's are then looked at."""
    phrase = X.query_phrase(query)
    low = F.lower("content")
    if phrase is None or len(phrase) < 3:
        return live(chunks).where("false").select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    rows = live(chunks)
    if index is not None:
        tris = chunks.sparkSession.range(1).select(X.trigrams(F.lit(phrase))).first()[0]
        rows = index.chunks_of(index.holding(tris), chunks)
    hit = F.instr(low, phrase.lower())
    return _top(rows.where(low.contains(phrase.lower())).select("id", (1.0 / (1.0 + hit)).alias("score")), limit)


def routed_search(chunks: DataFrame, query: str, limit: int = CANDIDATES, index: Keywords | None = None) -> tuple[DataFrame, str]:
    """(hits, route): keyword hits if there are any; else the substring's where the query looks like
    a name or path; else nothing. The hits, at most `limit`, are settled to decide. An index that has
    trigrams too (of a store) serves both."""
    hits = settled(keyword_search(index or chunks, query, limit))
    if not hits.isEmpty():
        return hits, "kw"
    if _looks_like_name(query):
        return substring_search(chunks, query, limit, index if hasattr(index, "holding") else None), "sub"
    return hits, "none"


def _looks_like_name(query: str) -> bool:
    trimmed = query.strip()
    return (len(trimmed) > 2 and trimmed[0] == trimmed[-1] == '"') or any(x in trimmed for x in ("::", "/", "."))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, intent: str = "semantic", limit: int = FUSED) -> DataFrame:
    """id, score, vec_rank, fts_rank, rank of the best `limit` by weighted reciprocal rank; of equal
    scores those with the better vector rank, then keyword rank, come first."""
    wv, wf = WEIGHTS[intent]
    both = vector_hits.select("id", F.col("rank").alias("vec_rank")).join(keyword_hits.select("id", F.col("rank").alias("fts_rank")), "id", "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part(wv, "vec_rank") + part(wf, "fts_rank"))
    order = [F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), F.asc("id")]
    return scored.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(candidates: DataFrame, logit: Callable | None, most_ms: int | None = None) -> tuple[DataFrame, bool]:
    """(candidates, used): scores replaced by sigmoid(logit(content)) and ranked anew; without a
    reranker, or where it takes longer than most_ms, the order stays and used is False. logit:
    Column -> Column, a pandas UDF for a model."""
    if logit is None:
        return candidates, False
    scored = candidates.withColumn("before", F.col("rank")).withColumn("score", V.sigmoid(logit(F.col("content"))))
    ranked = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "before"))).drop("before")
    if most_ms is None:
        return ranked, True
    tag, spark = f"rerank-{uuid.uuid4().hex}", candidates.sparkSession
    answer: list[DataFrame] = []

    def work() -> None:
        spark.addTag(tag)
        with suppress(Exception):  # cancelled, or failed: the order stays
            answer.append(settled(ranked))

    thread = InheritableThread(target=work)
    thread.start()
    thread.join(most_ms / 1000)
    if answer:
        return answer[0], True
    spark.interruptTag(tag)
    return candidates, False


def hybrid_search(
    chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], intent: str = "semantic",
    limit: int = DEFAULT_LIMIT, logit: Callable | None = None, index: Keywords | None = None, most_ms: int | None = None,
) -> tuple[DataFrame, bool]:
    """(results, reranker used): both retrievers' best 30, of which live chunks keep their order, are
    fused to 12, reranked, and cut to `limit` (1 to 20). Results keep the ranks by which they were
    fused (vec_rank, fts_rank)."""
    if not 1 <= limit <= LARGEST_LIMIT:
        raise ValueError(f"limit must be from 1 to {LARGEST_LIMIT}")
    found = lookup(nearest(vectors, query_vector), chunks)
    words, _ = routed_search(chunks, query, index=index)
    fused = fuse(found.select("id", "rank"), words.select("id", "rank"), intent)
    results, used = rerank(lookup(fused, chunks), logit, most_ms)
    return results.where(F.col("rank") <= limit), used


def render(results: DataFrame, score: str | None = "score") -> DataFrame:
    """text: one row, the results as numbered blocks in the order of rank."""
    shown = F.col(score) if score else F.lit(1.0)
    head = F.format_string("--- CHUNK %d score=%.4f %s [%s:%d-%d]", F.col("rank"), shown, F.col("id"), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    block = F.concat(head, F.lit("\n"), F.col("content"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("text"))


def investigate(
    chunks: DataFrame, vectors: DataFrame, edges: DataFrame, query: str, intent: str = "semantic", limit: int = DEFAULT_LIMIT,
    embed: Callable[[str], Sequence[float]] | None = None, logit: Callable | None = None, index: Keywords | None = None,
) -> tuple[DataFrame | None, list[str]]:
    """(results, notes). structural: the graph around the id `query`; semantic: hybrid search."""
    from .graph import neighbourhood

    if intent == "structural":
        found = lookup(neighbourhood(edges, query).withColumnRenamed("node_id", "id").withColumn("rank", F.row_number().over(Window.orderBy("depth", "id"))), chunks)
        return (None, [NOTES["NO_GRAPH_EDGES"]]) if found.isEmpty() else (found, [])
    if live(chunks).isEmpty():
        return None, [NOTES["INDEX_EMPTY"]]
    if embed is None:
        raise ValueError("a semantic query needs embed")
    results, used = hybrid_search(chunks, vectors, query, embed(query), intent, limit, logit, index)
    if results.isEmpty():
        return None, [NOTES["NO_MATCH"]]
    return results, [] if used else [NOTES["RERANKER_UNAVAILABLE"]]
