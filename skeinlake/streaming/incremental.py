"""Streams: incremental re-indexing by micro-batch, and idle sessions."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..functions.blake3 import blake3_hash
from ..operators.chunks import chunk_files
from ..operators.graph import add_edges, contains_edges, valid_edges
from ..operators.health import collect_garbage
from ..operators.merge import check_fingerprint, forget_chunks, merge_chunks, merge_vectors, stamp_fingerprint
from ..operators.references import references, resolve
from ..operators.search import postings, trigram_postings
from ..plans.tables import apart, scratch, settled
from ..schema import VERSION, ConflictError, EngineError, IDLE_NOTICE
from ..sources.keywords import merge_segments, segments
from ..sources.snapshots import SnapshotStore
from ..sources.tree import changed_candidates, confirmed_changes, read_contents, refreshed_cache, scan_tree, under, vanished_files

TTL = "30 minutes"
CHANGED = "file_path string, content string, content_hash string, mtime_ns bigint, size_bytes bigint"
#: Times that a batch is made anew because another writer was first; segments of a bucket before they are merged.
TRIES, SEGMENTS = 8, 16
_EXTRACTED = ("CALLS", "IMPORTS", "RE_EXPORTS")


class Batch(NamedTuple):
    """What a batch did: files merged and failed, chunks of the merged ones, seconds, and the failed
    files with their errors (file_path, error)."""

    succeeded: int
    failed: int
    chunks: int
    seconds: float
    errors: list[tuple[str, str]]


class _Reads:
    """Reads of one state, which remember the buckets that went into a batch."""

    def __init__(self, store: SnapshotStore, state: dict | None) -> None:
        self.store, self.state, self.seen = store, state, {}

    def __call__(self, table: str, buckets: list[int]) -> DataFrame:
        self.seen.setdefault(table, set()).update(buckets)
        return self.store.read(table, buckets, self.state)

    def at(self, table: str, paths: DataFrame, column: str) -> tuple[DataFrame, list[int]]:
        """The rows of a table by the paths (path) that `column` names: their buckets alone are read."""
        buckets = self.store.buckets_of(paths.select(F.col("path").alias(column)), table)
        return self(table, buckets).join(apart(paths.select(F.col("path").alias(column))), column, "left_semi"), buckets


def _affected(reads: _Reads, touched: DataFrame) -> DataFrame:
    """path: the touched files, and all whose names may mean others now: those that refer to a touched
    file, or to one that passes names of such a file on, and so on."""
    paths = frontier = expanded = touched.select(F.col("file_path").alias("path"))
    if not reads.state or not reads.state["tables"].get("wanted"):
        reads.seen["wanted"] = set(range(reads.store.buckets))
        return paths
    while True:
        found, _ = reads.at("wanted", frontier, "target_path")
        found = found.groupBy(F.col("file_path").alias("path")).agg(F.max("passes_on").alias("passes_on"))
        next_ = Observation()
        known = expanded.withColumn("known", F.lit(True))
        found = found.join(apart(known), "path", "left").withColumn("goes_on", F.col("passes_on") & F.col("known").isNull())
        found = settled(found.observe(next_, F.count_if("goes_on").alias("n")))
        paths = paths.union(found.select("path"))
        if not next_.get["n"]:
            return settled(paths.distinct())
        frontier = found.where("goes_on").select("path")
        expanded = expanded.union(frontier)


def _passing(reads: _Reads, asked: DataFrame, touched: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references that pass on what may be asked for, step by step, and the paths (path) looked at."""
    on = found.where("passed_on is not null")
    passing, frontier = on, settled(asked.union(on).select(F.explode("targets").alias("path")).distinct())
    paths = frontier
    while True:
        n = Observation()
        more, _ = reads.at("references", frontier, "file_path")
        more = more.where("passed_on is not null").join(apart(touched), "file_path", "left_anti").select(*found.columns)
        more = settled(more.observe(n, F.count("*").alias("n")))
        if not n.get["n"]:
            return passing, paths
        passing, n = passing.union(more), Observation()
        frontier = more.select(F.explode("targets").alias("path")).distinct().join(apart(paths), "path", "left_anti")
        frontier = settled(frontier.observe(n, F.count("*").alias("n")))
        if not n.get["n"]:
            return passing, paths
        paths = paths.union(frontier)


def index_batch(
    store: SnapshotStore, files: DataFrame, now: Column | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
    removed: DataFrame | None = None, number: int | None = None, shown: int = 100, model: tuple[str, str, str, int] | None = None,
) -> Batch:
    """Chunk, embed and link the files (file_path, content, content_hash; mtime_ns and size_bytes if
    there) and merge chunks, vectors, references, edges, keywords and scan cache into the store: one commit.

    Of several versions of a file the newest counts (largest mtime_ns, of equal ones the larger
    content_hash). A file that cannot be cut is counted, its first `shown` errors are returned, and
    its old chunks stay; if all files fail, that is an error. removed (file_path): files that are no
    more lose their chunks. embed: chunks (id, content) to id, embedding; without it vectors only
    lose those of dead chunks. model (provider, name, revision, dimensions): kept by the first batch,
    and an error where a later one differs. number: of a stream's batch; one that is in the store
    already is not merged again.

    What a file refers to is kept, whether its target is there yet or not, so that the edges of files
    indexed earlier come, move and go with the files of a later batch: the edges are the same however
    files are dealt into batches. Only buckets of the files, and of those that refer to them, are read
    or rewritten. If another writer was first there, the batch is made anew from the new state.
    """
    for left in range(TRIES - 1, -1, -1):
        try:
            done = _index_batch(store, files, now, embed, removed, number, shown, model)
            break
        except ConflictError:
            if not left:
                raise
    if any(len(segments(store, t)) >= SEGMENTS for t in ("postings", "wanted")):
        try:
            merge_segments(store)
        except ConflictError:
            pass  # the other writer's next batch will
    return done


def _index_batch(store, files, now, embed, removed, number, shown, model) -> Batch:
    began = time.monotonic()
    state = store.current()
    if number is not None and state and state["batch"] is not None and number <= state["batch"]:
        return Batch(0, 0, 0, 0.0, [])
    if state and state["version"] != VERSION:
        raise EngineError("FULL_REINDEX_REQUIRED", f"state of version {state['version']}")
    now = F.current_timestamp() if now is None else now
    for c, kind in (("mtime_ns", "bigint"), ("size_bytes", "bigint")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    reads = _Reads(store, state)
    with scratch(store.spark):
        row = F.struct("content", "content_hash", "mtime_ns", "size_bytes")
        latest = files.groupBy("file_path").agg(F.max_by(row, F.struct("mtime_ns", "content_hash")).alias("r")).select("file_path", "r.*")
        # counted in the passes that write
        all_files, pieces = Observation(), Observation()
        latest = settled(latest.observe(all_files, F.count("*").alias("n")))
        cut = settled(chunk_files(latest, errors=True).observe(pieces, F.count("id").alias("chunks"), F.count_if(F.col("id").isNull()).alias("failed")))
        failed, n_chunks = pieces.get["failed"], pieces.get["chunks"]
        succeeded = all_files.get["n"] - failed
        bad = cut.where("id is null").select("file_path", "error")
        errors = [tuple(r) for r in bad.orderBy("file_path").limit(shown).collect()] if failed else []
        if failed and not succeeded:
            raise EngineError("INDEX_BATCH_FAILED", "; ".join(f"{p}: {e}" for p, e in errors[:3]))
        good = latest.join(apart(bad.select("file_path")), "file_path", "left_anti") if failed else latest
        new = cut.where("id is not null").drop("error").join(apart(good.select("file_path", "content_hash")), "file_path")
        touched = good.select("file_path")
        if removed is not None:
            touched = touched.union(removed.select("file_path"))
        touched = settled(touched.distinct())
        buckets = store.buckets_of(touched)

        before = reads("chunks", buckets)
        merged = settled(merge_chunks(before, new, touched, now))
        dead = merged.where("is_deleted").select("id")
        vectors = reads("vectors", buckets)
        made = embed(new.select("id", "content")) if embed is not None else vectors.where("false")

        found = settled(references(good))
        affected = _affected(reads, touched)
        others = affected.join(apart(touched.withColumnRenamed("file_path", "path")), "path", "left_anti")
        asked = reads.at("references", others, "file_path")[0].select(*found.columns).unionByName(found)
        passing, paths = _passing(reads, asked, touched, found)
        around = store.buckets_of(affected.union(paths).withColumnRenamed("path", "file_path"))
        nodes = reads("chunks", around).where("not is_deleted").join(apart(touched), "file_path", "left_anti").select("id", "file_path", "chunk_type")
        nodes = settled(nodes.union(merged.where("not is_deleted").select(*nodes.columns)))
        made_edges = valid_edges(add_edges(contains_edges(new), resolve(asked, passing, nodes)), nodes, store.read("ledger", state=state).select("id"))

        # edges to rewrite: of the affected files, and of any that end at a chunk which is no more
        ends = reads("edges_in", buckets).join(apart(dead.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
        moved = sorted({*store.buckets_of(affected.withColumnRenamed("path", "file_path")), *store.buckets_of(ends, "edges")})
        of = F.substring_index("source_id", "::", 1)
        kept = reads("edges", moved).withColumn("path", of).join(apart(affected.withColumn("hit", F.lit(True))), "path", "left")
        kept = kept.where(F.col("hit").isNull() | ~F.col("edge_type").isin(*_EXTRACTED)).select("source_id", "target_id", "edge_type")
        kept = kept.join(apart(new.select(F.col("id").alias("source_id"))), "source_id", "left_anti")
        for end in ("source_id", "target_id"):
            kept = kept.join(apart(dead.select(F.col("id").alias(end))), end, "left_anti")
        edges = settled(add_edges(kept.select("source_id", "target_id", "edge_type"), made_edges))

        cache = refreshed_cache(reads("scan_cache", buckets), good, now)
        if removed is not None:
            cache = cache.join(apart(removed.select("file_path")), "file_path", "left_anti")
        kept_references = reads("references", buckets).join(apart(touched), "file_path", "left_anti").select(*found.columns)
        wanted = found.select(F.explode("targets").alias("target_path"), "file_path", F.col("passed_on").isNotNull().alias("passes_on")).distinct()
        terms, tris, dead_terms, totals = _keywords(before, merged, touched, state["number"] + 1 if state else 0)
        tables = {"chunks": merged, "vectors": merge_vectors(vectors, made, merged), "edges": edges, "scan_cache": cache, "references": kept_references.unionByName(found)}
        if model is not None:
            stored = store.read("fingerprint", state=state)
            check_fingerprint(stored, *model)
            if stored.isEmpty():
                tables["fingerprint"] = stamp_fingerprint(stored, *model, now)
        store.commit(
            tables, {"edges": moved} | {t: buckets for t in ("chunks", "vectors", "scan_cache", "references")}, number, state,
            {"wanted": wanted, "postings": terms, "trigrams": tris, "dead_terms": dead_terms}, {t: sorted(b) for t, b in reads.seen.items()}, totals,
        )
        return Batch(succeeded, failed, n_chunks, time.monotonic() - began, errors)


def _keywords(before: DataFrame, merged: DataFrame, touched: DataFrame, segment: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(postings, trigrams, dead terms, changes of the sums) of a batch: only chunks whose content changed count."""
    live = lambda chunks, name: chunks.where("not is_deleted").join(apart(touched), "file_path", "left_semi").select("id", F.coalesce("content", F.lit("")).alias(name))
    both = live(before, "old").join(live(merged, "new"), "id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    size = lambda c: F.coalesce(F.sum(F.size(X.tokens(F.col(c)))), F.lit(0))
    sums = Observation()
    counted = [F.count("new").alias("fresh"), F.count("old").alias("gone"), size("new").alias("words"), size("old").alias("lost")]
    both = settled(both.where("old is not null or new is not null").observe(sums, *counted))
    got = sums.get
    fresh = both.where("new is not null").select("id", F.col("new").alias("content"), F.lit(False).alias("is_deleted"))
    at = F.lit(segment).cast("long").alias("segment")
    return postings(fresh).select("*", at), trigram_postings(fresh).select("tri", "id", at), both.where("old is not null").select("id", at), {"n": got["fresh"] - got["gone"], "words": got["words"] - got["lost"]}


def force_index(store: SnapshotStore, files: DataFrame, path: str = ".", **how) -> Batch:
    """Index the files at or below a path whether they changed or not; those of the store that are no
    more there lose their chunks."""
    mine = under(files, path)
    known = under(store.read("scan_cache").select("file_path"), path)
    return index_batch(store, mine, removed=known.join(mine.select("file_path"), "file_path", "left_anti"), **how)


def sync_tree(store: SnapshotStore, root: str, path: str = ".", force: bool = False, hash_: Callable[[Column], Column] = blake3_hash, **how) -> Batch:
    """Bring the store up to date with a file tree, or with the part of it at or below a path: scan,
    read what may have changed, and index what did; files that are no more lose their chunks. force:
    index all files again. hash_: of the contents; another one than last time takes all files for changed."""
    listing = under(scan_tree(store.spark, root), path)
    known = under(store.read("scan_cache"), path)
    content = F.col("content")
    changed = confirmed_changes(read_contents(changed_candidates(listing, known, force)), hash_(content), force)
    # what is not UTF-8 in a file is replaced in its text alone
    files = changed.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).select("file_path", "content", "content_hash", "mtime_ns", "size_bytes")
    gone = vanished_files(listing, known)
    with scratch(store.spark):
        files, gone = settled(files), settled(gone)
        if files.isEmpty() and gone.isEmpty():
            return Batch(0, 0, 0, 0.0, [])
        return index_batch(store, files, removed=gone, **how)


def collect(store: SnapshotStore, days: int, now: Column, keep: int = 1) -> tuple[int, int]:
    """(chunks forgotten, bytes freed): tombstones deleted more than `days` before now go, with their
    edges and vectors, and then all states but the newest and what these alone held."""
    state = store.current()
    if state is None:
        return 0, 0
    with scratch(store.spark):
        kept, gone = collect_garbage(store.read("chunks", state=state), days, now)
        n = Observation()
        gone = settled(gone.observe(n, F.count("*").alias("n")))
        if n.get["n"]:
            edges, vectors = forget_chunks(store.read("edges", state=state), store.read("vectors", state=state), gone)
            store.commit({"chunks": kept, "edges": edges, "vectors": vectors}, base=state)
    return n.get["n"], store.drop(keep)[1]


def index_stream(spark: SparkSession, source: str, store: SnapshotStore, checkpoint: str, schema: str = CHANGED, done: Callable[[Batch], None] | None = None, **how) -> StreamingQuery:
    """Index JSON rows of changed files as they arrive under source. The checkpoint numbers the
    batches and the store knows the last one merged, so each is merged once. done: gets each batch's
    counters."""
    files = spark.readStream.schema(schema).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            found = index_batch(store, batch, number=number, **how)
            if done is not None:
                done(found)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Indexer:
    """An index stream that can be paused and resumed: what was merged stays, what comes meanwhile
    waits under the source."""

    def __init__(self, *args, **how) -> None:
        self._args, self._how, self.query = args, how, None

    def resume(self) -> Indexer:
        if self.query is None or not self.query.isActive:
            self.query = index_stream(*self._args, **self._how)
        return self

    def pause(self) -> Indexer:
        if self.query is not None:
            self.query.stop()
        return self

    def heartbeat(self) -> dict | None:
        """Number, time and rows of the last batch begun, None before the first."""
        last = self.query.lastProgress if self.query is not None else None
        return None if last is None else {"batch": last["batchId"], "timestamp": last["timestamp"], "rows": last["numInputRows"]}


def session_windows(events: DataFrame, ttl: str = TTL, late: str | None = None) -> DataFrame:
    """user_id, start, end, n: sessions that end after `ttl` without an event; batch or stream."""
    if late is not None:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.session_window("ts", ttl).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_sessions(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, ttl: str = TTL, late: str = "10 minutes") -> StreamingQuery:
    """Closed sessions of a stream, each once, when the watermark has passed their end."""
    return session_windows(events, ttl, late).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reap_stream(turns: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """session_id, status, role, content, ts: each session of a stream of turns (session_id, ts) once, when
    the watermark has passed its newest turn by `minutes`: its new status and the turn that says so. A
    turn after that opens it again; turns behind the watermark are too late to count. A session keeps
    one timestamp as state, and a timer."""
    ttl = minutes * 60_000

    def rest(key, batches, state: GroupState):
        columns = ["session_id", "status", "role", "content", "ts"]
        if state.hasTimedOut:
            (newest,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "idle", "system", IDLE_NOTICE, pd.Timestamp(newest + ttl, unit="ms"))], columns=columns)
            return
        newest = max([*(int(b["at"].max()) for b in batches), *(state.get if state.exists else ())])
        state.update((newest,))
        state.setTimeoutTimestamp(newest + ttl)

    # the newest turn in whole milliseconds
    dealt = turns.withWatermark("ts", late).select("session_id", "ts", F.unix_millis("ts").alias("at")).groupBy("session_id")
    out = f"session_id {turns.schema['session_id'].dataType.simpleString()}, status string, role string, content string, ts timestamp"
    return dealt.applyInPandasWithState(rest, out, "newest long", "append", GroupStateTimeout.EventTimeTimeout)


def crash_allowed(times: DataFrame, window_s: int = 600, most: int = 3) -> DataFrame:
    """ts, crashes, restart: whether fewer than `most` crashes lie in the window up to each."""
    recent = Window.partitionBy("worker").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-window_s, 0)
    return times.withColumn("crashes", F.count("*").over(recent)).withColumn("restart", F.col("crashes") < most)
