"""The trie of conversation prefixes, from chained digests.

Turn d of a conversation turns the digest of its first d - 1 turns into that of its first d, so a
prefix is one 32-byte value and no text is shuffled. Every conversation is exploded into its
prefixes; grouped by (depth, digest) they are the nodes. The ancestors of a node are the shorter
prefixes of any of its members, so the same rows carry what is summed over subtrees: a node belongs
to its smallest member, and each conversation brings every ancestor the sum over those of its own
nodes that lie below, one number a row. All sums have a partial sum on the map side, and their rows
number as many as the prefixes, however deep a conversation is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import store

#: Conversations c and c - c % GROUP share a beginning of crc32(c) % HEADS turns.
GROUP, HEADS = 100, 6
#: The digest of no turns, and the ids that one row of a node's list holds.
ROOT, IDS = sha256(b"").digest(), 4096

_PREFIX = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_chars", pa.int64()), ("before", pa.int64()), ("last", pa.bool_())]
)
_PREFIX_SQL = "conv_id long, depth long, node binary, parent binary, n_chars long, before long, last boolean"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the length of the role sets role and text apart."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.sha2(said, 256))


def shared_turns(conv_id: int, heads: int = HEADS) -> int:
    """How many turns of a conversation come from the first of its group."""
    return zlib.crc32(str(conv_id).encode()) % heads


class _Chain:
    """The prefixes of one conversation, turn by turn; the newest waits for the next."""

    __slots__ = ("conv", "depth", "node", "parent", "n_chars", "before")

    def __init__(self, conv: int) -> None:
        self.conv, self.depth, self.node, self.parent, self.n_chars, self.before = conv, 0, ROOT, None, 0, 0

    def row(self, last: bool) -> tuple:
        return self.conv, self.depth, self.node, self.parent, self.n_chars, self.before, last

    def add(self, digest: bytes, n_chars: int) -> tuple:
        done = self.row(False)
        self.depth, self.parent, self.before = self.depth + 1, self.node, self.before + self.n_chars
        self.node, self.n_chars = sha256(self.node + digest).digest(), n_chars
        return done


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PREFIX)], schema=_PREFIX)


def _chains(heads: int):
    """Turns in the order of (base, the base itself first, conv_id, turn) -> every prefix. A task
    holds the first turns of one base and the newest prefix of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, head, chain, skip, rows = None, [], None, 0, []
        for batch in batches:
            for b, c, digest, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if chain is None or c != chain.conv or b != base:
                    if chain is not None:
                        rows.append(chain.row(True))
                    if b != base:
                        base, head = b, []
                    chain, skip = _Chain(c), 0
                    if c != b:
                        skip = shared_turns(c, heads)
                        rows += [chain.add(*turn) for turn in head[:skip]]
                if c == b and len(head) < heads - 1:
                    head.append((digest, n))
                if skip:
                    skip -= 1
                else:
                    rows.append(chain.add(digest, n))
                if len(rows) >= 8192:
                    yield _batch(rows)
                    rows = []
        if chain is not None:
            rows.append(chain.row(True))
        if rows:
            yield _batch(rows)

    return run


def prefixes(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, node, parent, n_chars (of the last turn), before (code points of the turns
    before it), last: all prefixes of all rebuilt conversations, the empty one included."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % group).alias("base"), conv.alias("conv_id"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("n"), F.col("turn")
    )
    order = ("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    dealt = turns.repartition("base").sortWithinPartitions(*order).drop("turn")
    return dealt.mapInArrow(_chains(heads), _PREFIX_SQL)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conv_id) in order -> node, at (the first id), ids: up to IDS ids joined by commas a row."""
    node, ids, done = None, [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "at": pa.array([d[1] for d in done], pa.int64()), "ids": [d[2] for d in done]})

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (n != node or len(ids) == IDS):
                done.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
                if len(done) == 256:
                    yield flush()
                    done = []
            node = n
            ids.append(c)
    if ids:
        done.append((node, ids[0], ",".join(map(str, ids))))
    if done:
        yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) in order -> node, ends_sha256: one running hash, no list is put together."""
    node, run, done = None, None, []
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n == node:
                run.update(b"," + ids.encode())
                continue
            if run is not None:
                done.append((node, run.hexdigest()))
            node, run = n, sha256(ids.encode())
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
                done = []
    if run is not None:
        done.append((node, run.hexdigest()))
        yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})


def end_lists(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from node, conv_id: the SHA-256 of a node's ids, ascending and joined by
    commas. Ranges of (node, conv_id) are joined in parallel, so that of a node where a third of
    all conversations end only long strings meet, one behind the other."""
    joined = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = joined.mapInArrow(_lists, "node binary, at long, ids string")
    dealt = joined.repartition("node").sortWithinPartitions("node", "at").select("node", "ids")
    return dealt.mapInArrow(_hashes, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, node, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    for every distinct prefix of the rebuilt conversations.

    Every conversation c is rebuilt from the first h = crc32(c) % heads turns of c - c % group and its
    own turns after its first h. Turns stand in the order of `turn`, nulls first, equal ones in the
    order of their digests; repeated rows are turns of their own. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out. Extra columns are ignored; an empty
    table gives an empty one, without a root. A text of any length is hashed where it is read; the turns
    of one conversation, however many, pass through one task with one digest in memory.
    """
    with scratch(conversations.sparkSession) as kept:
        rows = store(prefixes(conversations, group, heads))
        key = ["depth", "node"]
        nodes = rows.groupBy(*key, "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("before").alias("before"))
        nodes = store(nodes)
        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        nodes = store(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

        # a conversation's own nodes are those from some depth down to its end
        own = nodes.groupBy("conv_id").agg(F.min("before").alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        ends = rows.where("last")
        total = (F.col("before") + F.col("n_chars")).alias("total")
        brings = ends.select("conv_id", total).join(own, "conv_id", "left")
        brings = brings.select("conv_id", F.coalesce("from", "total").alias("upto"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
        below = rows.select(*key, "conv_id", "before").join(brings, "conv_id")
        below = below.groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("upto") - F.col("before"), F.lit(0))).alias("saved_tokens"))

        out = nodes.join(below, key).join(end_lists(ends), "node", "left")
        out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = out.join(above, ["depth", "parent"], "left")
        out = store(out.select("conv_id", "depth", "node", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
        kept.append(out)
    return out
