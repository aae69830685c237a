"""Connected components of an edge table, without a driver-side copy of nodes or edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Edges that a task joins into a forest at a time: the bound on its memory.
FOREST = 1 << 18


def _forests(batches):
    """Edges in, at most as many out that connect the same nodes: stars around the smallest node of each
    component of what is read together."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        out = [(find(x), x) for x in list(root)]
        out = [(r, x) for r, x in out if r != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["u", "v"])

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= FOREST:
            yield stars()
            held = 0
    yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; loops and repeats do no harm.

    Tasks first join what edges they read into stars. Then contraction: each round every node joins
    the neighbour (or itself) that is smallest, in the first round by id, so that stars are done, and
    later by a seeded hash, and the edges are rewritten to the nodes joined. By hash a constant share
    of the nodes goes each round whatever the shape, chains included, so the rounds grow with the
    logarithm of the size. No edge: an empty table.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = pairs.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).distinct()
    pairs = store(pairs.mapInArrow(_forests, "u long, v long"))
    steps = []
    for i in range(rounds):
        if pairs.isEmpty():
            break
        rank = lambda c, i=i: F.struct((F.xxhash64(c, F.lit(i)) if i else c).alias("h"), c.alias("n"))
        both = pairs.union(pairs.select("v", "u"))
        to = store(both.groupBy("u").agg(F.least(F.min(rank(F.col("v"))), rank(F.col("u")))["n"].alias("t")))
        left = to.select(F.col("u").alias("v"), F.col("t").alias("tv"))
        steps.append(to)
        pairs = store(
            pairs.join(to, "u").join(left, "v").where("t <> tv").select(F.least("t", "tv").alias("u"), F.greatest("t", "tv").alias("v")).distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not steps:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = steps[0].select(F.col("u").alias("node"), F.col("t").alias("label"))
    for to in steps[1:]:
        labels = labels.join(to.select(F.col("u").alias("label"), F.col("t").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = store(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return store(labels.join(least, "label").select("node", "component"))


def more_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` (node, component) joined further by links (a, b)."""
    at = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    merged = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    nodes = found.union(merged.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    step = merged.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return store(nodes.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
