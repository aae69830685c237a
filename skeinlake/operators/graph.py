"""Property graph over chunk ids: edge tables, validation and bounded traversal."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import apart, settled

if TYPE_CHECKING:
    from ..sources.snapshots import SnapshotStore

MAX_DEPTH, MAX_NODES = 6, 50


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Union without repeats of (source_id, target_id, edge_type)."""
    return edges.unionByName(more).dropDuplicates(["source_id", "target_id", "edge_type"])


def drop_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those that start or end at one of ids (id)."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*edges.columns)


def valid_edges(edges: DataFrame, *nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are an id of one of the tables, deleted or not."""
    ids = nodes[0].select("id")
    for n in nodes[1:]:
        ids = ids.union(n.select("id"))
    ids = apart(ids)
    ends = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return ends.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*edges.columns)


def parent_id(chunk_id: Column, chunk_type: Column, file_path: Column) -> Column:
    """What contains a chunk: a method's class, a class's or function's module; else null."""
    has = chunk_id.contains("::method::")
    owner = F.regexp_extract(chunk_id, r"(?s)^(.*)::method::", 1)
    return F.when((chunk_type == "method") & has, owner).when(chunk_type.isin("class", "function"), F.concat(file_path, F.lit("::module::default")))


def contains_edges(chunks: DataFrame) -> DataFrame:
    parent = parent_id(F.col("id"), F.col("chunk_type"), F.col("file_path"))
    return chunks.select(parent.alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("edge_type")).where("source_id is not null").distinct()


def implements_edges(decisions: DataFrame) -> DataFrame:
    """decisions: id, impacts_files -> an edge to each file's module."""
    paths = decisions.select(F.col("id").alias("source_id"), F.explode("impacts_files").alias("path"))
    return paths.select("source_id", F.concat("path", F.lit("::module::default")).alias("target_id"), F.lit("IMPLEMENTS").alias("edge_type")).distinct()


def _steps(edges: DataFrame | SnapshotStore, frontier: DataFrame) -> DataFrame:
    """node_id, edge_type: the other ends of edges at the frontier (id), edges taken both ways. Of a
    store only the buckets of the frontier are read, of either direction."""
    sides = []
    for table, here, there in (("edges", "source_id", "target_id"), ("edges_in", "target_id", "source_id")):
        at = frontier.select(F.col("id").alias(here))
        held = edges if isinstance(edges, DataFrame) else edges.read(table, edges.buckets_of(at, table))
        sides.append(held.join(at, here, "left_semi").select(F.col(there).alias("node_id"), "edge_type"))
    return sides[0].union(sides[1])


def neighbourhood(edges: DataFrame | SnapshotStore, start: str, max_depth: int = MAX_DEPTH, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """node_id, depth, edge_type: the nodes within max_depth steps of start, edges taken both ways,
    the nearest max_nodes (ties by id; None: all). edge_type: the smallest type by which the depth is reached.

    One join a step between the frontier and the edges, visited nodes taken out: every node is
    reached once, where a walk of simple paths would meet it along each of them. edges: a table, or a
    store, which keeps its edges by either end and of which a step reads the frontier's buckets alone.
    A step that has max_nodes in all is the last: those beyond would not be among the nearest.
    """
    spark = edges.sparkSession if isinstance(edges, DataFrame) else edges.spark
    frontier = seen = spark.createDataFrame([(start, 0, None)], "node_id string, depth int, edge_type string")
    found = 0
    for depth in range(1, max_depth + 1):
        step = _steps(edges, frontier.select(F.col("node_id").alias("id"))).groupBy("node_id").agg(F.min("edge_type").alias("edge_type"))
        step = step.join(seen.select("node_id"), "node_id", "left_anti")
        n = Observation()
        step = settled(step.select("node_id", F.lit(depth).alias("depth"), "edge_type").observe(n, F.count("*").alias("n")))
        seen, frontier, found = seen.union(step), step, found + n.get["n"]
        if not n.get["n"] or max_nodes is not None and found >= max_nodes:
            break
    seen = seen.where("depth > 0")
    return seen if max_nodes is None else seen.orderBy("depth", "node_id").limit(max_nodes)


class GraphStore:
    """Edges as a DataFrame: insert, delete, traverse."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges

    def insert(self, more: DataFrame) -> GraphStore:
        return GraphStore(add_edges(self.edges, more))

    def delete(self, ids: DataFrame) -> GraphStore:
        return GraphStore(drop_edges(self.edges, ids))

    def traverse(self, start: str, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
        return neighbourhood(self.edges, start, max_depth, max_nodes)
