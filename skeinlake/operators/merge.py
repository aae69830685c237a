"""Merge of re-indexed files into the chunk table, and the tables that hang on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import apart
from ..schema import EngineError
from .graph import add_edges, contains_edges, drop_edges, valid_edges

_FIELDS = ("file_path", "chunk_type", "content", "start_line", "end_line", "content_hash")


def merge_chunks(existing: DataFrame, new: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The chunk table after the files (file_path) have been indexed again as `new`.

    Live chunks of those files that are not in `new` become tombstones, those that are take the new
    values (a tombstone comes back to life), new ones are added; other files do not change. One
    full outer join by id; a file in `files` without new chunks loses all of its chunks.
    """
    touched = files.select("file_path").distinct().withColumn("touched", F.lit(True))
    old = existing.join(apart(touched), "file_path", "left").select("id", *[F.col(c).alias(f"o_{c}") for c in (*_FIELDS, "is_deleted", "deleted_at")], F.col("touched").alias("o_touched"))
    fresh = new.select("id", *_FIELDS).withColumn("fresh", F.lit(True))
    both = old.join(fresh, "id", "full_outer")
    keep = F.col("fresh").isNotNull()
    dies = ~keep & F.col("o_touched").isNotNull() & ~F.col("o_is_deleted")
    values = [F.when(keep, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in _FIELDS]
    deleted = F.when(keep, False).when(dies, True).otherwise(F.col("o_is_deleted")).alias("is_deleted")
    at = F.when(keep, None).when(dies, now).otherwise(F.col("o_deleted_at")).alias("deleted_at")
    return both.select("id", *values, deleted, at)


def changes(existing: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """id, action (insert, update, delete) of that merge, without making it."""
    old = existing.where("not is_deleted").join(files.select("file_path").distinct(), "file_path", "left_semi").select("id", F.lit(True).alias("old"))
    both = old.join(new.select("id", F.lit(True).alias("new")), "id", "full_outer")
    return both.select("id", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update").alias("action"))


def merge_vectors(existing: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of live chunks, the new ones in place of the old."""
    rest = existing.join(apart(new.select("id")), "id", "left_anti").unionByName(new)
    return rest.join(apart(chunks.where("not is_deleted").select("id")), "id", "left_semi")


def checked_vectors(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """vectors, or an error at run time where one has not `dimensions` components."""
    ok = F.assert_true(F.size("embedding") == dimensions, F.lit("DIMENSION_MISMATCH"))
    return vectors.where(ok.isNull())


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live chunks without a vector: none when as many were embedded as were made."""
    return chunks.where("not is_deleted").join(vectors, "id", "left_anti").select("id")


def merge_edges(existing: DataFrame, chunks: DataFrame, new: DataFrame, extracted: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Edges after a merge: those that start at re-indexed chunks are made anew (containment and what
    was extracted from the source), edges that lost an end go. decisions (id): nodes too."""
    kept = existing.join(new.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*existing.columns)
    nodes = [chunks.where("not is_deleted"), *([decisions] if decisions is not None else [])]
    return valid_edges(add_edges(add_edges(kept, contains_edges(new)), extracted), *nodes)


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All derived tables empty; of the edges those of decisions stay."""
    empty = {k: v.where("false") for k, v in tables.items() if k in ("chunks", "vectors", "scan_cache", "fingerprint")}
    return tables | empty | {"edges": tables["edges"].where("edge_type = 'IMPLEMENTS'")}


def check_fingerprint(stored: DataFrame, provider: str, model: str, revision: str, dimensions: int) -> None:
    """An error where vectors were made by another model than the one configured."""
    for row in stored.limit(1).collect():
        if (row.provider, row.model_name, row.model_revision, row.dimensions) != (provider, model, revision, dimensions):
            raise EngineError("FULL_REINDEX_REQUIRED", f"{row.provider}/{row.model_name}/{row.model_revision}/{row.dimensions}")


def stamp_fingerprint(stored: DataFrame, provider: str, model: str, revision: str, dimensions: int, now: Column) -> DataFrame:
    """Written once: what is there stays."""
    row = stored.sparkSession.range(1).select(
        F.lit(provider).alias("provider"), F.lit(model).alias("model_name"), F.lit(revision).alias("model_revision"), F.lit(dimensions).alias("dimensions"), F.lit("l2").alias("normalization"), now.alias("indexed_at")
    )
    return stored if not stored.isEmpty() else row


def forget_chunks(edges: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return drop_edges(edges, ids), vectors.join(ids.select("id"), "id", "left_anti")
