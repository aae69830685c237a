"""Corpus health, deletion of expired tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .search import live

SHORT = 100
#: Tombstones beyond this number or share ask for a clean-up.
GC_ROWS, GC_SHARE = 10_000, 0.2


def counts(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, total_files, short_chunks, module_chunks, avg_chars (cut, null if none)."""
    return live(chunks).agg(
        F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("total_files"), F.count_if(F.length("content") < SHORT).alias("short_chunks"),
        F.count_if(F.col("chunk_type") == "module").alias("module_chunks"), F.avg(F.length("content")).cast("int").alias("avg_chars"),
    )


def type_distribution(chunks: DataFrame) -> DataFrame:
    return live(chunks).groupBy("chunk_type").agg(F.count("*").alias("n"))


def top_prefixes(chunks: DataFrame, most: int = 5) -> DataFrame:
    """prefix, n of the most frequent first path parts (ties by name)."""
    return live(chunks).groupBy(X.first_part(F.col("file_path")).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(most)


def verdict(total: Column, modules: Column, short: Column, suspicious: Column) -> Column:
    """WARN when empty; DEGRADED over 60 % modules, over 30 % short or a suspicious top prefix; WARN
    from 40 % or 15 %; else HEALTHY."""
    module, brief = F.try_divide(100.0 * modules, total), F.try_divide(100.0 * short, total)
    return F.when(total == 0, "WARN").when((module > 60) | (brief > 30) | suspicious, "DEGRADED").when((module >= 40) | (brief >= 15), "WARN").otherwise("HEALTHY")


def report(chunks: DataFrame | None) -> DataFrame | None:
    """The one-row report with verdict, distribution and top prefixes; None: no index (UNINITIALIZED)."""
    if chunks is None:
        return None
    kinds = type_distribution(chunks).agg(F.sort_array(F.collect_list(F.struct("chunk_type", "n"))).alias("types"))
    tops = top_prefixes(chunks).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "prefix", "n"))), lambda x: F.struct(x["prefix"].alias("prefix"), x["n"].alias("n"))).alias("prefixes"),
        F.coalesce(F.bool_or(X.is_suspicious(F.col("prefix"))), F.lit(False)).alias("suspicious"),
    )
    one = counts(chunks).crossJoin(kinds).crossJoin(tops)  # one row each
    return one.withColumn("verdict", verdict(F.col("total_chunks"), F.col("module_chunks"), F.col("short_chunks"), F.col("suspicious")))


def gc_state(chunks: DataFrame) -> DataFrame:
    """One row: tombstones, total, due."""
    one = chunks.agg(F.count_if("is_deleted").alias("tombstones"), F.count("*").alias("total"))
    share = F.coalesce(F.try_divide(F.col("tombstones"), F.col("total")), F.lit(0.0))
    return one.withColumn("due", (F.col("tombstones") > GC_ROWS) | (share > GC_SHARE))


def expired(retention_days: int, now: Column) -> Column:
    gone = F.coalesce(F.col("is_deleted"), F.lit(False)) & F.col("deleted_at").isNotNull()
    return gone & (F.col("deleted_at") < now - F.make_dt_interval(F.lit(retention_days)))


def collect_garbage(chunks: DataFrame, retention_days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, ids that go): tombstones deleted more than retention_days before now."""
    gone = expired(retention_days, now)
    return chunks.where(~F.coalesce(gone, F.lit(False))), chunks.where(gone).select("id")
