"""Shared-folder tables that cut lineage between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a new temporary folder only where
    it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables of each open scratch(), the innermost last; each thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def _on_disk(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables settled inside go at its end, but for those put into the list that it yields. For an
    operator whose result is settled too: nothing then hangs on its intermediate tables."""
    kept: list[DataFrame] = []
    around, mine = _open.get(), []
    token = _open.set((*around, mine))
    try:
        yield kept
    finally:
        _open.reset(token)
        stay = {getattr(df, "_settled_at", None) for df in kept}
        for path in mine:
            if path in stay:
                if around:
                    around[-1].append(path)
            else:
                fs, where = _on_disk(spark, path)
                fs.delete(where, True)


#: Public setting: shuffle files go at the end of a query, and not when the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session: how many of its threads are inside released(), and what it had set before.
_released: dict[SparkSession, tuple[int, str | None]] = {}
_lock = threading.Lock()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files behind: for writers of tables, of whose shuffles
    nothing is read again. The session gets back the setting that it had."""
    with _lock:
        n, before = _released.get(spark, (0, spark.conf.get(RELEASE, None)))
        _released[spark] = n + 1, before
        spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _released.pop(spark)
            if n > 1:
                _released[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(RELEASE)
            else:
                spark.conf.set(RELEASE, before)


def settled(df: DataFrame, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """df written to the shared folder, dealt into folders `by` a column, and read back: cuts the
    lineage and survives lost executors. The files go when the driver's JVM ends, those of its shuffles at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinlake/{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    with released(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    fs, where = _on_disk(spark, path)
    fs.deleteOnExit(where)
    if _open.get():
        _open.get()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """df as a side of joins that are never broadcast: paths and ids compress so well that the size of
    their files says little of what they would take in the driver's memory."""
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Delete what settled() wrote for df, which must not be read again; other tables are left alone."""
    path = getattr(df, "_settled_at", None)
    if path:
        fs, where = _on_disk(df.sparkSession, path)
        fs.delete(where, True)
