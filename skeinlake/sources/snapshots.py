"""Tables as snapshot folders with a pointer that is swapped last: a reader sees one whole state."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import apart
from ..schema import TABLES, VERSION, ConflictError, EngineError

#: What each keyed table is dealt by: the file that its rows belong to, or a term.
KEYS = {
    "chunks": "file_path", "scan_cache": "file_path", "vectors": "id", "edges": "source_id", "edges_in": "target_id",
    "references": "file_path", "wanted": "target_path", "postings": "tok", "trigrams": "tri", "dead_terms": "id",
}
_BY_TERM = frozenset(["postings", "trigrams"])


def file_of(column: str) -> Column:
    """The file of a path or of an id that starts with one."""
    return F.substring_index(F.col(column), "::", 1)


class SnapshotStore:
    """All tables of an index below one path, in any store that Spark reaches.

    A state is a small JSON pointer: for each table the folders that hold it. The keyed tables are
    dealt by file or term into `buckets` folders, so that commit() writes only what changed, a table,
    some buckets of one or a segment beside what buckets hold, to a folder of its own, and then the
    pointer; a writer that dies before that leaves the old state in place. A pointer is named by the
    number of its state alone and created only if no other writer was first; who comes second looks
    whether the other has touched what it read or replaces, and goes on from the new state or fails.
    The number of buckets is fixed by the first state.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        now = self.current()
        self.buckets = now["buckets"] if now else buckets

    def _pointers(self) -> list[str]:
        where = self._path(f"{self.root}/_pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in names if n.endswith(".json"))

    def _read_pointer(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/_pointers/{name}", wholetext=True).first()[0])

    def current(self) -> dict | None:
        """The newest state, None before the first commit."""
        names = self._pointers()
        return self._read_pointer(names[-1]) if names else None

    def bucket(self, table: str) -> Column:
        key = F.col(KEYS[table]) if table in _BY_TERM else file_of(KEYS[table])
        return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(self.buckets)).cast("int")

    def bucket_of(self, key: str) -> int:
        """The bucket of a file, an id or a term, on the driver."""
        return zlib.crc32(key.encode()) % self.buckets

    def buckets_of(self, rows: DataFrame, table: str = "chunks") -> list[int]:
        """The buckets of rows by the table's key (of files by file_path): a bounded list."""
        return sorted(r[0] for r in rows.select(self.bucket(table)).distinct().collect())

    def read(self, table: str, buckets: Iterable[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table of the newest state, or of the one given; of a keyed one these buckets alone."""
        state = state or self.current()
        held = state["tables"].get(table, {}) if state else {}
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.root}/{p}" for b, ps in held.items() if wanted is None or b in wanted for p in _each(ps)]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def read_all(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def _write(self, name: str, table: str, df: DataFrame) -> dict[str, str]:
        """Bucket -> folder of what was written, `all` for a table without a key."""
        path = f"{name}/{table}"
        if table not in KEYS:
            df.write.parquet(f"{self.root}/{path}")
            return {"all": path}
        # dealt by bucket; a large one is split over several tasks
        df = df.withColumn("bucket", self.bucket(table)).hint("rebalance", "bucket").sortWithinPartitions("bucket", KEYS[table])
        df.write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}"))]
        return {n.split("=")[1]: f"{path}/{n}" for n in found if n.startswith("bucket=")}

    def _incoming(self, edges: DataFrame, buckets: list[int] | None, base: dict | None) -> tuple[DataFrame, list[int] | None]:
        """The edges by target after those by source were replaced, and the buckets that change."""
        if buckets is None or not base or "edges_in" not in base["tables"]:
            rest = [b for b in range(self.buckets) if buckets is not None and b not in set(buckets)]
            return (edges.unionByName(self.read("edges", rest, base)) if rest else edges), None
        old, key = self.read("edges", buckets, base), ["source_id", "target_id", "edge_type"]
        gone, new = old.join(apart(edges), key, "left_anti"), edges.join(apart(old), key, "left_anti")
        hit = self.buckets_of(gone.unionByName(new), "edges_in")
        return self.read("edges_in", hit, base).join(apart(gone), key, "left_anti").unionByName(new), hit

    def commit(
        self, tables: dict[str, DataFrame], buckets: dict[str, list[int]] | None = None, batch: int | None = None, base: dict | None = None,
        segments: dict[str, DataFrame] | None = None, read: dict[str, list[int]] | None = None, totals: dict[str, int] | None = None, version: int = VERSION,
    ) -> dict:
        """Write a new state: the tables given, the others stay where they are.

        buckets: of which buckets of a keyed table the rows given are all; those of other buckets stay.
        segments: rows that come beside those of their buckets. batch: the number of a stream's batch,
        kept in the state. base: the state that the rows were made from, the newest if not given; read:
        buckets whose rows went into them. ConflictError if another writer has changed either since.
        totals: what is added to the sums that the state keeps. The edges by target follow those by
        source; of two open sessions with one name the commit fails."""
        base = base or self.current()
        name = f"v{version}_{(base['number'] + 1 if base else 0):012d}_{uuid.uuid4().hex[:8]}"
        buckets, read, tables = dict(buckets or {}), read or {}, dict(tables)
        if "sessions" in tables and not tables["sessions"].where("status in ('active', 'idle')").groupBy("name").count().where("count > 1").isEmpty():
            raise EngineError("SESSION_ALREADY_ACTIVE", "two open sessions with one name")
        if "edges" in tables:
            tables["edges_in"], hit = self._incoming(tables["edges"], buckets.get("edges"), base)
            if hit is not None:
                buckets["edges_in"] = hit
        # the tables do not hang on each other: their jobs run beside each other
        both = {(t, True): df for t, df in tables.items()} | {(t, False): df for t, df in (segments or {}).items()}
        with ThreadPoolExecutor(8) as pool:
            write = inheritable_thread_target(self.spark)(lambda t, df: self._write(name, t, df))
            done = dict(zip(both, pool.map(write, [t for t, _ in both], both.values())))
        written, beside = ({t: found for (t, kind), found in done.items() if kind is replaces} for replaces in (True, False))
        for t, new in written.items():
            if t in buckets and not set(new) <= {str(b) for b in buckets[t]}:
                raise ValueError(f"rows of {t} outside the buckets that are replaced")
        while True:
            now = self.current()
            held = {t: dict(x) for t, x in now["tables"].items()} if now else {}
            if (now or {}).get("number") != (base or {}).get("number"):
                lost = self._touched(held, base, written, buckets, read)
                if batch is not None and now["batch"] is not None and batch <= now["batch"]:
                    lost = f"batch {batch}"
                if lost:
                    self._delete(name)
                    raise ConflictError(f"{lost} was changed by another writer")
            for t, new in written.items():
                replaced = {str(b) for b in buckets[t]} if t in buckets else None
                held[t] = new if replaced is None else {b: p for b, p in held.get(t, {}).items() if b not in replaced} | new
            for t, new in beside.items():
                at = held.setdefault(t, {})
                for b, p in new.items():
                    at[b] = [*_each(at.get(b, [])), p]
            sums = (now or {}).get("totals", {})
            sums = {k: sums.get(k, 0) + (totals or {}).get(k, 0) for k in {*sums, *(totals or {})}}
            state = {
                "version": version, "number": now["number"] + 1 if now else 0, "name": name, "buckets": self.buckets,
                "batch": batch if batch is not None else (now or {}).get("batch"), "tables": held, "totals": sums,
            }
            if self._point(state):
                return state

    def _touched(self, held: dict, base: dict | None, written: dict, buckets: dict[str, list[int]], read: dict[str, list[int]]) -> str:
        """A table of which what is replaced or was read is not what it was in the state `base`."""
        before = base["tables"] if base else {}
        for t in {*written, *read}:
            of = lambda state: {b: list(_each(p)) for b, p in state.get(t, {}).items()}  # noqa: E731, B023
            old, new = of(before), of(held)
            whole = t in written and t not in buckets
            mine = {*old, *new} if whole else {str(b) for b in (*buckets.get(t, ()), *read.get(t, ()))}
            if any(old.get(b) != new.get(b) for b in mine):
                return t
        return ""

    def _point(self, state: dict) -> bool:
        """Create the pointer of a state, whole, unless there is one with its number."""
        where = self._path(f"{self.root}/_pointers")
        self._fs.mkdirs(where)
        final = self._path(f"{self.root}/_pointers/{state['number']:012d}.json")
        part = self._path(f"{self.root}/_pointers/{state['name']}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self._fs.getScheme() != "file":
                return not self._fs.exists(final) and bool(self._fs.rename(part, final))  # the name node refuses a second one
            jvm = self.spark.sparkContext._jvm
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(final), local(part))  # a local rename would replace
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        finally:
            self._fs.delete(part, False)

    def drop_old(self, keep: int = 2) -> int:
        """Delete all but the newest states, and what none of these holds; returns how many states went."""
        return self.drop(keep)[0]

    def drop(self, keep: int = 2) -> tuple[int, int]:
        """(states, bytes) that went: all but the newest states, and the folders that none of these holds,
        empty parents with them."""
        names = self._pointers()
        kept = [self._read_pointer(n) for n in names[-keep:]]
        folders = lambda state: {p for paths in state["tables"].values() for ps in paths.values() for p in _each(ps)}
        needed = set().union(*map(folders, kept))
        old = [self._read_pointer(n) for n in names[:-keep]]
        gone = set().union(*map(folders, old)) - needed
        freed = sum(map(self._delete, gone))
        # the folders above them, where nothing that a state holds is left
        above = {"/".join(p.split("/")[:i]) for p in gone for i in (2, 1)} | {state["name"] for state in old}
        above -= {"/".join(p.split("/")[:i]) for p in needed for i in (2, 1)}
        for p in sorted(above, reverse=True):
            freed += self._delete(p)
        for n in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_pointers/{n}"), False)
        return len(names[:-keep]), freed

    def _delete(self, path: str) -> int:
        """Delete a folder below the root; the bytes that were in it."""
        where = self._path(f"{self.root}/{path}")
        if not self._fs.exists(where):
            return 0
        held = self._fs.getContentSummary(where).getLength()
        self._fs.delete(where, True)
        return held

    def migrate(self, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], to: int = VERSION) -> int:
        """Bring the newest state to the version `to`, a step a version: steps[n] takes the tables of
        version n - 1 and returns those that change. Returns the version; a newer state or a missing
        step is an error."""
        state = self.current()
        version = state["version"] if state else to
        steps = {5: lambda tables: {t: tables[t] for t in KEYS if t != "edges_in"}} | steps  # version 5 deals the rows anew
        if version > to:
            raise EngineError("FULL_REINDEX_REQUIRED", f"state of version {version}")
        for n in range(version + 1, to + 1):
            if n not in steps:
                raise EngineError("FULL_REINDEX_REQUIRED", f"no step to version {n}")
            self.commit(steps[n](self.read_all()), version=n)
        return max(version, to)


def _each(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else paths


class VectorStore:
    """Vectors as a DataFrame: upsert, query, delete."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def upsert(self, new: DataFrame) -> VectorStore:
        return VectorStore(self.vectors.join(new.select("id"), "id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> VectorStore:
        return VectorStore(self.vectors.join(ids.select("id"), "id", "left_anti"))

    def query(self, vector: list[float], limit: int) -> DataFrame:
        from ..operators.search import nearest

        return nearest(self.vectors, vector, limit)
