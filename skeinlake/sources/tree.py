"""Incremental scan of a file tree: ignore rules, binary sniff, change detection."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import apart, settled
from ..schema import EngineError

# Extensions that a scan takes, in the order of the languages.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".php", ".phtml", ".py", ".go", ".rs", ".java", ".xml", ".sql", ".css", ".scss", ".md", ".mdx")
IGNORE_FILES = (".gitignore", ".skeinignore")
DEFAULT_IGNORES = ("node_modules/", "dist/", "build/", ".git/", "vendor/", "coverage/")
LISTING = "file_path string, full_path string, mtime_ns bigint, size_bytes bigint"


class Ignore:
    """Rules of one ignore file for paths below its folder; the last rule that matches decides."""

    def __init__(self, lines: list[str]) -> None:
        self.rules = [r for r in map(self._rule, lines) if r]

    @staticmethod
    def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out = ""
        for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]*\]|\\.|.", line.lstrip("/"), re.S):
            if token == "**/":
                out += "(?:.*/)?"
            elif token == "/**":
                out += "/.*"
            elif token in ("**", "*"):
                out += ".*" if token == "**" else "[^/]*"
            elif token == "?":
                out += "[^/]"
            elif token[0] == "[" and len(token) > 1:
                out += "[" + ("^" if token[1] == "!" else "") + token[1:-1].removeprefix("!") + "]"
            else:
                out += re.escape(token[1:] if token[0] == "\\" and len(token) > 1 else token)
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S), negated, folder

    def ignores(self, path: str, is_folder: bool) -> bool:
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            folder, hit = i < len(parts) or is_folder, False
            for pattern, negated, only_folders in self.rules:
                if (folder or not only_folders) and pattern.match("/".join(parts[:i])):
                    hit = not negated
            if hit:
                return True
        return False


Rules = list[tuple[str, list[str]]]
_FOUND = LISTING + ", rules string"


def _entries(root: str, folder: str, above: Rules, ignore_files: tuple[str, ...]) -> tuple[list[tuple[str, str, int, int]], list[str], Rules]:
    """(files to scan as in LISTING, folders to go on with, rules that hold below) of one folder of a
    tree: paths from the root, and the rules with the folder that they stand in."""
    here = os.path.join(root, folder)
    rules = list(above)
    for name in ignore_files:
        path = os.path.join(here, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                rules.append((folder, f.read().splitlines()))
    matchers = [(base, Ignore(lines)) for base, lines in rules]
    files, folders = [], []
    with os.scandir(here) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            path, is_folder = f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False)
            if any(m.ignores(path[len(base) + 1 :] if base else path, is_folder) for base, m in matchers):
                continue
            if is_folder:
                folders.append(path)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in EXTENSIONS:
                stat = e.stat()
                files.append((path, e.path, stat.st_mtime_ns, stat.st_size))
    return files, folders, rules


def list_tree(root: str, ignore_files: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, str, int, int]]:
    """(relative path, full path, mtime in ns, bytes) of the files to scan, listed on the driver. Rules
    of a folder hold for all below it and a folder below cannot undo them."""
    out, waiting = [], [("", [])]
    while waiting:
        files, folders, rules = _entries(root, *waiting.pop(), ignore_files)
        out += files
        waiting += [(f, rules) for f in folders]
    return sorted(out)


def scan_tree(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """LISTING of the files to scan, as list_tree gives them, walked by the executors, which see the tree
    as the driver does: the folders of a level are dealt out and listed together, each with the rules
    that it inherits. A folder that is gone when its turn comes is empty."""

    def level(batches):
        for pdf in batches:
            out = []
            for folder, above in zip(pdf["file_path"], pdf["rules"]):
                try:
                    files, folders, rules = _entries(root, folder, json.loads(above), ignore_files)
                except FileNotFoundError:
                    continue
                out += [(*f, None) for f in files]
                out += [(f, None, None, None, json.dumps(rules)) for f in folders]
            # whole numbers of 64 bits beside nulls
            columns = zip(("file_path", "full_path", "mtime_ns", "size_bytes", "rules"), zip(*out) if out else [()] * 5)
            yield pd.DataFrame({c: pd.array(v, "Int64") if c.endswith(("_ns", "_bytes")) else pd.Series(v, dtype=object) for c, v in columns})

    found, folders = None, spark.createDataFrame([("", "[]")], "file_path string, rules string")
    while True:
        n = Observation()
        # folders of a level may be few rows of one task: they are dealt out anew
        listed = folders.repartition(spark.sparkContext.defaultParallelism).mapInPandas(level, _FOUND)
        listed = settled(listed.observe(n, F.count("rules").alias("folders")))
        files = listed.where("rules is null").drop("rules")
        found = files if found is None else found.union(files)
        if not n.get["folders"]:
            return found
        folders = listed.where("rules is not null").select("file_path", "rules")


def read_contents(listing: DataFrame) -> DataFrame:
    """The listing with content (binary), read where the rows are, file by file; a file that is gone by
    then is left out."""
    columns = listing.columns
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema) + ", content binary"

    def read(batches):
        for batch in batches:
            place = columns.index("full_path")
            for i in range(batch.num_rows):
                try:
                    with open(batch.column(place)[i].as_py(), "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*columns, "content"])

    return listing.mapInArrow(read, out)


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """file_path, mtime_ns, size_bytes, content of a tree in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = F.lit(path.rstrip("/") + "/")
    relative = F.when(F.col("path").contains(root), F.substring_index(F.col("path"), root, -1)).otherwise(F.regexp_replace("path", r"^\w+:/*", ""))
    return source_files(files.select(relative.alias("file_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content"))


def source_files(listing: DataFrame) -> DataFrame:
    """The files of a listing (file_path) that a scan takes, by extension."""
    return listing.where(F.lower(F.regexp_extract("file_path", r"\.[^./]+$", 0)).isin(*EXTENSIONS))


def without_binary(files: DataFrame) -> DataFrame:
    return files.where(~X.has_nul(F.col("content")))


def changed_candidates(listing: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Files that may have changed: new ones and those with another mtime. Decided on metadata, before
    any content is read."""
    known = cache.select("file_path", F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    both = listing.join(known, "file_path", "left")
    return both if force else both.where("old_mtime is null or old_mtime <> mtime_ns")


def confirmed_changes(candidates: DataFrame, hash_: Column | None = None, force: bool = False) -> DataFrame:
    """Of candidates with content those that are new or have another content hash."""
    hashed = without_binary(candidates).withColumn("content_hash", X.content_hash(F.col("content")) if hash_ is None else hash_)
    return hashed if force else hashed.where("old_hash is null or old_hash <> content_hash")


def changed_files(files: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    return confirmed_changes(changed_candidates(files, cache, force), force=force)


def vanished_files(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files of the cache that are no more."""
    return cache.join(listing.select("file_path"), "file_path", "left_anti").select("file_path")


def under(files: DataFrame, prefix: str) -> DataFrame:
    """Files at or below a path relative to the workspace; other paths are an error."""
    if prefix.startswith("/") or ".." in prefix.split("/"):
        raise EngineError("INVALID_PATH", prefix)
    prefix = prefix.strip("/").removeprefix("./")
    return files if prefix in ("", ".") else files.where((F.col("file_path") == prefix) | F.col("file_path").startswith(prefix + "/"))


def refreshed_cache(cache: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    new = changed.select("file_path", "mtime_ns", "size_bytes", "content_hash", now.alias("last_scanned_at"))
    return cache.join(apart(new.select("file_path")), "file_path", "left_anti").select(*new.columns).unionByName(new)


def completed_rules(lines: list[str], wanted: tuple[str, ...] = DEFAULT_IGNORES) -> list[str]:
    """Ignore rules with those of `wanted` that are missing at the end."""
    return [*lines, *(w for w in wanted if w not in {x.strip() for x in lines})]


def glob_files(spark: SparkSession, pattern: str) -> DataFrame:
    """file_path, content of the files that a glob matches."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
