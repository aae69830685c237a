"""python -m skeinlake init|index|search|health|collect|benchmark|migrate: an index of a file tree from
the command line."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, health, search
from .plans.tables import settled
from .sources import reports
from .sources.connectors import hash_embedding
from .sources.keywords import StoredKeywords
from .sources.snapshots import SnapshotStore
from .sources.tree import DEFAULT_IGNORES, IGNORE_FILES, completed_rules
from .streaming.incremental import collect, sync_tree

DIMENSIONS = 256
#: The model whose vectors the index holds: provider, name, revision, dimensions.
MODEL = ("local", "hash", "1", DIMENSIONS)


def _arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skeinlake")
    commands = out.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="complete the ignore rules of a file tree and index it")
    init.add_argument("root")
    init.add_argument("store")
    bench = commands.add_parser("benchmark", help="score a query set (JSON lines) against an index")
    bench.add_argument("store")
    bench.add_argument("queries")
    bench.add_argument("out")
    commands.add_parser("migrate", help="bring an index to this version").add_argument("store")
    index = commands.add_parser("index", help="bring an index up to date with a file tree")
    index.add_argument("root")
    index.add_argument("store")
    index.add_argument("--path", default=".")
    index.add_argument("--force", action="store_true")
    find = commands.add_parser("search", help="the best chunks for a query")
    find.add_argument("store")
    find.add_argument("query")
    find.add_argument("--intent", choices=sorted(search.WEIGHTS), default="semantic")
    find.add_argument("--limit", type=int, default=search.DEFAULT_LIMIT)
    commands.add_parser("health", help="counts and verdict").add_argument("store")
    collect = commands.add_parser("collect", help="forget chunks that were deleted long ago")
    collect.add_argument("store")
    collect.add_argument("--days", type=int, default=30)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _arguments().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("skeinlake").getOrCreate()
    store = SnapshotStore(spark, a.store)
    embed = lambda chunks: hash_embedding(chunks, DIMENSIONS)
    if a.command == "migrate":
        print(f"version: {store.migrate({})}")
        return
    if a.command == "init":
        path = os.path.join(a.root, IGNORE_FILES[-1])
        lines = open(path, encoding="utf-8").read().splitlines() if os.path.isfile(path) else []
        rules = completed_rules(lines, DEFAULT_IGNORES)
        if rules != lines:
            with open(path, "w", encoding="utf-8") as f:
                f.write("\n".join(rules) + "\n")
    if a.command in ("index", "init"):
        how = (a.path, a.force) if a.command == "index" else ()
        done = sync_tree(store, a.root, *how, embed=embed, model=MODEL)
        print(f"files: {done.succeeded}, failed: {done.failed}, chunks: {done.chunks}")
        for path, error in done.errors:
            print(f"{path}: {error}")
        return
    chunks, vectors = store.read("chunks"), store.read("vectors")
    if a.command == "search":
        asked = spark.createDataFrame([("q", a.query)], "id string, content string")
        found, notes = search.investigate(chunks, vectors, store, a.query, a.intent, a.limit, lambda q: list(embed(asked).first()["embedding"]), index=StoredKeywords(store))
        print("\n".join([*notes, *([search.render(found, "score" if "score" in found.columns else None).first()["text"]] if found is not None else [])]))
    elif a.command == "health":
        for name, value in health.report(chunks).first().asDict(recursive=True).items():
            print(f"{name}: {value}")
    elif a.command == "benchmark":
        asked = reports.read_query_set(spark, a.queries).collect()
        found, index = [], StoredKeywords(store)
        for q in asked:  # a set of some dozens, as people write it
            vector = list(embed(spark.createDataFrame([("q", q.query)], "id string, content string")).first()["embedding"])
            hits, _ = search.hybrid_search(chunks, vectors, q.query, vector, index=index)
            found += [(q.id, r.id, r["rank"]) for r in hits.select("id", "rank").collect()]
        judged = evaluate.per_query(
            spark.createDataFrame([(q.id, q.difficulty, q.relevant_chunks) for q in asked], "query_id string, difficulty string, relevant_chunks array<string>"),
            spark.createDataFrame(found, "query_id string, chunk_id string, rank int"),
        )
        summary = settled(evaluate.summary(settled(judged)))
        summary.write.mode("overwrite").json(a.out)
        for name, value in summary.first().asDict().items():
            print(f"{name}: {value}")
    else:
        n, freed = collect(store, a.days, F.current_timestamp())
        print(f"collected: {n}, bytes: {freed}")


if __name__ == "__main__":
    main()
