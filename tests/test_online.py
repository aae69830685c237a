"""Idle sessions of a stream, hashes, substring indexes, walks and the command line."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlake import __main__ as cli
from skeinlake import schema
from skeinlake.functions import text as X
from skeinlake.functions.blake3 import blake3, blake3_hash
from skeinlake.operators import search as S
from skeinlake.sources import tree
from skeinlake.sources.keywords import StoredKeywords
from skeinlake.sources.snapshots import SnapshotStore
from skeinlake.streaming import incremental

#: Published test vectors: bytes 0, 1, ... 250, 0, ... of a length, and their hash.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3_vectors(spark):
    data = {n: bytes(i % 251 for i in range(n)) for n in VECTORS}
    assert [h and h.hex() for h in blake3([*data.values(), None])] == [*VECTORS.values(), None]
    assert blake3([]) == []
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in data.items()] + [(-1, None)], "n int, content binary")
    got = {r.n: r.h for r in df.select("n", blake3_hash(F.col("content")).alias("h")).collect()}
    assert got == {n: f"blake3:{h}" for n, h in VECTORS.items()} | {-1: None}


def test_idle_sessions_of_a_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    steps = [
        [("a", at(0)), ("b", at(5)), ("a", at(10)), ("a", at(10))],
        [("b", at(12)), ("c", at(60))],  # the watermark passes 50: a (10) and b (12) are over
        [("a", at(20)), ("a", at(55))],  # the first is too late to count, the second opens a again
        [("d", at(200))],
        [("d", at(201))],
    ]
    seen = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "session_id string, ts timestamp").write.json(f"{tmp_path}/in/{i}")
        turns = spark.readStream.schema("session_id string, ts timestamp").json(f"{tmp_path}/in/*")
        query = incremental.reap_stream(turns).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
    got = [(r.session_id, r.status, r.role, r.ts) for r in seen]
    assert sorted(got) == sorted([(s, "idle", "system", at(m)) for s, m in (("a", 40), ("b", 42), ("a", 85), ("c", 90))])
    assert json.loads(seen[0].content)["kind"] == "reaper_notice"


def chunk(id_, text, dead=False):
    return (id_, id_.partition("::")[0], "doc", text, 0, 0, dead, None, "h")


def test_trigrams(spark):
    got = spark.createDataFrame([("aBcab",), ("ab",), ("",), (None,), ("ééé é",)], "t string").select(X.trigrams(F.coalesce("t", F.lit("")))).collect()
    assert [sorted(r[0]) for r in got] == [sorted(x) for x in (["abc", "bca", "cab"], [], [], [], ["éé ", "ééé", "é é"])]


@pytest.mark.parametrize("kind", ["session", "store"])
def test_substrings_by_an_index(spark, tmp_path, kind):
    r = random.Random(2)
    rows = [chunk(f"f{i}::x", "".join(r.choice("abAB é.") for _ in range(r.randint(0, 60))), i % 9 == 4) for i in range(80)] + [chunk("n::x", None)]
    c = spark.createDataFrame(rows, schema.CHUNKS)
    if kind == "store":
        store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=8)
        files = lambda some: spark.createDataFrame([(f"{x[1]}.txt", x[3], "h", 1, 1) for x in some], incremental.CHANGED)
        incremental.index_batch(store, files(rows))
        incremental.index_batch(store, files([(0, "f0", 0, "now abab here"), (0, "f1", 0, None)]))
        c, index = store.read("chunks"), StoredKeywords(store)
    else:
        index = S.trigram_index(c, 4)
    of = lambda **k: [(x.id, x.score, x["rank"]) for x in S.substring_search(c, q, 200, **k).orderBy("rank").collect()]
    for q in ("aba", '"ab a"', "É.b", "abab", "zzz", "ab", "b..a"):
        assert of(index=index) == of()


def test_walk_on_the_executors(spark, tmp_path):
    r = random.Random(3)
    for i in range(60):
        folder = "/".join(r.choice(("a", "b", "skip", "c d")) for _ in range(r.randint(0, 4)))
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / f"f{i}.{r.choice(('ts', 'md', 'bin', 'PY'))}").write_text(str(i))
    (tmp_path / ".gitignore").write_text("skip/\n*.md\n!f1*.md\n")
    os.makedirs(tmp_path / "a" / "b", exist_ok=True)
    (tmp_path / "a" / ".skeinignore").write_text("/b/f*5.ts\nf2*\n")
    (tmp_path / "a" / "b" / ".gitignore").write_text("!skip/\nc d/\n")
    os.symlink(tmp_path / "a", tmp_path / "link")
    listing = tree.scan_tree(spark, str(tmp_path))
    assert sorted(map(tuple, listing.collect())) == tree.list_tree(str(tmp_path)) and listing.count() > 5
    got = {x.file_path: bytes(x.content) for x in tree.read_contents(listing).collect()}
    assert got == {p: (tmp_path / p).read_bytes() for p, *_ in tree.list_tree(str(tmp_path))}


def test_command_line(spark, tmp_path, capsys):
    root, store = tmp_path / "src", f"file://{tmp_path}/store"
    (root / "node_modules").mkdir(parents=True)
    (root / "node_modules" / "x.ts").write_text("function no() {}\n")
    (root / "a.ts").write_text("export function alpha() { return 1; }\n")
    (root / "b.ts").write_text('import { alpha } from "./a";\nexport function beta() { return alpha(); }\n')
    cli.main(["init", str(root), store], spark)
    assert "node_modules/" in (root / ".skeinignore").read_text()
    cli.main(["search", store, "a.ts::function::alpha", "--intent", "structural"], spark)
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q1", "query": "alpha", "type": "semantic", "difficulty": "easy", "relevant_chunks": ["a.ts::function::alpha"]}) + "\n")
    cli.main(["benchmark", store, str(tmp_path / "q.jsonl"), str(tmp_path / "out")], spark)
    cli.main(["migrate", store], spark)
    (root / "b.ts").unlink()
    cli.main(["index", str(root), store], spark)
    cli.main(["collect", store, "--days", "0"], spark)
    out = capsys.readouterr().out
    assert "files: 2, failed: 0, chunks: 4" in out and "[b.ts:1-1]" in out and "n_queries: 1" in out and f"version: {schema.VERSION}" in out
    freed = int(out.split("collected: 2, bytes: ")[1].split()[0])
    assert freed > 0 and SnapshotStore(spark, store).read("chunks").count() == 2
