"""The index of a store: the same however files are dealt into batches, and with two writers."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from skeinlake import schema
from skeinlake.operators import search as S
from skeinlake.operators.graph import neighbourhood
from skeinlake.sources.keywords import StoredKeywords, merge_segments, segments
from skeinlake.sources.snapshots import SnapshotStore
from skeinlake.streaming import incremental

FILES = {
    "a.ts": 'import { f, g as h } from "./lib";\nimport D, * as N from "./deep/d";\nimport x from "./none";\nexport function run() { f(); h(); N.k(); D(); }\n',
    "lib/index.ts": 'export * from "./one";\nexport { two as g } from "./two";\n',
    "lib/one.ts": 'export { f } from "../deep/d";\nexport * from "./index";\n',
    "lib/two.ts": 'import { k } from "../deep/d";\nexport { k as two };\n',
    "deep/d.ts": "export function f() {}\nexport function k() {}\nexport default function main() { return f(); }\n",
    "late.js": 'import { run } from "./a";\nrun();\nnew run();\n',
}
WANT = {
    ("a.ts::module::default", "lib/index.ts::module::default", "IMPORTS"), ("a.ts::module::default", "deep/d.ts::module::default", "IMPORTS"),
    ("a.ts::function::run", "deep/d.ts::function::f", "CALLS"), ("a.ts::function::run", "deep/d.ts::function::k", "CALLS"), ("a.ts::function::run", "deep/d.ts::function::main", "CALLS"),
    ("lib/index.ts::module::default", "lib/one.ts::module::default", "RE_EXPORTS"), ("lib/index.ts::module::default", "deep/d.ts::function::k", "RE_EXPORTS"),
    ("lib/one.ts::module::default", "deep/d.ts::function::f", "RE_EXPORTS"), ("lib/one.ts::module::default", "lib/index.ts::module::default", "RE_EXPORTS"),
    ("lib/two.ts::module::default", "deep/d.ts::module::default", "IMPORTS"),
    ("late.js::module::default", "a.ts::module::default", "IMPORTS"), ("late.js::module::default", "a.ts::function::run", "CALLS"),
}


def rows(spark, names, files=FILES):
    return spark.createDataFrame([(p, files[p], str(hash(files[p])), 1, 1) for p in names], incremental.CHANGED)


def extracted(store):
    return {tuple(r) for r in store.read("edges").where("edge_type <> 'CONTAINS'").collect()}


def both_ways(store):
    of = lambda t: sorted(tuple(r) for r in store.read(t).collect())
    assert of("edges") == of("edges_in")


@pytest.mark.parametrize("seed", [0, 1])
def test_edges_do_not_depend_on_the_dealing(spark, tmp_path, seed):
    r, store = random.Random(seed), SnapshotStore(spark, f"file://{tmp_path}/s", buckets=8)
    names = list(FILES)
    r.shuffle(names)
    cut = sorted(r.sample(range(1, len(names)), seed + 1))
    for lo, hi in zip([0, *cut], [*cut, len(names)]):
        incremental.index_batch(store, rows(spark, names[lo:hi]))
    assert extracted(store) == WANT
    both_ways(store)
    if seed == 1:
        # the definition goes and comes back: edges of files that did not change go and come with it
        incremental.index_batch(store, rows(spark, ["deep/d.ts"], {"deep/d.ts": "export function k() {}\n"}))
        assert extracted(store) == {e for e in WANT if not e[1].endswith(("::f", "::main"))}
        incremental.index_batch(store, rows(spark, ["deep/d.ts"]))
        assert extracted(store) == WANT
        incremental.index_batch(store, rows(spark, []), removed=spark.createDataFrame([("deep/d.ts",)], "file_path string"))
        assert extracted(store) == {e for e in WANT if not e[1].startswith("deep/")}
        both_ways(store)


def test_keywords_of_a_store_are_those_of_its_chunks(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4)
    texts = {f"{i}.md": f"# T{i}\nalpha beta{i % 3} " + "word " * i for i in range(9)} | {"e.md": ""}
    incremental.index_batch(store, rows(spark, texts, texts))
    incremental.index_batch(store, rows(spark, ["1.md", "2.md"], {"1.md": "# T1\nalpha gone word", "2.md": texts["2.md"]}))
    incremental.index_batch(store, rows(spark, [], texts), removed=spark.createDataFrame([("3.md",)], "file_path string"))

    def same():
        for q in ("alpha", "alpha word", "beta1", "gone", "nothing", "word word"):
            got, want = (sorted((r.id, round(r.score, 9), r.rank) for r in S.keyword_search(x, q).collect()) for x in (StoredKeywords(store), store.read("chunks")))
            assert got == want
            assert want or q == "nothing"

    same()
    assert store.read("dead_terms").count() == 2 and len(segments(store, "postings")) > 1
    merge_segments(store)
    assert store.read("dead_terms").count() == 0 and len(segments(store, "postings")) == 1
    same()
    # one term reads the folder of one bucket
    read = [f for f in StoredKeywords(store).of(["alpha"]).inputFiles() if "/postings/" in f]
    assert read and all(f"/bucket={store.bucket_of('alpha')}/" in f for f in read)


def test_segments_are_merged_when_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SEGMENTS", 3)
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=1)
    for i in range(4):
        incremental.index_batch(store, rows(spark, ["a.md"], {"a.md": f"# T\ncommon x{i}"}))
    assert len(segments(store, "postings")) < 3
    assert [r.id for r in S.keyword_search(StoredKeywords(store), "common x3").collect()] == ["a.md::doc::t#L0"]
    assert S.keyword_search(StoredKeywords(store), "x1").count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    where = f"file://{tmp_path}/s"
    SnapshotStore(spark, where, buckets=2).commit({"ledger": spark.createDataFrame([], schema.LEDGER)})
    failed = []

    def write(names):
        try:
            store = SnapshotStore(spark, where)
            for n in names:
                incremental.index_batch(store, rows(spark, [n]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    halves = list(FILES)[:3], list(FILES)[3:]
    threads = [threading.Thread(target=write, args=(h,)) for h in halves]
    for t in threads:
        t.start()
    for t in threads:
        t.join(600)
    store = SnapshotStore(spark, where)
    assert not failed and {r.file_path for r in store.read("chunks").collect()} == set(FILES)
    assert extracted(store) == WANT


def test_commit_from_an_old_state(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4)
    chunk = lambda p: spark.createDataFrame([(f"{p}::module::default", p, "module", "", 0, 0, False, None, "h")], schema.CHUNKS)
    base = store.commit({"chunks": chunk("a").where("false")})
    paths = sorted("abcdefgh", key=store.bucket_of)
    one = paths[0]
    other = next(p for p in paths if store.bucket_of(p) != store.bucket_of(one))
    store.commit({"chunks": chunk(one)}, {"chunks": [store.bucket_of(one)]}, base=base)
    # other buckets go together, the same ones do not, nor does what was read
    store.commit({"chunks": chunk(other)}, {"chunks": [store.bucket_of(other)]}, base=base)
    assert {r.file_path for r in store.read("chunks").collect()} == {one, other}
    with pytest.raises(schema.ConflictError):
        store.commit({"chunks": chunk(one)}, {"chunks": [store.bucket_of(one)]}, base=base)
    with pytest.raises(schema.ConflictError):
        store.commit({"scan_cache": store.read("scan_cache")}, base=base, read={"chunks": [store.bucket_of(one)]})
    now = store.current()
    assert not store._point(now) and store.current() == now
    session = lambda i, n, s: (i, n, s, 1, None, None, None)
    with pytest.raises(schema.EngineError, match="SESSION_ALREADY_ACTIVE"):
        store.commit({"sessions": spark.createDataFrame([session("1", "n", "active"), session("2", "n", "idle")], schema.SESSIONS)})
    assert store.drop(1)[0] == 2
    store.commit({"chunks": store.read("chunks").withColumn("content", F.lit("x"))})
    states, freed = store.drop(1)
    assert states == 1 and freed > 0 and {r.file_path for r in store.read("chunks").collect()} == {one, other}
    assert [d for d in os.listdir(tmp_path / "s") if d.startswith("v")] == [store.current()["name"]]


def test_steps_of_a_traversal_read_buckets(spark, tmp_path):
    r = random.Random(4)
    edges = list({(f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice("AB")) for _ in range(60)})
    df = spark.createDataFrame(edges, schema.EDGES)
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=16)
    store.commit({"edges": df})
    for depth, most in ((1, None), (3, None), (6, 10), (6, 50)):
        of = lambda x: sorted(map(tuple, neighbourhood(x, "n1", depth, most).collect()))  # noqa: B023, E731
        assert of(store) == of(df)
    paths = set(store.read("edges", [store.bucket_of("n1")]).inputFiles())
    assert paths < set(store.read("edges").inputFiles())


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "bad.ts").write_bytes(b"// caf\xe9\nexport function f() {}\n")
    (tmp_path / "t" / "good.ts").write_text('import { f } from "./bad";\nf();\n')
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    done = incremental.sync_tree(store, str(tmp_path / "t"))
    assert done[:3] == (2, 0, 3)
    assert ("good.ts::module::default", "bad.ts::function::f", "CALLS") in extracted(store)
    assert "caf�" in store.read("chunks").where("id = 'bad.ts::module::default'").first().content


def test_another_model_is_refused(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    incremental.index_batch(store, rows(spark, ["late.js"]), model=("local", "m", "1", 8))
    incremental.index_batch(store, rows(spark, ["a.ts"]), model=("local", "m", "1", 8))
    assert store.read("fingerprint").count() == 1
    with pytest.raises(schema.EngineError, match="FULL_REINDEX_REQUIRED"):
        incremental.index_batch(store, rows(spark, ["a.ts"]), model=("local", "m", "2", 8), now=F.current_timestamp())


def test_odd_vectors_are_left_out(spark):
    vectors = [("a", [1.0, 2.0]), ("b", [float("nan"), 0.0]), ("c", [0.0, 1.0]), ("d", [float("inf"), 1.0]), ("e", [1.0]), ("f", None), ("g", [None, 1.0])]
    df = spark.createDataFrame(vectors, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0])], "query_id int, query array<double>")
    found = S.nearest_batch(df, asked, 5, rows=2)
    assert sorted((r.query_id, r.id, r.rank) for r in found.collect()) == [(1, "a", 2), (1, "c", 1), (3, "e", 1)]
    plan = S.nearest_batch(df, asked, 5)._jdf.queryExecution().toString()
    assert "hashpartitioning(dim" not in plan and "SortMergeJoin" not in plan


def test_a_batch_sends_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    """Paths and ids compress to nothing, so that sizes of files would have let Spark broadcast whole tables."""
    plans, settled, write = [], incremental.settled, SnapshotStore._write
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(incremental, "settled", lambda df, *a, **b: (seen(df), settled(df, *a, **b))[1])
    monkeypatch.setattr(SnapshotStore, "_write", lambda self, name, table, df: (seen(df), write(self, name, table, df))[1])
    store = SnapshotStore(spark, str(tmp_path), buckets=2)
    incremental.index_batch(store, rows(spark, ["a.ts", "late.js"]))
    incremental.index_batch(store, rows(spark, [n for n in FILES if n not in ("a.ts", "late.js")]))
    assert extracted(store) == WANT
    assert len(plans) > 20 and not [p for p in plans if "BroadcastHashJoin" in p]
