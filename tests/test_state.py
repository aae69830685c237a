import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlake import __main__ as cli
from skeinlake import schema
from skeinlake.operators import evaluate as E
from skeinlake.operators import health as H
from skeinlake.operators import merge as M
from skeinlake.operators import sessions as D
from skeinlake.plans import queries as Q
from skeinlake.plans import tables
from skeinlake.sources import connectors, reports, tree
from skeinlake.sources.snapshots import SnapshotStore, VectorStore
from skeinlake.streaming import incremental

NOW = datetime(2024, 2, 1)


def corpus(spark, rows):
    full = [(f"{p}::{k}::{i}", p, k, "x" * n, 0, 0, dead, at, "h") for i, (p, k, n, dead, at) in enumerate(rows)]
    return spark.createDataFrame(full, schema.CHUNKS)


def test_health_verdicts(spark):
    of = lambda rows: H.report(corpus(spark, [(p, k, n, False, None) for p, k, n in rows])).first()
    assert H.report(None) is None
    empty = of([])
    assert empty.verdict == "WARN" and empty.avg_chars is None
    assert of([("a/f", "module", 150)] * 3 + [("a/f", "doc", 150)] * 2).verdict == "WARN"
    assert of([("a/f", "module", 150)] * 2 + [("a/f", "doc", 150)]).verdict == "DEGRADED"
    assert of([("a/f", "doc", 80)] + [("a/f", "doc", 150)] * 4).verdict == "WARN"
    assert of([("a/f", "doc", 80)] * 2 + [("a/f", "doc", 150)] * 2).verdict == "DEGRADED"
    assert of([("node_modules/f", "doc", 150)] * 2).verdict == "DEGRADED"
    good = of([("src/f", "doc", 201)] * 3 + [("b/f", "class", 200)] * 2)
    assert good.verdict == "HEALTHY" and good.avg_chars == 200 and good.prefixes[0].prefix == "src" and good.prefixes[0].n == 3


def test_garbage(spark):
    old, new = datetime(2020, 1, 1), NOW - timedelta(days=3)
    c = corpus(spark, [("a", "doc", 1, True, old), ("b", "doc", 1, True, new), ("c", "doc", 1, False, old), ("d", "doc", 1, True, None)])
    kept, gone = H.collect_garbage(c, 30, F.lit(NOW))
    assert [r.id for r in gone.collect()] == ["a::doc::0"] and kept.count() == 3
    again, none = H.collect_garbage(kept, 30, F.lit(NOW))
    assert none.count() == 0 and again.count() == 3
    assert H.gc_state(c).first().due and not H.gc_state(c.where("false")).first().due


def test_merge_updates_inserts_deletes_and_revives(spark):
    row = lambda i, text, dead=False: (i, "f", "doc", text, 0, 0, dead, NOW if dead else None, text)
    old = spark.createDataFrame([row("a", "1"), row("b", "1"), row("c", "1", True), ("z", "g", "doc", "1", 0, 0, False, None, "1")], schema.CHUNKS)
    new = spark.createDataFrame([row("a", "2"), row("c", "2"), row("d", "2")], schema.CHUNKS)
    files = spark.createDataFrame([("f",)], "file_path string")
    got = {r.id: (r.content, r.is_deleted) for r in M.merge_chunks(old, new, files, F.lit(NOW)).collect()}
    assert got == {"a": ("2", False), "b": ("1", True), "c": ("2", False), "d": ("2", False), "z": ("1", False)}
    assert {r.id: r.action for r in M.changes(old, new, files).collect()} == {"a": "update", "b": "delete", "c": "insert", "d": "insert"}
    stored = M.stamp_fingerprint(spark.createDataFrame([], schema.FINGERPRINT), "local", "m", "1", 256, F.lit(NOW))
    M.check_fingerprint(stored, "local", "m", "1", 256)
    with pytest.raises(schema.EngineError, match="FULL_REINDEX_REQUIRED"):
        M.check_fingerprint(stored, "local", "m", "2", 256)


def test_edges_follow_a_merge(spark):
    c = spark.createDataFrame([("f::module::default", "f", "module", "", 0, 0, False, None, ""), ("f::function::g", "f", "function", "", 0, 0, False, None, "")], schema.CHUNKS)
    old = spark.createDataFrame([("f::function::g", "gone", "CALLS"), ("x", "f::function::g", "CALLS")], schema.EDGES)
    none = spark.createDataFrame([], schema.EDGES)
    assert {tuple(r) for r in M.merge_edges(old, c, c, none).collect()} == {("f::module::default", "f::function::g", "CONTAINS")}


def test_metrics(spark):
    q = spark.createDataFrame([("a", "easy", ["1", "3"]), ("b", "hard", ["9"]), ("c", "hard", ["9"])], "query_id string, difficulty string, relevant_chunks array<string>")
    r = spark.createDataFrame([("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 1, "7"), ("b", 2, "9")], "query_id string, rank int, chunk_id string")
    j = E.per_query(q, r)
    got = {x.query_id: x for x in j.collect()}
    assert got["a"].precision_at_1 == 1 and got["a"].precision_at_5 == 0.4 and abs(got["a"].ndcg_at_10 - 1.5 / (1 + 1 / 1.584962500721156)) < 1e-9
    assert got["b"].reciprocal_rank == 0.5 and got["c"].zero_result and got["c"].reciprocal_rank == 0
    s = E.summary(j).first()
    assert s.mrr == 0.75 and s.zero_results == 1 and abs(s.precision_at_1 - 1 / 3) < 1e-12
    levels = {x.difficulty: x.n_queries for x in E.by_difficulty(j).collect()}
    assert levels == {"easy": 1, "medium": 0, "hard": 2}
    assert {x["diff"] for x in E.baseline_diff(E.summary(j), E.summary(j)).collect()} == {0.0}


def test_sessions(spark):
    s = spark.createDataFrame([], schema.SESSIONS)
    t = spark.createDataFrame([], schema.TURNS)
    s, a, what = D.spawn(s, "n", "s1", NOW, D.hash_secret("k", "salt"))
    assert (a, what) == ("s1", "created") and D.spawn(s, "n", "s2", NOW)[1:] == ("s1", "attached")
    with pytest.raises(schema.EngineError, match="SESSION_ALREADY_ACTIVE"):
        D.spawn(s, "other", "s3", NOW)
    t = D.append_turn(D.append_turn(t, "s1", "user", "hi", NOW), "s1", "oracle", '{"text": "yo"}', NOW)
    assert [r.turn_index for r in D.transcript(t, "s1").collect()] == [0, 1]
    assert [r[0] for r in D.transcript(t, "s1").select(D.turn_text(F.col("content"))).collect()] == ["hi", "yo"]
    idle = D.reap_idle(s, t, F.lit(NOW + timedelta(minutes=31)))
    told = D.idle_notices(s, t, F.lit(NOW + timedelta(minutes=31))).collect()
    assert [(x.session_id, x.turn_index, x.role, x.content) for x in told] == [("s1", 2, "system", schema.IDLE_NOTICE)]
    assert D.idle_notices(s, t, F.lit(NOW + timedelta(minutes=29))).isEmpty() and D.idle_notices(idle, t, F.lit(NOW + timedelta(minutes=31))).isEmpty()
    assert idle.first().status == "idle" and D.spawn(idle, "n", "s9", NOW)[1:] == ("s1", "reactivated")
    with pytest.raises(schema.EngineError, match="DECOMMISSION_DENIED"):
        D.decommission(s, t, "s1", "wrong", NOW)
    closed, turns = D.decommission(s, t, "s1", "k", NOW)
    assert turns.count() == 0 and closed.first().secret_hash is None
    with pytest.raises(schema.EngineError, match="SESSION_NOT_FOUND"):
        D.ensure_active(closed, "s1", NOW)
    assert D.spawn(closed, "n", "s2", NOW)[0].agg(F.max("generation_id")).first()[0] == 2


def test_a_session_takes_five_requests_at_most():
    queue, go, done, started = D.SessionQueue(5), threading.Event(), [], threading.Semaphore(0)

    def request():
        started.release()
        go.wait(60)
        done.append(1)

    def ask():
        queue.run("s", request)

    threads = [threading.Thread(target=ask) for _ in range(5)]
    for t in threads:
        t.start()
    started.acquire(timeout=60)
    while queue._held["s"][1] < 5:
        pass
    with pytest.raises(schema.EngineError, match="SESSION_BUSY"):
        queue.run("s", request)
    assert queue.run("other", lambda: 7) == 7
    go.set()
    for t in threads:
        t.join(60)
    assert len(done) == 5 and queue.run("s", lambda: 8) == 8


def test_context_drops_the_oldest_turns(spark):
    t = spark.createDataFrame([("s", i, "user", "x" * 10, NOW) for i in range(5)], schema.TURNS)
    assert sorted(r.turn_index for r in D.trim_context(t, 45, 20).collect()) == [3, 4]
    D.check_budget(10, 10)
    with pytest.raises(schema.EngineError, match="CONTEXT_BUDGET_EXCEEDED"):
        D.check_budget(11, 10)


def test_decisions(spark, tmp_path):
    c = corpus(spark, [("src/a.ts", "module", 5, False, None)]).withColumn("id", F.lit("src/a.ts::module::default"))
    ledger, edges = spark.createDataFrame([], schema.LEDGER), spark.createDataFrame([], schema.EDGES)
    d = {"title": "Use It / now", "context_and_problem": "a\nb", "decision_outcome": "c", "decision_drivers": ["x"]}
    ledger, edges, first = D.commit_decision(ledger, edges, c, d, ["src/a.ts"], NOW)
    ledger, edges, second = D.commit_decision(ledger, edges, c, d | {"supersedes": first}, [], NOW)
    assert (first, second) == ("MADR-001", "MADR-002") and edges.count() == 1
    assert {r.id: r.status for r in ledger.collect()} == {"MADR-001": "superseded", "MADR-002": "accepted"}
    with pytest.raises(schema.EngineError, match="INVALID_GRAPH_ENDPOINT"):
        D.commit_decision(ledger, edges, c, d, ["src/none.ts"], NOW)
    note = D.decision_note(ledger).where("id = 'MADR-002'").first()
    assert note.file_name == "MADR-002-use-it-now.md" and "> This decision supersedes [[MADR-001]]" in note.note and "  a\n  b" in note.note
    reports.write_notes(ledger, str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes")).count() > 10


def test_tree_scan(spark, tmp_path):
    for path, data in {"a.ts": b"x", "b.bin": b"x", "nul.ts": b"a\0b", "skip/c.ts": b"x", "sub/.gitignore": b"*.md\n!keep.md\n", "sub/d.md": b"x", "sub/keep.md": b"x", ".gitignore": b"skip/\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    listing = tree.scan_tree(spark, str(tmp_path))
    assert sorted(r.file_path for r in listing.collect()) == ["a.ts", "nul.ts", "sub/keep.md"]
    files = tree.read_contents(listing)
    cache = spark.createDataFrame([], schema.SCAN_CACHE)
    changed = tree.changed_files(files, cache)
    assert sorted(r.file_path for r in changed.collect()) == ["a.ts", "sub/keep.md"]
    cache = tree.refreshed_cache(cache, changed, F.lit(NOW))
    assert tree.changed_files(files, cache).count() == 0
    touched = files.withColumn("mtime_ns", F.col("mtime_ns") + 1)
    assert tree.changed_files(touched.where("file_path <> 'nul.ts'"), cache).count() == 0
    assert tree.changed_files(files, cache, force=True).count() == 2
    assert [r.file_path for r in tree.vanished_files(listing.where("file_path <> 'a.ts'"), cache).collect()] == ["a.ts"]
    assert tree.under(listing, "sub").count() == 1
    with pytest.raises(schema.EngineError, match="INVALID_PATH"):
        tree.under(listing, "../x")
    assert tree.completed_rules(["dist/"])[:2] == ["dist/", "node_modules/"]


def test_snapshots_and_index_stream(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.read("chunks").count() == 0
    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(r, "file_path string, content string, content_hash string")
    rows(("a.ts", "function f() {}\n", "1")).write.json(str(source / "1"))
    incremental.index_stream(spark, f"{source}/*", store, str(tmp_path / "check")).awaitTermination()
    assert {r.id for r in store.read("chunks").collect()} == {"a.ts::module::default", "a.ts::function::f"}
    rows(("a.ts", "function g() {}\n", "2")).write.json(str(source / "2"))
    incremental.index_stream(spark, f"{source}/*", store, str(tmp_path / "check")).awaitTermination()
    assert {r.id: r.is_deleted for r in store.read("chunks").collect()} == {"a.ts::module::default": False, "a.ts::function::f": True, "a.ts::function::g": False}
    store.commit({"edges": spark.createDataFrame([("a", "b", "CALLS")], schema.EDGES)})
    assert store.drop_old(1) == 2 and store.read("edges").count() == 1 and store.read("chunks").count() == 3


def test_newest_version_wins_and_bad_files_are_counted(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store", buckets=8)
    rows = lambda *r: spark.createDataFrame(r, incremental.CHANGED)
    embed = lambda chunks: connectors.hash_embedding(chunks, 8)
    b = 'import { f } from "./a";\nexport function g() { f(); }\n'
    deep = "a{" * 5000 + "}" * 5000
    done = incremental.index_batch(store, rows(("a.ts", "function old() {}\n", "ff", 1, 1), ("a.ts", "export function f() {}\n", "00", 2, 1), ("b.ts", b, "1", 1, 1), ("deep.css", deep, "1", 1, 1)), embed=embed, number=0)
    assert (done.succeeded, done.failed, done.chunks) == (2, 1, 4) and done.errors[0][0] == "deep.css"
    assert {r.id for r in store.read("chunks").collect()} == {f"{p}::{x}" for p, x in (("a.ts", "module::default"), ("a.ts", "function::f"), ("b.ts", "module::default"), ("b.ts", "function::g"))}
    edges = {tuple(r) for r in store.read("edges").collect()}
    assert ("b.ts::function::g", "a.ts::function::f", "CALLS") in edges and ("a.ts::module::default", "a.ts::function::f", "CONTAINS") in edges
    assert store.read("vectors").count() == 4 and {(r.file_path, r.mtime_ns) for r in store.read("scan_cache").collect()} == {("a.ts", 2), ("b.ts", 1)}
    # a batch that is run again changes nothing; another one writes its buckets alone
    before = store.current()
    assert incremental.index_batch(store, rows(("a.ts", "x", "9", 9, 1)), number=0).succeeded == 0 and store.current() == before
    incremental.index_batch(store, rows(("c.ts", "type T = string;\n", "1", 1, 1)), embed=embed, number=1)
    moved = {k for k, v in store.current()["tables"]["chunks"].items() if before["tables"]["chunks"].get(k) != v}
    assert len(moved) == 1 and store.read("chunks").count() == 6
    # a chunk that goes takes the edges of other files with it
    incremental.index_batch(store, rows(("a.ts", "let x;\n", "3", 3, 1)), embed=embed)
    assert "CALLS" not in {r.edge_type for r in store.read("edges").collect()} and ("b.ts::module::default", "a.ts::module::default", "IMPORTS") in {tuple(r) for r in store.read("edges").collect()}
    assert store.read("vectors").where("id = 'a.ts::function::f'").count() == 0
    with pytest.raises(schema.EngineError, match="INDEX_BATCH_FAILED"):
        incremental.index_batch(store, rows(("deep.css", deep, "1", 1, 1)))
    assert store.drop_old(1) == 2 and store.read("chunks").count() == 6
    incremental.force_index(store, rows(("b.ts", b, "1", 1, 1)))
    assert {r.file_path for r in store.read("chunks").where("not is_deleted").collect()} == {"b.ts"}


def test_tree_in_one_call(spark, tmp_path, capsys):
    root = tmp_path / "src"
    (root / "lib").mkdir(parents=True)
    (root / "a.ts").write_text('import { f } from "./lib/b";\nf();\n')
    (root / "lib" / "b.ts").write_text("export function f() { return 1; }\n")
    (root / "no.bin").write_text("x")
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    embed = lambda chunks: connectors.hash_embedding(chunks, 16)
    assert incremental.sync_tree(store, str(root), embed=embed)[:3] == (2, 0, 3)
    assert ("a.ts::module::default", "lib/b.ts::function::f", "CALLS") in {tuple(r) for r in store.read("edges").collect()}
    assert incremental.sync_tree(store, str(root), embed=embed).succeeded == 0
    assert incremental.sync_tree(store, str(root), "lib", force=True, embed=embed)[:3] == (1, 0, 2)
    (root / "a.ts").unlink()
    incremental.sync_tree(store, str(root), embed=embed)
    assert {r.id for r in store.read("chunks").where("not is_deleted").collect()} == {"lib/b.ts::module::default", "lib/b.ts::function::f"}
    cli.main(["search", f"file://{tmp_path}/store", "function"], spark)
    cli.main(["health", f"file://{tmp_path}/store"], spark)
    cli.main(["collect", f"file://{tmp_path}/store", "--days", "0"], spark)
    out = capsys.readouterr().out
    assert "--- CHUNK 1 score=" in out and "lib/b.ts" in out and "total_chunks: 2" in out and "collected: 1" in out
    assert store.read("chunks").count() == 2


def test_indexer_pauses_and_resumes(spark, tmp_path):
    store, seen = SnapshotStore(spark, f"file://{tmp_path}/store"), []
    rows = lambda *r: spark.createDataFrame(r, incremental.CHANGED)
    rows(("a.go", "func A() {\n}\n", "1", 1, 1)).write.json(str(tmp_path / "in" / "1"))
    indexer = incremental.Indexer(spark, f"{tmp_path}/in/*", store, str(tmp_path / "check"), done=seen.append).resume()
    indexer.query.awaitTermination()
    assert indexer.heartbeat()["batch"] == 0
    indexer.pause()
    rows(("b.go", "func B() {\n}\n", "1", 1, 1)).write.json(str(tmp_path / "in" / "2"))
    indexer.resume().query.awaitTermination()
    assert [x.succeeded for x in seen] == [1, 1] and store.read("chunks").count() == 4


def test_migration_of_a_state(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.commit({"fingerprint": spark.createDataFrame([("local", "m", "1", 8, "none", NOW)], schema.FINGERPRINT)})
    with pytest.raises(schema.EngineError, match="FULL_REINDEX_REQUIRED"):
        store.migrate({}, schema.VERSION + 1)
    fixed = lambda tables: {"fingerprint": tables["fingerprint"].withColumn("normalization", F.lit("l2"))}
    assert store.migrate({schema.VERSION + 1: fixed}, schema.VERSION + 1) == schema.VERSION + 1
    assert store.read("fingerprint").first().normalization == "l2" and store.current()["version"] == schema.VERSION + 1
    with pytest.raises(schema.EngineError, match="newer|version"):
        store.migrate({})


def test_scratch_of_two_threads_are_apart(spark):
    inside, go = threading.Event(), threading.Event()

    def other():
        with tables.scratch(spark):
            inside.set()
            go.wait(60)

    worker = threading.Thread(target=other)
    worker.start()
    inside.wait(60)
    with tables.scratch(spark) as kept:
        mine = tables.settled(spark.range(3))
        kept.append(mine)
        go.set()
        worker.join()
        gone = tables.settled(spark.range(4))
        assert mine.count() == 3
    assert mine.count() == 3
    tables.forget(mine)
    for df in (gone, mine):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
            df.count()


def test_session_stream(spark, tmp_path):
    ts = [(1, datetime(2024, 1, 1, 0, m)) for m in (0, 10, 20)] + [(1, datetime(2024, 1, 1, 2, 0)), (2, datetime(2024, 1, 1, 5, 0))]
    df = spark.createDataFrame(ts, "user_id bigint, ts timestamp")
    assert sorted(r.n for r in incremental.session_windows(df).collect()) == [1, 1, 3]
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path / "e"))
    out = []
    incremental.stream_sessions(stream, lambda b, i: out.extend(b.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.n for r in out) == [1, 3]


def test_connectors(spark):
    assert [connectors.backoff_ms(i) for i in (0, 1, 9)] == [500, 1000, 30_000] and connectors.backoff_ms(0, 2) == 2000
    calls = []

    class Busy(Exception):
        retry = True

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return ["ok"]

    assert connectors.with_retries(flaky, sleep=lambda s: None) == ["ok"]
    c = corpus(spark, [("a", "doc", 3, False, None), ("b", "doc", 5, False, None)])
    got = connectors.embed_chunks(c, lambda texts: [[float(len(t)), 0.0, 9.0] for t in texts], 2).collect()
    assert all(abs(r.embedding[0] - 1) < 1e-6 and len(r.embedding) == 2 for r in got)
    mixed = lambda texts: [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]
    by_index = {r.id: r.embedding for r in connectors.embed_chunks(c, mixed, 2).collect()}
    assert all(abs(v[0] / v[1] - (3 if k.startswith("a") else 5)) < 1e-5 for k, v in by_index.items())
    h = connectors.hash_embedding(c, 8)
    assert h.count() == 2 and VectorStore(h).upsert(h).vectors.count() == 2 and VectorStore(h).query([0.0] * 8, 1).count() == 1
    with pytest.raises(schema.EngineError, match="AUTH_INVALID"):
        connectors.ask(lambda p: (_ for _ in ()).throw(PermissionError()), [], "q")


def test_query_sets_and_reports(spark, tmp_path):
    text = "- id: a\n  query: \"how: x\"\n  type: semantic\n  difficulty: easy\n  relevant_chunks:\n    - f::module::default\n- id: b\n  query: y\n  type: semantic\n  difficulty: hard\n  relevant_chunks: [u, v]\n"
    q = reports.parse_query_set(spark, text)
    assert {r.id: r.relevant_chunks for r in q.collect()} == {"a": ["f::module::default"], "b": ["u", "v"]}
    q.write.json(str(tmp_path / "q"))
    assert reports.read_query_set(spark, str(tmp_path / "q")).count() == 2
    q.withColumn("type", F.lit("odd")).write.json(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="bad query"):
        reports.read_query_set(spark, str(tmp_path / "bad")).collect()
    j = E.per_query(q.select(F.col("id").alias("query_id"), "difficulty", "relevant_chunks"), spark.createDataFrame([("a", 1, "f::module::default")], "query_id string, rank int, chunk_id string"))
    reports.write_run(j, E.summary(j), E.by_difficulty(j), spark.range(1), str(tmp_path / "run"))
    assert reports.newest_run(spark, str(tmp_path / "none")) is None
    os.utime(tmp_path / "run", (1, 1))
    assert reports.newest_run(spark, str(tmp_path)).rstrip("/").endswith(("bad", "q"))
    assert "- Precision@1: 0.5000" in [r.value for r in spark.read.text(str(tmp_path / "run/summary_md")).collect()]


def test_judged_by_a_rule_lists_no_labels(spark):
    queries = spark.createDataFrame([(1, "easy", ["a", "b", "a"]), (2, "hard", ["c"])], "query_id long, difficulty string, relevant_chunks array<string>")
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "b")], "query_id long, rank int, chunk_id string")
    counted = spark.createDataFrame([(1, "easy", 2), (2, "hard", 1)], "query_id long, difficulty string, n_relevant long")
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True)], "query_id long, rank int, hit boolean")
    assert sorted(map(tuple, E.per_query(queries, results).collect())) == sorted(map(tuple, E.judge(counted, hits).collect()))
    plan = Q.judged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_settled_leaves_no_shuffle_files(spark):
    was = spark.conf.get(tables.RELEASE, None)
    kept = lambda: sum(x.startswith("shuffle_") for d in dirs for _, _, names in os.walk(d) for x in names)
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    before = kept()
    out = tables.settled(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    until = time.monotonic() + 10  # they go in the background
    while kept() > before and time.monotonic() < until:
        time.sleep(0.1)
    assert kept() <= before and out.count() == 7
    assert spark.conf.get(tables.RELEASE, None) == was


def test_released_gives_back_what_was_set(spark):
    with tables.released(spark):
        with tables.released(spark):
            assert spark.conf.get(tables.RELEASE) == "true"
        assert spark.conf.get(tables.RELEASE) == "true"
    assert spark.conf.get(tables.RELEASE, None) is None
    spark.conf.set(tables.RELEASE, "false")
    try:
        with pytest.raises(ValueError), tables.released(spark):
            raise ValueError
        assert spark.conf.get(tables.RELEASE) == "false"
    finally:
        spark.conf.unset(tables.RELEASE)
