import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import search as S
from skeinlake.schema import CHUNKS, EDGES


def chunk(id_, content="x", dead=False):
    return (id_, id_.split("::")[0], "function", content, 0, 0, dead, None, "")


@pytest.fixture()
def ranks(spark):
    return lambda *ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def order(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_fusion_prefers_shared_and_weighs_by_intent(ranks):
    assert order(S.fuse(ranks("v", "both"), ranks("f", "both")))[0] == "both"
    assert order(S.fuse(ranks("v"), ranks("f"), "semantic")) == ["v", "f"]
    assert order(S.fuse(ranks("v"), ranks("f"), "structural")) == ["f", "v"]
    top = S.fuse(ranks("v"), ranks("f")).orderBy("rank").first()
    assert abs(top.score - 0.7 / 61) < 1e-12


def test_fusion_cuts_to_twelve_and_breaks_ties(ranks):
    ids = [f"i{i:02d}" for i in range(20)]
    assert order(S.fuse(ranks(*ids), ranks())) == ids[:12]


def test_keyword_search_needs_all_terms_and_live_chunks(spark):
    c = spark.createDataFrame([chunk("a::x", "red red blue"), chunk("b::x", "red"), chunk("c::x", "red blue", True), chunk("d::x", "RED-blue, Blue red")], CHUNKS)
    assert set(order(S.keyword_search(c, "Red blue"))) == {"a::x", "d::x"}
    assert S.keyword_search(c, "``").count() == 0


def test_index_gives_what_the_chunks_give(spark):
    words = "red blue Élan élan a.b x::y green".split()
    rows = [chunk(f"f{i}::x", " ".join(words[(i * j) % 7] for j in range(i % 11)), i % 9 == 4) for i in range(80)] + [chunk("none::x", None)]
    c = spark.createDataFrame(rows, CHUNKS)
    index = S.keyword_index(c, 4)
    for query in ("red", "Elan red", "a.b x::y blue", "missing", "``", "red red green"):
        got, want = ([(r.id, round(r.score, 9), r["rank"]) for r in S.keyword_search(at, query).orderBy("rank").collect()] for at in (index, c))
        assert got == want
    plan = index.of(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(tok), EqualTo(tok,red)]" in plan


def test_nearest_batch_is_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(130, 6)).astype(np.float32).tolist()
    x[7] = x[99] = x[3]
    rows = [(str(i), v) for i, v in enumerate(x)] + [("short", [1.0]), ("null", None), ("hole", [None] * 6), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    asked = df.where("id in ('3', '20', '41', 'short', 'null')").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = S.nearest_batch(df, asked, 4, rows=50, asked=2).orderBy("query_id", "rank").collect()
    for q in ("3", "20", "41"):
        want = sorted((float(np.sqrt(((np.array(v, float) - np.array(x[int(q)], float)) ** 2).sum())), str(i)) for i, v in enumerate(x))[:4]
        assert [(round(y.distance, 9), y.id) for y in got if y.query_id == q] == [(round(d, 9), i) for d, i in want]
    assert [(y.id, y.distance) for y in got if y.query_id == "short"] == [("short", 0.0)] and not [y for y in got if y.query_id == "null"]


def test_rerank_gives_up_after_its_time(spark, ranks):
    c = ranks("a", "b").withColumns({"content": F.concat("id", F.lit("x")), "score": F.lit(0.5)})

    @F.pandas_udf("double")
    def slow(text: pd.Series) -> pd.Series:
        time.sleep(20)
        return text.str.len().astype(float)

    began = time.monotonic()
    kept, used = S.rerank(c, slow, 250)
    assert not used and order(kept) == ["a", "b"] and time.monotonic() - began < 15
    ranked, used = S.rerank(c, lambda t: F.when(t == "bx", 2.0).otherwise(1.0), 60_000)
    assert used and order(ranked) == ["b", "a"]


def test_substring_search_and_routing(spark):
    c = spark.createDataFrame([chunk("a::x", "see Foo::Bar here"), chunk("b::x", "foo::barx"), chunk("c::x", "nothing")], CHUNKS)
    assert order(S.substring_search(c, '"foo::bar"')) == ["b::x", "a::x"]
    assert S.substring_search(c, "fo").count() == 0
    assert S.routed_search(c, "nothing")[1] == "kw"
    assert S.routed_search(c, "oo::Ba")[1] == "sub"
    assert S.routed_search(c, "missing words")[1] == "none"


def test_hybrid_search_drops_the_dead_after_the_cut(spark):
    c = spark.createDataFrame([chunk("a::x", "alpha"), chunk("b::x", "beta", True), chunk("c::x", "alpha gamma")], CHUNKS)
    v = spark.createDataFrame([("a::x", [1.0, 0.0]), ("b::x", [1.0, 0.0]), ("ghost", [1.0, 0.0])], "id string, embedding array<float>")
    found, used = S.hybrid_search(c, v, "gamma", [1.0, 0.0])
    assert order(found) == ["a::x", "c::x"] and used is False
    found, used = S.hybrid_search(c, v, "gamma", [1.0, 0.0], logit=lambda t: F.length(t).cast("double"))
    assert order(found) == ["c::x", "a::x"] and used is True
    assert all(0 < r.score <= 1 for r in found.collect())
    with pytest.raises(ValueError):
        S.hybrid_search(c, v, "x", [1.0, 0.0], limit=21)


def test_investigate_notes(spark):
    empty = spark.createDataFrame([], CHUNKS)
    v = spark.createDataFrame([], "id string, embedding array<float>")
    edges = spark.createDataFrame([("a::x", "b::x", "CALLS")], EDGES)
    assert S.investigate(empty, v, edges, "q", embed=lambda q: [0.0])[1] == ["[METADATA: INDEX_EMPTY]"]
    c = spark.createDataFrame([chunk("a::x", "alpha"), chunk("b::x", "beta")], CHUNKS)
    assert S.investigate(c, v, edges, "zzz", embed=lambda q: [0.0])[1] == ["[METADATA: NO_MATCH]"]
    assert S.investigate(c, v, edges, "nobody", "structural")[1] == ["[METADATA: NO_GRAPH_EDGES]"]
    found, notes = S.investigate(c, v, edges, "a::x", "structural")
    assert order(found) == ["b::x"] and notes == []
    assert "--- CHUNK 1 score=1.0000 b::x" in S.render(found, None).first().text


def test_nearest_plan_is_a_top_k(spark):
    v = spark.createDataFrame([(str(i), [float(i)]) for i in range(100)], "id string, embedding array<float>")
    plan = S.nearest(v, [3.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert order(S.nearest(v, [3.0], 3)) == ["3", "2", "4"]


def test_nearest_batch_far_from_the_origin(spark):
    """Products of blocks only bound distances: what they cannot tell apart is computed, ties go by id."""
    rows = [(str(i), [1e6 + i % 7 * 1e-3, 1e6, -1e6]) for i in range(60)] + [("huge", [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1e6 + 2.2e-3, 1e6, -1e6])], "query_id long, query array<double>")
    want = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, [1e6 + 2.2e-3, 1e6, -1e6]))), i) for i, v in rows[:60])[:9]
    got = [(r.distance, r.id) for r in S.nearest_batch(df, asked, 9, rows=16).orderBy("rank").collect()]
    assert [i for _, i in got] == [i for _, i in want]
    assert max(abs(a - b) for (a, _), (b, _) in zip(got, want)) < 1e-9


def test_an_index_is_built_of_blocks_and_shuffles_no_single_posting(spark):
    """A row for each term of a piece, not for each term of a chunk; chunks of one id are counted together."""
    rows = [chunk(f"f{i}::x", "red " * (i % 3 + 1) + "blue x y z"[: i % 11], i % 9 == 4) for i in range(60)] + [chunk("none::x", None), chunk("e::x", "")]
    for more in ([], [chunk("f1::x", "red Élan"), chunk("f1::x", "new"), chunk("f4::x", "red")]):
        c = spark.createDataFrame(rows + more, CHUNKS).coalesce(1)
        got, want = (sorted((x.tok, x.id, x.tf) for x in found.collect()) for found in (S.keyword_index(c, 4).postings, S.postings(c)))
        assert got == want and len({(t, i) for t, i, _ in got}) == len(got)
    blocks = S.posting_blocks(spark.createDataFrame(rows, CHUNKS).coalesce(1))
    assert blocks.count() == len({t for t, _, _ in want} - {"new", "elan"}) < len(want) / 5
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_trigrams_are_indexed_in_blocks(spark):
    texts = ["aBcab", "ab", "", None, "ééé é", "İstanbul \U0001f600\U0001f601\U0001f600\x00b", "abcabc"]
    c = spark.createDataFrame([chunk(f"f{i}::x", t, i == 6) for i, t in enumerate(texts)], CHUNKS).coalesce(1)
    blocks = S.trigram_blocks(c)
    got, want = (sorted(map(tuple, found.select("tri", "id").collect())) for found in (blocks.select("tri", F.explode("ids").alias("id")), S.trigram_postings(c)))
    assert got == want and blocks.count() == len({t for t, _ in want})
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    wide = "".join(map(chr, range(0x10000, 0x110000)))  # too many code points for ten texts at a time
    found = [(points[run[row == r] // len(points) ** 2][0], r) for points, run, row in S._runs([wide, *["abc"] * 9]) for r in np.unique(row)]
    assert found == [(0x10000, 0), *((ord("a"), i) for i in range(1, 10))]
