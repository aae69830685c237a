from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skeinlake.operators import graph as G
from skeinlake.schema import EDGES


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], EDGES)


def depths(df):
    return {r.node_id: r.depth for r in df.collect()}


def test_depths_both_ways_and_cycles(spark):
    assert depths(G.neighbourhood(edges(spark, ("a", "b"), ("b", "c")), "a")) == {"b": 1, "c": 2}
    assert depths(G.neighbourhood(edges(spark, ("a", "b"), ("b", "a")), "a")) == {"b": 1}
    assert depths(G.neighbourhood(edges(spark, ("b", "a")), "a")) == {"b": 1}
    assert depths(G.neighbourhood(edges(spark, ("x", "y")), "a")) == {}


def test_bounds(spark):
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(8)])
    assert set(depths(G.neighbourhood(chain, "n0"))) == {f"n{i}" for i in range(1, 7)}
    assert set(depths(G.neighbourhood(chain, "n0", 2))) == {"n1", "n2"}
    star = edges(spark, *[("hub", f"s{i:02d}") for i in range(60)])
    assert sorted(depths(G.neighbourhood(star, "hub"))) == [f"s{i:02d}" for i in range(50)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=14))
def test_depth_is_the_shortest_path(spark, pairs):
    want, frontier, d = {"0": 0}, {"0"}, 0
    while frontier and d < 6:
        d += 1
        frontier = {str(y) for a, b in pairs for x, y in ((a, b), (b, a)) if str(x) in frontier} - set(want)
        want |= dict.fromkeys(frontier, d)
    del want["0"]
    assert depths(G.neighbourhood(edges(spark, *[(str(a), str(b)) for a, b in pairs]), "0")) == want


def test_validation_and_stores(spark):
    e = edges(spark, ("a", "b"), ("a", "zz"))
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert G.valid_edges(e, nodes).count() == 1
    store = G.GraphStore(e).insert(e)
    assert store.edges.count() == 2
    assert store.delete(spark.createDataFrame([("zz",)], "id string")).edges.count() == 1


def test_containment(spark):
    rows = [("f::class::C::method::m", "method", "f"), ("f::class::C", "class", "f"), ("f::function::g", "function", "f"), ("f::type::T", "type", "f")]
    got = {(r.source_id, r.target_id) for r in G.contains_edges(spark.createDataFrame(rows, "id string, chunk_type string, file_path string")).collect()}
    assert got == {("f::class::C", "f::class::C::method::m"), ("f::module::default", "f::class::C"), ("f::module::default", "f::function::g")}
