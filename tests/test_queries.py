import os

import duckdb
import pytest

import __spark_entry__ as entry
from skeinlake.plans import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: float(x) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return [names[i] for i in at], sorted(repr([value(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    found = engine.queries()[name](spark, SF)
    want = duck.execute(engine.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_decisions_are_dealt_once_by_a_number_that_grows(spark, monkeypatch):
    monkeypatch.setattr(engine, "PART", 500)
    found = engine.queries()["implements_edges"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ObjectHashAggregate" not in plan and "BroadcastHashJoin" not in plan
    n = sum(engine.table(spark, SF, t).count() for t in ("lineitem", "orders"))
    assert found.rdd.getNumPartitions() == -(-n // 500)


def test_chunks_in_order_are_dealt_once_by_a_number_that_grows(spark, monkeypatch):
    monkeypatch.setattr(engine, "PART", 500)
    found = engine.queries()["chunk_order"](spark, SF)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.rdd.getNumPartitions() == -(-engine.table(spark, SF, "lineitem").count() // 500)
