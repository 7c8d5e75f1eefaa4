"""Every registered query against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphmill import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    result = duck.execute(registry.ORACLES[name])
    expected = canonical(result.fetchall(), [d[0] for d in result.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == expected


def test_entry_and_registry(spark):
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["node", "class"]


def test_fixture_counts_of_the_part_graph(spark):
    counts = {r["class"]: r.n for r in registry.QUERIES["class_counts"](spark, DATA).collect()}
    assert counts == {"live": 106, "possible": 39, "test_only": 4, "dead": 51}


def test_printed_report(spark):
    lines = [r.text for r in registry.QUERIES["code_report"](spark, DATA).where("project = 'cycle'").collect()]
    assert lines == ["  main.zig", "    2:4: fn ping (cycle of 2: ping, pong)", "    8:4: fn again (cycle of 1: again)"]
    lines = [r.text for r in registry.QUERIES["code_report"](spark, DATA).where("project = 'rollup'").collect()]
    assert lines == ["  main.zig", "    2:4: fn gone (+3 nested)"]
