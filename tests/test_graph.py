"""Graph operators: both strategies agree with each other and with a plain solution on random graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.operators import components, reach, rollup

KINDS = ["definite", "possible", "unknown"]


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes), rng.choice(KINDS)) for _ in range(edges)}), sorted(rng.sample(range(nodes), max(1, nodes // 10)))


def plain_reach(edges, roots):
    def close(start, kinds, stop):
        seen, todo = set(start) - stop, list(set(start) - stop)
        while todo:
            at = todo.pop()
            for a, b, k in edges:
                if a == at and k in kinds and b not in seen and b not in stop:
                    seen.add(b)
                    todo.append(b)
        return seen

    sure = close(roots, KINDS[:2], set())
    seeds = {b for a, b, k in edges if k == "unknown" and a in sure and b not in sure}
    return sure, close(seeds, KINDS, sure)


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 10, 15), (2, 40, 70), (3, 120, 150)])
@pytest.mark.parametrize("small", [reach.SMALL, 0])
def test_reachability(spark, seed, nodes, n, small):
    edges, roots = random_graph(seed, nodes, n)
    df = spark.createDataFrame(edges, "src bigint, dst bigint, kind string")
    got = reach.reachability(df, spark.createDataFrame([(r,) for r in roots], "node bigint"), small=small).collect()
    sure, maybe = plain_reach(edges, roots)
    assert {r.node for r in got if not r.possible} == sure
    assert {r.node for r in got if r.possible} == maybe
    assert len(got) == len(sure) + len(maybe)


def test_reachability_of_nothing(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint, kind string")
    assert reach.reachability(none, spark.createDataFrame([], "node bigint")).count() == 0
    assert [tuple(r) for r in reach.reachability(none, spark.createDataFrame([(5,), (None,)], "node bigint")).collect()] == [(5, False)]


def plain_components(nodes, edges):
    sure = {(a, b) for a, b, k in edges if k != "unknown"}
    to = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in sure:
            new = to[b] - to[a]
            if new:
                to[a] |= new
                changed = True
    out = {}
    for n in nodes:
        mates = {m for m in to[n] if n in to[m]}
        out[n] = (min(mates), len(mates), any(a in mates and b in mates for a, b in sure))
    return out


@pytest.mark.parametrize(("seed", "nodes", "n"), [(4, 8, 12), (5, 25, 40), (6, 40, 45)])
@pytest.mark.parametrize("small", [reach.SMALL, 0])
def test_components(spark, seed, nodes, n, small):
    edges, _ = random_graph(seed, nodes, n)
    got = components.components(spark.range(nodes).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "src bigint, dst bigint, kind string"), small=small)
    assert {r.node: (r.component, r.n, r.cyclic) for r in got.collect()} == plain_components(range(nodes), edges)


def test_long_chain_needs_no_recursion():
    n = 50_000
    found = components.strong_components(np.arange(n + 1), np.append(np.arange(1, n), 0))
    assert set(found.tolist()) == {0}


def test_an_owner_far_up_is_found(spark):
    owners = spark.createDataFrame([(i, i - 1 if i else None) for i in range(140)], "node int, owner int")
    near = rollup.nearest(rollup.ancestors(owners), spark.createDataFrame([(0,)], "node int"))
    assert near.where("nearest = 0").count() == 140
    assert rollup.nearest_marked(owners, spark.createDataFrame([(0,)], "node int")).where("nearest = 0").count() == 140


def test_rollup_and_ancestors(spark):
    # 0 > 1 > 2 > 3, 0 > 4; dead: 1, 2, 3, 4
    owners = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (4, 0)], "node bigint, owner bigint")
    dead = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node bigint")
    outer = rollup.outermost(dead, owners)
    assert {r.node: r.outermost for r in outer.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.outermost: r.nested for r in rollup.nested_counts(outer).collect()} == {1: 2, 4: 0}
    ancestry = rollup.ancestors(owners)
    assert {(r.node, r.ancestor, r.depth) for r in ancestry.where("node = 3").collect()} == {(3, 3, 0), (3, 2, 1), (3, 1, 2), (3, 0, 3)}
    near = rollup.nearest(ancestry, spark.createDataFrame([(1,)], "node bigint"))
    assert {r.node: r.nearest for r in near.collect()} == {0: None, 1: 1, 2: 1, 3: 1, 4: None}
    assert {tuple(r) for r in rollup.nearest_marked(owners, spark.createDataFrame([(1,), (1,)], "node bigint")).collect()} == {(0, None), (1, 1), (2, 1), (3, 1), (4, None)}


def test_first_match_keeps_one_row_a_group(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert {(r.k, r.v) for r in rollup.first_match(rows, ["k"], ["v"]).collect()} == {("a", 1), ("b", 3)}


def test_classes_follow_precedence(spark):
    nodes = spark.range(5).withColumnRenamed("id", "node")
    production = spark.createDataFrame([(0, False), (1, True)], "node bigint, possible boolean")
    test = spark.createDataFrame([(0, False), (1, False), (2, False), (3, True)], "node bigint, possible boolean")
    got = {r.node: r["class"] for r in reach.classify(nodes, production, test).collect()}
    assert got == {0: "live", 1: "possible", 2: "test_only", 3: "dead", 4: "dead"}


def test_extra_columns_do_not_disturb(spark):
    edges = spark.createDataFrame([(1, 2, "definite", 9)], "src bigint, dst bigint, kind string, node bigint")
    got = reach.reachability(edges, spark.createDataFrame([(1, 7)], "node bigint, src bigint"))
    assert got.where(F.col("node") == 2).count() == 1
