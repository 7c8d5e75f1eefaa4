"""Confidence-aware reachability.

``reached``: from the roots over definite and possible edges. ``possibly reached``: the targets of
unknown edges out of the reached set, and all that follows from them over edges of any
kind, without what is reached.

Small graphs (at most SMALL edges, counted first) are solved in one task on integer
arrays; larger ones by a driver loop of frontier joins, where each round joins the frontier with the
edges and drops what is known (semi-naive), and writes only the new frontier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.scratch import cut

#: Edges that one task may solve: about 100 MB of arrays.
SMALL = 2_000_000
KINDS = ("definite", "possible", "unknown")


def kind_code(column):
    """0 definite, 1 possible, 2 unknown."""
    return F.when(column == "definite", 0).when(column == "possible", 1).otherwise(2)


def _closure(start: np.ndarray, offsets: np.ndarray, targets: np.ndarray, seen: np.ndarray) -> None:
    """Marks in ``seen`` all that the marked nodes ``start`` lead to, not entering marked nodes."""
    frontier = start
    while len(frontier):
        counts = offsets[frontier + 1] - offsets[frontier]
        at = np.repeat(offsets[frontier] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        new = np.unique(targets[at])
        frontier = new[~seen[new]]
        seen[frontier] = True


def adjacency(source: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, targets): the targets of node i are targets[offsets[i]:offsets[i + 1]]."""
    order = np.argsort(source, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))]), target[order]


def solve(source: np.ndarray, target: np.ndarray, kind: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reached, possibly reached) nodes, both in ascending order."""
    names, inverse = np.unique(np.concatenate([source, target, roots]), return_inverse=True)
    n, e = len(names), len(source)
    source, target, roots = inverse[:e], inverse[e : 2 * e], np.unique(inverse[2 * e :])
    sure = kind < 2
    reached = np.zeros(n, bool)
    reached[roots] = True
    _closure(roots, *adjacency(source[sure], target[sure], n), reached)
    seeds = np.unique(target[~sure & reached[source]])
    seeds = seeds[~reached[seeds]]
    either = reached.copy()
    either[seeds] = True
    _closure(seeds, *adjacency(source, target, n), either)
    return names[reached], names[either & ~reached]


def _in_one_task(edges: DataFrame, roots: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst", kind_code(F.col("kind")).alias("kind")).unionByName(
        roots.select(F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(-1).alias("kind"))
    )

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        edge = kind >= 0
        source = table["src"].to_numpy()
        target = table["dst"].fill_null(0).to_numpy()
        sure, maybe = solve(source[edge], target[edge], kind[edge], source[~edge])
        return pa.table({"node": np.concatenate([sure, maybe]), "possible": np.repeat([False, True], [len(sure), len(maybe)])})

    return rows.groupBy(F.lit(1).alias("_all")).applyInArrow(run, "node bigint, possible boolean")


def closure(edges: DataFrame, start: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """All nodes that ``start`` leads to over (src, dst), itself included, never entering ``stop``: a driver loop of frontier joins."""
    seen = cut(start.select("node").distinct() if stop is None else start.select("node").distinct().join(stop, "node", "left_anti"), "seen")
    frontier = seen
    while True:
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        if stop is not None:
            new = new.join(stop, "node", "left_anti")
        frontier = cut(new, "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _in_rounds(edges: DataFrame, roots: DataFrame) -> DataFrame:
    reached = closure(edges.where("kind <> 'unknown'").select("src", "dst"), roots)
    seeds = edges.where("kind = 'unknown'").join(reached.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    possible = closure(edges.select("src", "dst"), seeds, stop=reached)
    return reached.withColumn("possible", F.lit(False)).unionByName(possible.withColumn("possible", F.lit(True)))


def reachability(edges: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, possible): every node reached from ``roots`` (node) over ``edges`` (src, dst, kind), or possibly reached."""
    clean = cut(edges.select("src", "dst", "kind").where("src is not null and dst is not null and kind is not null"), "edges")  # counted, then walked
    start = roots.select(F.col("node").cast("bigint").alias("node")).where("node is not null").distinct()
    if clean.limit(small + 1).count() <= small and start.limit(small + 1).count() <= small:
        return _in_one_task(clean, start)
    return _in_rounds(clean, start)


def classify(nodes: DataFrame, production: DataFrame, test: DataFrame) -> DataFrame:
    """(node, class): live, possible, test_only, dead, in this order of precedence; ``test`` is the pass with the test roots added."""
    first = production.select("node", "possible")
    second = test.where("not possible").select("node", F.lit(True).alias("_tested"))
    verdict = F.when(F.col("possible") == F.lit(False), "live").when(F.col("possible"), "possible").when(F.col("_tested"), "test_only").otherwise("dead")
    return nodes.select("node").join(first, "node", "left").join(second, "node", "left").select("node", verdict.alias("class"))
