"""Strongly connected components over definite and possible edges; a component is named by its least member.

Small graphs: an iterative depth-first search in one task. Large ones: trim nodes without
a way in or out, colour each node with the least node that leads to it, and take the backward closure of
each colour's node within the colour; repeat on what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators.reach import SMALL, adjacency, closure
from graphmill.scratch import cut


def strong_components(offsets: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The least member of each node's component; node i has the targets[offsets[i]:offsets[i + 1]] (depth-first with an explicit stack)."""
    n = len(offsets) - 1
    first, to = offsets.tolist(), targets.tolist()
    number, low, at = [-1] * n, [0] * n, first[:n]
    out = [-1] * n
    path: list[int] = []
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = count
        count += 1
        path.append(root)
        work = [root]
        while work:
            node = work[-1]
            if at[node] < first[node + 1]:
                target = to[at[node]]
                at[node] += 1
                if number[target] < 0:
                    number[target] = low[target] = count
                    count += 1
                    path.append(target)
                    work.append(target)
                elif out[target] < 0 and number[target] < low[node]:
                    low[node] = number[target]
                continue
            work.pop()
            if work and low[node] < low[work[-1]]:
                low[work[-1]] = low[node]
            if low[node] == number[node]:
                start = len(path) - 1
                while path[start] != node:
                    start -= 1
                members = path[start:]
                del path[start:]
                least = min(members)
                for m in members:
                    out[m] = least
    return np.array(out, np.int64)


def _in_one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst")))

    def run(table: pa.Table) -> pa.Table:
        edge = table["dst"].is_valid().to_numpy()
        source, target = table["src"].to_numpy(), table["dst"].fill_null(0).to_numpy()
        names, inverse = np.unique(np.concatenate([source, target[edge]]), return_inverse=True)
        component = strong_components(*adjacency(inverse[: len(source)][edge], inverse[len(source) :], len(names)))
        return pa.table({"node": names, "component": names[component]})

    return rows.groupBy(F.lit(1).alias("_all")).applyInArrow(run, "node bigint, component bigint")


def _in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    done: list[DataFrame] = []
    left = cut(nodes.select("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "left")
    edges = cut(edges.where("src <> dst").distinct(), "inner")
    while not left.isEmpty():
        while True:  # trim
            inner = left.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            inner = cut(inner, "left")
            if inner.count() == left.count():
                break
            done.append(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")))
            left = inner
            edges = cut(edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "inner")
        if left.isEmpty():
            break
        colours = cut(left.select("node", F.col("node").alias("colour")), "colours")
        while True:  # the least node that leads here
            offered = edges.join(colours, edges["src"] == colours["node"]).groupBy(F.col("dst").alias("_to")).agg(F.min("colour").alias("_offer"))
            new = cut(colours.join(offered, F.col("node") == F.col("_to"), "left").select("node", F.least("colour", F.coalesce("_offer", "colour")).alias("colour")), "colours")
            changed = not new.exceptAll(colours).isEmpty()
            colours = new
            if not changed:
                break
        same = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").where("_a = _b")
        backward = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "backward")
        found = closure(backward, colours.where("node = colour"))
        done.append(cut(found.join(colours, "node").select("node", F.col("colour").alias("component")), "found"))
        left = cut(left.join(found, "node", "left_anti"), "left")
        edges = cut(edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "inner")
    out = done[0] if done else nodes.select("node", F.col("node").alias("component")).limit(0)
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component, n, cyclic) for every node; cyclic: an edge stays inside the component (a self-loop counts)."""
    names = nodes.select(F.col("node").cast("bigint").alias("node")).where("node is not null").distinct()
    sure = cut(edges.where("kind in ('definite', 'possible') and src is not null and dst is not null").select("src", "dst").distinct(), "edges")  # counted, solved and joined
    if sure.limit(small + 1).count() <= small and names.limit(small + 1).count() <= small:
        found = _in_one_task(names, sure)
    else:
        found = _in_rounds(names, sure)
    found = cut(found, "components")
    ends = sure.join(found.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(found.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst")
    cyclic = ends.where("_a = _b").select(F.col("_a").alias("component"), F.lit(True).alias("_cyclic")).distinct()
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "component").join(cyclic, "component", "left").select("node", "component", "n", F.coalesce("_cyclic", F.lit(False)).alias("cyclic"))
