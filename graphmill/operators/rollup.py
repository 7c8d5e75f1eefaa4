"""Roll findings up to the outermost owner that is itself a finding.

Pointer jumping: every dead node points at its owner if that is dead, else at itself; each
round replaces pointers by their pointers' pointers, so the rounds are the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.scratch import cut


def outermost(dead: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, outermost) of every node in ``dead`` (node); ``owners`` is (node, owner) of a forest, NULL owners allowed."""
    names = dead.select("node").distinct()
    up = names.join(owners.select("node", "owner"), "node", "left").join(names.select(F.col("node").alias("_dead")), F.col("owner") == F.col("_dead"), "left")
    pointers = cut(up.select("node", F.coalesce("_dead", "node").alias("outermost")), "pointers")
    while True:
        above = pointers.select(F.col("node").alias("_via"), F.col("outermost").alias("_next"))
        jumped = cut(pointers.join(above, F.col("outermost") == F.col("_via")).select("node", F.col("_next").alias("outermost"), (F.col("_next") != F.col("outermost")).alias("_moved")), "pointers")
        moved = not jumped.where("_moved").isEmpty()
        pointers = jumped.drop("_moved")
        if not moved:
            return pointers


def nested_counts(outer: DataFrame) -> DataFrame:
    """(outermost, nested): dead nodes folded into each outermost one, itself not counted."""
    return outer.groupBy("outermost").agg((F.count(F.lit(1)) - 1).alias("nested"))


def ancestors(owners: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest, depth 0 is the node itself; doubles the known distance each round."""
    pairs = cut(owners.where("owner is not null").select("node", F.col("owner").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    reach = 1
    while True:
        far = pairs.where(F.col("depth") == reach)
        if far.isEmpty():
            break
        beyond = far.select("node", F.col("ancestor").alias("_via"), F.col("depth").alias("_d")).join(pairs.select(F.col("node").alias("_via"), F.col("ancestor").alias("_a"), F.col("depth").alias("_e")), "_via")
        pairs = cut(pairs.unionByName(beyond.select("node", F.col("_a").alias("ancestor"), (F.col("_d") + F.col("_e")).alias("depth"))), "ancestors")
        reach *= 2
    own = owners.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    return pairs.unionByName(own)


def nearest(ancestry: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, nearest) : the closest ancestor-or-self among ``marked`` (node), NULL where there is none."""
    hit = ancestry.join(marked.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    best = hit.groupBy("node").agg(F.min_by("ancestor", "depth").alias("nearest"))
    return ancestry.select("node").distinct().join(best, "node", "left")


def nearest_marked(owners: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, nearest): the closest owner among ``marked`` (node), the node itself included, NULL where there is none.

    Pointer jumping again: a marked node is its own answer, any other points at its owner; each round an open pointer takes what its
    target has. One row a node, and as many rounds as the logarithm of the depth.
    """
    names = marked.select(F.col("node").alias("_marked")).distinct()
    known = owners.select("node", "owner").join(names, F.col("node") == F.col("_marked"), "left")
    open_ = F.col("_marked").isNull() & F.col("owner").isNotNull()
    pointers = cut(known.select("node", F.col("_marked").alias("nearest"), F.when(open_, F.col("owner")).alias("up")), "pointers")
    while not pointers.where("up is not null").isEmpty():
        above = pointers.select(F.col("node").alias("_via"), F.col("nearest").alias("_nearest"), F.col("up").alias("_up"))
        jumped = pointers.join(above, F.col("up") == F.col("_via"), "left")
        pointers = cut(jumped.select("node", F.coalesce("nearest", "_nearest").alias("nearest"), F.col("_up").alias("up")), "pointers")
    return pointers.select("node", "nearest")


def first_match(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order; ties are the caller's to exclude."""
    place = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
