"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and joins on the edge table; no node's neighbours are
gathered in one place. A hot node is a hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.scratch import cut


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: stars."""
    heads = edges.groupBy(F.col("u").alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    return not heads.join(edges.select("v"), F.col("_u") == F.col("v"), "left").where("_n > 1 or v is not null").limit(1).count()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) from the columns u and v of ``links``; the component is its least node. Nodes without links are absent."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()
        joined = large.join(_mins(large), F.col("u") == F.col("_u"))
        small = joined.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(joined.select("u", F.col("_m").alias("v")))
        edges = cut(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
