"""Graphs and trees derived from the driver tables, as nodes / edges / roots / owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(flag):
    return F.when(flag == "R", "definite").when(flag == "A", "possible").otherwise("unknown")


def part_links(spark: SparkSession, sf_dir: str, filtered: bool = True) -> DataFrame:
    """(src, dst, kind, l_orderkey): lineitems a, b of one order on neighbouring lines; not distinct."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    b = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_quantity").alias("r"), F.col("l_returnflag").alias("flag"))
    if filtered:
        a, b = a.where("q >= 40"), b.where("r >= 25")
    return a.join(b, ["o", "n"]).select("src", "dst", _kind(F.col("flag")).alias("kind"), "o")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part dependency graph: distinct (src, dst, kind)."""
    return part_links(spark, sf_dir).select("src", "dst", "kind").distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def part_roots(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """Production roots are parts of size 3 and less; the test pass takes 6 and less."""
    return table(spark, sf_dir, "part").where(F.col("p_size") <= size).select(F.col("p_partkey").alias("node"))


#: The part graph in DuckDB.
PART_SQL = """
edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst,
         CASE b.l_returnflag WHEN 'R' THEN 'definite' WHEN 'A' THEN 'possible' ELSE 'unknown' END AS kind
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 40 AND b.l_quantity >= 25),
reached AS (
  SELECT p_partkey AS node FROM part WHERE p_size <= 3
  UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node WHERE e.kind <> 'unknown'),
seeds AS (
  SELECT DISTINCT e.dst AS node FROM edges e JOIN reached r ON e.src = r.node
  WHERE e.kind = 'unknown' AND e.dst NOT IN (SELECT node FROM reached)),
possible AS (
  SELECT node FROM seeds
  UNION SELECT e.dst FROM possible p JOIN edges e ON e.src = p.node WHERE e.dst NOT IN (SELECT node FROM reached)),
tested AS (
  SELECT p_partkey AS node FROM part WHERE p_size <= 6
  UNION SELECT e.dst FROM tested r JOIN edges e ON e.src = r.node WHERE e.kind <> 'unknown'),
classes AS (
  SELECT p_partkey AS node,
         CASE WHEN p_partkey IN (SELECT node FROM reached) THEN 'live'
              WHEN p_partkey IN (SELECT node FROM possible) THEN 'possible'
              WHEN p_partkey IN (SELECT node FROM tested) THEN 'test_only' ELSE 'dead' END AS class
  FROM part)"""

#: Components by mutual reachability, in DuckDB; needs PART_SQL.
SCC_SQL = """
paths AS (
  SELECT src, dst FROM edges WHERE kind <> 'unknown'
  UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON e.src = p.dst WHERE e.kind <> 'unknown'),
mutual AS (
  SELECT p_partkey AS node, p_partkey AS other FROM part
  UNION SELECT a.src, a.dst FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src),
comps AS (SELECT node, min(other) AS component FROM mutual GROUP BY node),
sized AS (
  SELECT c.node, c.component, count(*) OVER (PARTITION BY c.component) AS n,
         EXISTS (SELECT 1 FROM paths p WHERE p.src = c.component AND p.dst = c.component) AS cyclic
  FROM comps c)"""


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, owner, name, dead, depth) of the tree region > nation > customer > order."""
    get = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    return (
        get("region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("owner"), (F.col("r_regionkey") == 0).alias("dead"), F.lit(0).alias("depth"))
        .unionByName(get("nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("owner"), (F.col("n_nationkey") % 4 == 0).alias("dead"), F.lit(1).alias("depth")))
        .unionByName(get("customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("owner"), (F.col("c_mktsegment") == "BUILDING").alias("dead"), F.lit(2).alias("depth")))
        .unionByName(get("orders").select(key("o", "o_orderkey").alias("node"), key("c", "o_custkey").alias("owner"), (F.col("o_orderstatus") == "P").alias("dead"), F.lit(3).alias("depth")))
    )


TREE_SQL = """
tree AS (
  SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS owner, r_regionkey = 0 AS dead FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 4 = 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_mktsegment = 'BUILDING' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderstatus = 'P' FROM orders),
climb AS (
  SELECT node, node AS here, 0 AS depth FROM tree WHERE dead
  UNION ALL SELECT c.node, t.owner, c.depth + 1 FROM climb c JOIN tree t ON t.node = c.here JOIN tree o ON o.node = t.owner WHERE o.dead),
outer_most AS (SELECT node, max_by(here, depth) AS outermost FROM climb GROUP BY node)"""
