"""Graph queries over the driver tables: reachability, classes, components, roll-ups, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.operators import components, reach, rollup
from graphmill.plans import tables as t
from graphmill.scratch import cut


def reach_definite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reach.reachability(t.part_edges(spark, sf_dir), t.part_roots(spark, sf_dir))
    return found.where("not possible").select("node")


def reach_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both closures by the frontier loop, whatever the size of the graph."""
    return reach.reachability(t.part_edges(spark, sf_dir), t.part_roots(spark, sf_dir), small=0)


def reach_possible(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reach.reachability(t.part_edges(spark, sf_dir), t.part_roots(spark, sf_dir))
    return found.where("possible").select("node")


def classify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-class verdict for every part; the test pass runs with the production roots and the test roots."""
    edges = cut(t.part_edges(spark, sf_dir), "part-edges")
    production = reach.reachability(edges, t.part_roots(spark, sf_dir, 3))
    test = reach.reachability(edges, t.part_roots(spark, sf_dir, 6))
    return reach.classify(t.part_nodes(spark, sf_dir), production, test)


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each class, 0 where none has it."""
    names = spark.createDataFrame([("live",), ("possible",), ("test_only",), ("dead",)], "class string")
    counts = classify_parts(spark, sf_dir).groupBy("class").count()
    return names.join(counts, "class", "left").select("class", F.coalesce("count", F.lit(0)).alias("n"))


def scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(t.part_nodes(spark, sf_dir), cut(t.part_edges(spark, sf_dir), "part-edges"))


def scc_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc_components(spark, sf_dir).where("cyclic").select("component", "n").distinct()


def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with cycles collapsed: a cyclic component is told once, at its first finding, with all its members."""
    verdict = classify_parts(spark, sf_dir)
    found = cut(scc_components(spark, sf_dir), "scc")
    findings = verdict.where("class <> 'live'").join(found, "node")
    anchors = findings.groupBy("component").agg(F.min("node").alias("_anchor"))
    members = found.where("cyclic").groupBy("component").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string"))).alias("cycle"))
    told = findings.join(anchors, "component").where("not cyclic or node = _anchor").join(members, "component", "left")
    return told.select("node", "class", "n", F.coalesce("cycle", F.lit("")).alias("cycle"))


def report_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in report order (name, then key), numbered per group of names with a flag where a new group begins."""
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("line"))
    findings = classify_parts(spark, sf_dir).where("class <> 'live'").join(parts, "node")
    within = Window.partitionBy("path").orderBy("line", "node")
    numbered = findings.withColumn("place", F.row_number().over(within).cast("bigint"))
    return numbered.select("path", "line", "node", "name", "class", "place", (F.col("place") == 1).alias("heads_group")).orderBy("path", "line", "node")


def owner_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = t.ownership(spark, sf_dir)
    return rollup.outermost(tree.where("dead").select("node"), tree.select("node", "owner"))


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.nested_counts(owner_outermost(spark, sf_dir))


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest live owner of every node of the ownership tree, itself included."""
    tree = cut(t.ownership(spark, sf_dir), "tree")
    return rollup.nearest_marked(tree.select("node", "owner"), tree.where("not dead").select("node"))


def edge_dedup_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges once per (src, dst, kind), over all neighbouring lines."""
    return t.part_links(spark, sf_dir, filtered=False).select("src", "dst", "kind").distinct()


def best_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest kind of each pair, and how many kinds it has."""
    ranked = edge_dedup_kinds(spark, sf_dir).groupBy("src", "dst").agg(F.min(reach.kind_code(F.col("kind"))).alias("_best"), F.count(F.lit(1)).alias("n_kinds"))
    return ranked.select("src", "dst", F.element_at(F.array(*map(F.lit, reach.KINDS)), F.col("_best") + 1).alias("kind"), "n_kinds")


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, definite edges as imports: test_only, loaded, build_file or orphan, in this order of precedence.

    The production closure comes first; the test closure does not enter it.
    """
    part = t.table(spark, sf_dir, "part")
    imports = cut(t.part_edges(spark, sf_dir).where("kind = 'definite'").select("src", "dst"), "imports")
    definite = imports.withColumn("kind", F.lit("definite"))
    loaded = reach.reachability(definite, t.part_roots(spark, sf_dir, 3)).select("node", F.lit(True).alias("_loaded"))
    loaded = cut(loaded, "loaded")
    tests = part.where("p_size between 4 and 6").select(F.col("p_partkey").alias("node")).join(loaded, "node", "left_anti")
    outside = definite.join(loaded.select(F.col("node").alias("dst")), "dst", "left_anti")
    tested = reach.reachability(outside, tests).select("node", F.lit(True).alias("_tested"))
    files = part.select(F.col("p_partkey").alias("node"), (F.col("p_size") == 50).alias("_build"))
    status = F.when(F.col("_tested"), "test_only").when(F.col("_loaded"), "loaded").when(F.col("_build"), "build_file").otherwise("orphan")
    return files.join(loaded, "node", "left").join(tested, "node", "left").select("node", status.alias("status"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered files that nothing loads: an anti-join."""
    return file_status(spark, sf_dir).where("status = 'orphan'").select("node")


def library_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the library's public surface: the closure of the library roots (size 1) over imports."""
    imports = t.part_edges(spark, sf_dir).where("kind = 'definite'")
    return reach.reachability(imports, t.part_roots(spark, sf_dir, 1)).select("node")


def roots_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of several kinds side by side; one node may be a root for several reasons."""
    part = t.table(spark, sf_dir, "part")
    one = lambda kind, cond: part.where(cond).select(F.col("p_partkey").alias("node"), F.lit(kind).alias("kind"))
    return one("executable_entry", "p_size = 1").unionByName(one("export", "p_size <= 3")).unionByName(one("public_api", "p_retailprice > 1900")).unionByName(one("test_block", "p_size between 4 and 6"))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2: nothing to start from; 1: an orphan or a dead finding; 0: else (possible and test_only never fail)."""
    roots = t.part_roots(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_roots"))
    dead = classify_parts(spark, sf_dir).agg(F.count_if(F.col("class") == "dead").alias("n_dead"))
    lost = orphans(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_orphans"))
    code = F.when(F.col("n_roots") == 0, 2).when((F.col("n_dead") > 0) | (F.col("n_orphans") > 0), 1).otherwise(0)
    return roots.crossJoin(dead).crossJoin(lost).select("n_roots", "n_dead", "n_orphans", code.alias("exit_code"))  # single rows


_REC = "WITH RECURSIVE " + t.PART_SQL
_SCC = _REC + "," + t.SCC_SQL
_FILES = _REC + """,
loaded AS (
  SELECT p_partkey AS node FROM part WHERE p_size <= 3
  UNION SELECT e.dst FROM loaded l JOIN edges e ON e.src = l.node WHERE e.kind = 'definite'),
test_files AS (
  SELECT p_partkey AS node FROM part WHERE p_size BETWEEN 4 AND 6 AND p_partkey NOT IN (SELECT node FROM loaded)
  UNION SELECT e.dst FROM test_files x JOIN edges e ON e.src = x.node WHERE e.kind = 'definite' AND e.dst NOT IN (SELECT node FROM loaded)),
statuses AS (
  SELECT p_partkey AS node,
         CASE WHEN p_partkey IN (SELECT node FROM test_files) THEN 'test_only'
              WHEN p_partkey IN (SELECT node FROM loaded) THEN 'loaded'
              WHEN p_size = 50 THEN 'build_file' ELSE 'orphan' END AS status
  FROM part)"""
_ALL_LINKS = """WITH links AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst,
         CASE b.l_returnflag WHEN 'R' THEN 'definite' WHEN 'A' THEN 'possible' ELSE 'unknown' END AS kind
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""

QUERIES = {
    f.__name__: f
    for f in (reach_definite, reach_in_rounds, reach_possible, classify_parts, class_counts, scc_components, scc_cyclic, cycle_report, report_sorted, owner_outermost, nested_counts, nearest_ancestor, edge_dedup_kinds, best_kind, file_status, orphans, library_closure, roots_union, exit_code)
}
ORACLES = {
    "reach_definite": f"{_REC} SELECT node FROM reached",
    "reach_in_rounds": f"{_REC} SELECT node, false AS possible FROM reached UNION ALL SELECT node, true FROM possible",
    "reach_possible": f"{_REC} SELECT node FROM possible",
    "classify_parts": f"{_REC} SELECT node, class FROM classes",
    "class_counts": f"{_REC} SELECT k.class AS class, count(c.node) AS n FROM (VALUES ('live'), ('possible'), ('test_only'), ('dead')) k(class) LEFT JOIN classes c ON c.class = k.class GROUP BY k.class",
    "scc_components": f"{_SCC} SELECT node, component, n, cyclic FROM sized",
    "scc_cyclic": f"{_SCC} SELECT DISTINCT component, n FROM sized WHERE cyclic",
    "cycle_report": f"""{_SCC},
findings AS (SELECT s.*, c.class FROM sized s JOIN classes c ON c.node = s.node WHERE c.class <> 'live'),
lists AS (SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS cycle FROM sized WHERE cyclic GROUP BY component)
SELECT f.node, f.class, f.n, coalesce(l.cycle, '') AS cycle FROM findings f LEFT JOIN lists l ON l.component = f.component
WHERE NOT f.cyclic OR f.node = (SELECT min(g.node) FROM findings g WHERE g.component = f.component)""",
    "report_sorted": f"""{_REC}
SELECT p_brand AS path, p_size AS line, node, p_name AS name, class,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_size, node) AS place,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_size, node) = 1 AS heads_group
FROM classes JOIN part ON p_partkey = node WHERE class <> 'live' ORDER BY path, line, node""",
    "owner_outermost": f"WITH RECURSIVE {t.TREE_SQL} SELECT node, outermost FROM outer_most",
    "nested_counts": f"WITH RECURSIVE {t.TREE_SQL} SELECT outermost, count(*) - 1 AS nested FROM outer_most GROUP BY outermost",
    "nearest_ancestor": f"""WITH RECURSIVE {t.TREE_SQL},
up AS (SELECT node, node AS here, 0 AS depth FROM tree UNION ALL SELECT u.node, x.owner, u.depth + 1 FROM up u JOIN tree x ON x.node = u.here WHERE x.owner IS NOT NULL),
live AS (SELECT u.node, min_by(u.here, u.depth) AS nearest FROM up u JOIN tree x ON x.node = u.here WHERE NOT x.dead GROUP BY u.node)
SELECT x.node, l.nearest FROM tree x LEFT JOIN live l ON l.node = x.node""",
    "edge_dedup_kinds": f"{_ALL_LINKS} SELECT src, dst, kind FROM links",
    "best_kind": f"{_ALL_LINKS} SELECT src, dst, min(kind) AS kind, count(*) AS n_kinds FROM links GROUP BY src, dst",
    "file_status": f"{_FILES} SELECT node, status FROM statuses",
    "orphans": f"{_FILES} SELECT node FROM statuses WHERE status = 'orphan'",
    "library_closure": f"{_REC}, lib AS (SELECT p_partkey AS node FROM part WHERE p_size <= 1 UNION SELECT e.dst FROM lib l JOIN edges e ON e.src = l.node WHERE e.kind = 'definite') SELECT node FROM lib",
    "roots_union": """SELECT p_partkey AS node, 'executable_entry' AS kind FROM part WHERE p_size = 1
UNION ALL SELECT p_partkey, 'export' FROM part WHERE p_size <= 3
UNION ALL SELECT p_partkey, 'public_api' FROM part WHERE p_retailprice > 1900
UNION ALL SELECT p_partkey, 'test_block' FROM part WHERE p_size BETWEEN 4 AND 6""",
    "exit_code": f"""{_FILES}
SELECT (SELECT count(*) FROM part WHERE p_size <= 3) AS n_roots, (SELECT count(*) FROM classes WHERE class = 'dead') AS n_dead,
       (SELECT count(*) FROM statuses WHERE status = 'orphan') AS n_orphans,
       CASE WHEN (SELECT count(*) FROM part WHERE p_size <= 3) = 0 THEN 2
            WHEN (SELECT count(*) FROM classes WHERE class = 'dead') > 0 OR (SELECT count(*) FROM statuses WHERE status = 'orphan') > 0 THEN 1 ELSE 0 END AS exit_code""",
}
