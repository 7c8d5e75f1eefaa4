"""From source files to findings: facts per project in Python workers, everything after that in DataFrames.

``files`` has project, path and text. A project is one group (its files must be seen together to resolve names);
projects are independent, so a corpus of many spreads over the cluster, and one fixpoint serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.frontend.facts import COLUMNS, SCHEMA, project_rows
from graphmill.operators import components, reach, rollup
from graphmill.scratch import cut


def extract_facts(files: DataFrame, contract: str | None = None) -> DataFrame:
    """Fact rows of every project in ``files`` (project, path, text, and optionally roots: a list of root paths, and policy).

    A null path is skipped, a null text is an empty file. Without ``roots`` the build script decides. ``contract`` names the
    file, beside the build script, that lists what is used from outside.
    """
    have = files.columns
    rows = files.where("path is not null").select(
        "project", "path", F.coalesce("text", F.lit("")).alias("text"),
        F.col("roots").alias("roots") if "roots" in have else F.lit(None).cast("string").alias("roots"),
        F.col("policy").alias("policy") if "policy" in have else F.lit(None).cast("string").alias("policy"),
    )

    def run(table: pa.Table) -> pa.Table:
        name = table["project"][0].as_py()
        texts = dict(sorted(zip(table["path"].to_pylist(), table["text"].to_pylist(), strict=True)))
        roots, policy = table["roots"][0].as_py(), table["policy"][0].as_py()
        found = list(project_rows(name, texts, roots.split(",") if roots else None, policy, contract))
        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
        types = dict(part.rsplit(" ", 1) for part in SCHEMA.split(", "))
        return pa.table({c: pa.array([r[c] for r in found], kinds[types[c]]) for c in COLUMNS})

    return rows.groupBy("project").applyInArrow(run, SCHEMA)


@dataclass
class Analysis:
    """The tables of an analysis; each is a DataFrame over all projects."""

    facts: DataFrame
    findings: DataFrame
    reached: DataFrame
    cycles: DataFrame

    def of(self, fact: str) -> DataFrame:
        return self.facts.where(F.col("fact") == fact)

    def outgoing(self, nodes: DataFrame) -> DataFrame:
        """(node, other, kind): the edges out of ``nodes`` (node)."""
        edges = self.of("edge").select(F.col("sid").alias("node"), "other", "kind")
        return edges.join(nodes.select("node").distinct(), "node", "left_semi")

    def is_reachable(self, nodes: DataFrame) -> DataFrame:
        """(node, reachable, possibly) of ``nodes`` (node)."""
        return nodes.select("node").distinct().join(self.reached, "node", "left").select("node", F.coalesce(~F.col("possible"), F.lit(False)).alias("reachable"), F.coalesce("possible", F.lit(False)).alias("possibly"))

    def component_of(self, nodes: DataFrame) -> DataFrame:
        """(node, component, n, cyclic) of ``nodes`` (node)."""
        return nodes.select("node").distinct().join(self.cycles, "node")

    def unresolved_counts(self) -> DataFrame:
        """(project, reason, n): imports that do not resolve, by reason, for the run's summary."""
        return self.of("unresolved").groupBy("project", F.col("kind").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dead_symbols(symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Unreached candidates with their outermost dead owner and, on that, how many are folded into it."""
    sure = reached.where("not possible").select(F.col("node").alias("sid"))
    dead = symbols.where("candidate").join(sure, "sid", "left_anti")
    outer = rollup.outermost(dead.select(F.col("sid").alias("node")), symbols.select(F.col("sid").alias("node"), F.col("other").alias("owner")))
    outer = cut(outer, "outer")
    nested = rollup.nested_counts(outer)
    top = dead.join(outer.where("node = outermost").select(F.col("node").alias("sid")), "sid")
    return top.join(nested.withColumnRenamed("outermost", "sid"), "sid")


def analyze(files: DataFrame, contract: str | None = None) -> Analysis:
    """Facts, reachability and findings of all projects."""
    facts = cut(extract_facts(files, contract), "facts")
    symbols, edges = facts.where("fact = 'symbol'"), facts.where("fact = 'edge'").select(F.col("sid").alias("src"), F.col("other").alias("dst"), "kind")
    roots = facts.where("fact = 'root'").select(F.col("sid").alias("node"))
    tests = facts.where("fact = 'test_root'").select(F.col("sid").alias("node"))
    reached = cut(reach.reachability(edges, roots), "reached")
    tested = reach.reachability(edges, roots.unionByName(tests)).where("not possible").select(F.col("node").alias("sid"), F.lit(True).alias("_tested"))
    found = cut(components.components(symbols.select(F.col("sid").alias("node")), edges), "cycles")
    cycles = found.where("cyclic").select(F.col("node").alias("sid"), "component")
    members = cycles.join(symbols.select("sid", "name", "ord"), "sid").groupBy("component").agg(
        F.count(F.lit(1)).alias("cycle_size"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("cycle")
    )
    dead = dead_symbols(symbols, reached).where("reportable and not test_only").drop("other")
    maybe = reached.where("possible").select(F.col("node").alias("sid"), F.lit(True).alias("_maybe"))
    judged = dead.join(maybe, "sid", "left").join(tested, "sid", "left").join(cycles, "sid", "left")
    first = Window.partitionBy("project", F.coalesce("component", "sid")).orderBy("ord")
    kept = judged.withColumn("_place", F.row_number().over(first)).where("component is null or _place = 1").join(members, "component", "left")
    verdict = F.when(F.col("_maybe"), "possible").when(F.col("_tested"), "test_only").otherwise("dead")
    findings = kept.select(
        "project", "path", "line", "col", "kind", "name", "nested", verdict.alias("class"), F.coalesce("cycle_size", F.lit(0)).alias("cycle_size"),
        F.array_join(F.filter(F.coalesce("cycle", F.array().cast("array<string>")), lambda x: x != ""), ", ").alias("cycle"),
    )
    return Analysis(facts, findings, reached, found)


def report_lines(findings: DataFrame) -> DataFrame:
    """The text report: (project, class, path, place, text), a line per finding under a line per path."""
    nested = F.when(F.col("nested") > 0, F.format_string(" (+%d nested)", "nested")).otherwise("")
    cycle = F.when(F.col("cycle_size") > 0, F.format_string(" (cycle of %d: %s)", "cycle_size", "cycle")).otherwise("")
    line = F.concat(F.format_string("    %d:%d: %s %s", "line", "col", "kind", "name"), nested, cycle)
    rows = findings.select("project", "class", "path", F.struct("line", "col", "name").alias("place"), line.alias("text"))
    heads = findings.select("project", "class", "path").distinct().select("project", "class", "path", F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("col"), F.lit("").alias("name")).alias("place"), F.concat(F.lit("  "), "path").alias("text"))
    return heads.unionByName(rows).orderBy("project", "class", "path", "place")


def exit_codes(analysis: Analysis) -> DataFrame:
    """(project, exit_code): 2 broken or nothing to start from, 1 an orphan, a stale contract or a dead finding, 0 else."""
    facts = analysis.facts.groupBy("project").agg(
        F.count_if(F.col("fact") == "problem").alias("problems"), F.count_if(F.col("fact") == "root").alias("roots"),
        F.count_if((F.col("fact") == "file") & (F.col("kind") == "orphan")).alias("orphans"), F.count_if(F.col("fact") == "stale_contract").alias("stale"),
    )
    dead = analysis.findings.groupBy("project").agg(F.count_if(F.col("class") == "dead").alias("dead"))
    code = F.when((F.col("problems") > 0) | (F.col("roots") == 0), 2).when(F.col("orphans") + F.col("stale") + F.coalesce("dead", F.lit(0)) > 0, 1).otherwise(0)
    return facts.join(dead, "project", "left").select("project", code.alias("exit_code"))
