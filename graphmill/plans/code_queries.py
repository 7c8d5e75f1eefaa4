"""The analysis of whole projects, run on the fixture projects and compared with rows written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import flags
from graphmill.operators import components
from graphmill.operators.reach import KINDS, kind_code
from graphmill.plans import fixtures
from graphmill.plans.fact_tables import fact_table
from graphmill.plans.projects import Analysis, analyze, exit_codes, extract_facts, report_lines
from graphmill.scratch import cut


def fixture_files(spark: SparkSession) -> DataFrame:
    rows = [(name, path, text, roots, policy) for name, (files, roots, policy) in fixtures.PROJECTS.items() for path, text in files.items()]
    return spark.createDataFrame(rows, "project string, path string, text string, roots string, policy string")


def _facts(spark: SparkSession, fact: str) -> DataFrame:
    return extract_facts(fixture_files(spark), fixtures.CONTRACT).where(F.col("fact") == fact)


def _analysis(spark: SparkSession) -> Analysis:
    return analyze(fixture_files(spark), fixtures.CONTRACT)


def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).findings.select("project", "path", "line", "col", "kind", "name", "class", "nested", "cycle_size", "cycle")


def code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report, line by line."""
    return report_lines(_analysis(spark).findings).select("project", "class", "text")


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest kind of each edge, by name."""
    edges = _facts(spark, "edge").select("project", F.col("name").alias("user"), F.substring_index("detail", ":", -1).alias("used"), "kind")
    best = edges.groupBy("project", "user", "used").agg(F.min(kind_code(F.col("kind"))).alias("_best"))
    return best.select("project", "user", "used", F.element_at(F.array(*map(F.lit, KINDS)), F.col("_best") + 1).alias("kind"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "file").select("project", "path", F.col("kind").alias("status"))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "unresolved").select("project", "path", F.col("name").alias("specifier"), F.col("kind").alias("reason"))


def code_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that do not resolve, counted by reason."""
    return _analysis(spark).unresolved_counts()


def code_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "module").select("project", "name", F.coalesce("path", "kind").alias("path"))


def code_build_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "build_root").select("project", "kind", "path")


def code_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "root").select("project", "name", "kind").distinct()


def code_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, "stale_contract").select("project", F.col("name").alias("spec"), F.col("detail").alias("missing"))


def code_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exit_codes(_analysis(spark))


def code_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols with kind, place and flags."""
    return _facts(spark, "symbol").select("project", "path", "name", "kind", "line", "col", F.col("detail").alias("flags"))


def _one(spark: SparkSession, project: str) -> DataFrame:
    return fixture_files(spark).where(F.col("project") == project)


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_table(_one(spark, "dead_chain"), "tokens").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = F.concat_ws("+", flags.names_of(F.col("flags"), flags.REFERENCE_FLAGS)).alias("uses")
    return fact_table(_one(spark, "rollup"), "references").select("name", uses).groupBy("name", "uses").agg(F.count(F.lit(1)).alias("n"))


def code_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.concat_ws("+", flags.names_of(F.col("flags"), flags.SCOPE_FLAGS)).alias("flags")
    return fact_table(_one(spark, "rollup"), "scopes").select(found).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


def code_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who owns the uses of a name: references joined to the owners of their nodes."""
    files = fixture_files(spark)
    owners = fact_table(files, "nodes").select("project", "path", "node", "owner")
    names = fact_table(files, "symbols").select("project", "path", F.col("symbol").alias("owner"), F.col("name").alias("owner_name"))
    uses = fact_table(files, "references").where("symbol is not null").join(owners, ["project", "path", "node"])
    return uses.join(names, ["project", "path", "owner"], "left").select("project", "name", F.coalesce("owner_name", F.lit("")).alias("owner")).distinct()


def code_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of everything that may be reported."""
    facts = cut(extract_facts(fixture_files(spark), fixtures.CONTRACT), "facts")
    symbols = facts.where("fact = 'symbol'").select(F.col("sid").alias("node"), "project", "name", "reportable")
    found = components.components(symbols, facts.where("fact = 'edge'").select(F.col("sid").alias("src"), F.col("other").alias("dst"), "kind"))
    return found.join(symbols.where("reportable"), "node").select("project", "name", "n", F.col("cyclic").cast("int").alias("cyclic"))


def code_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What production reaches of everything that may be reported."""
    result = _analysis(spark)
    symbols = result.of("symbol").where("reportable and candidate").select("project", "name", F.col("sid").alias("node"))
    verdict = F.when(F.col("possible"), "possible").when(~F.col("possible"), "reached").otherwise("dead")
    return symbols.join(result.reached, "node", "left").select("project", "name", verdict.alias("verdict"))


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


QUERIES = {f.__name__: f for f in (code_findings, code_report, code_edges, code_files, code_imports, code_unresolved, code_modules, code_build_roots, code_roots, code_contract, code_exit, code_flags, code_tokens, code_references, code_scopes, code_owners, code_cycles, code_verdicts)}
ORACLES = {
    "code_findings": _values(fixtures.FINDINGS, "project, path, line, col, kind, name, class, nested, cycle_size, cycle"),
    "code_report": _values(fixtures.REPORT, "project, class, text"),
    "code_edges": _values(fixtures.EDGES, '"project", "user", "used", "kind"'),
    "code_files": _values(fixtures.FILES, "project, path, status"),
    "code_imports": _values(fixtures.UNRESOLVED, "project, path, specifier, reason"),
    "code_unresolved": _values(fixtures.REASONS, "project, reason, n"),
    "code_modules": _values(fixtures.MODULES, "project, name, path"),
    "code_build_roots": _values(fixtures.BUILD_ROOTS, "project, kind, path"),
    "code_roots": _values(fixtures.ROOTS, "project, name, kind"),
    "code_contract": _values(fixtures.STALE, "project, spec, missing"),
    "code_exit": _values(fixtures.EXIT_CODES, "project, exit_code"),
    "code_flags": _values(fixtures.SYMBOLS, "project, path, name, kind, line, col, flags"),
    "code_tokens": _values(fixtures.TOKENS, "tag, n"),
    "code_references": _values(fixtures.REFERENCES, "name, uses, n"),
    "code_scopes": _values(fixtures.SCOPES, "flags, n"),
    "code_owners": _values(fixtures.OWNERS, "project, name, owner"),
    "code_cycles": _values(fixtures.CYCLES, "project, name, n, cyclic"),
    "code_verdicts": _values(fixtures.VERDICTS, "project, name, verdict"),
}
