"""Source trees as tables: discovery, reading, sidecar files; reports as text or Parquet.

Listing and reading go through Hadoop file systems, so a tree may lie in any store that Spark reads. Spark's own readers
leave out names that begin with an underscore, which analysis must see; those few are read by the driver.
"""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.names import skipped_path
from graphmill.plans.projects import report_lines

FILE_SCHEMA = "project string, path string, text string"
SOURCE, MANIFEST = ".zig", "build.zig.zon"


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def _once(base, paths: list[str]) -> list[str]:
    """Of paths that links make the same file the first; other stores than the local one have no links."""
    if base.toUri().getScheme() != "file":
        return paths
    root, first = base.toUri().getPath(), {}
    for p in paths:
        first.setdefault(os.path.realpath(os.path.join(root, p)), p)
    return list(first.values())


def discover(spark: SparkSession, root: str, contract: str | None = None) -> list[str]:
    """Paths, relative to ``root``, of source files and of the sidecar files beside a build script (the manifest, and the ``contract`` of that name), in byte order.

    Paths with a dot component, a cache, an output or a vendor folder are left out; an unreadable root raises. A file that links lead
    to is there once.
    """
    fs, base = _file_system(spark, root)
    prefix = base.toString().rstrip("/") + "/"
    found: list[str] = []
    entries = fs.listFiles(base, True)
    while entries.hasNext():
        relative = entries.next().getPath().toString().removeprefix(prefix)
        if relative in (MANIFEST, contract) or relative.endswith(SOURCE) and not skipped_path(relative):
            found.append(relative)
    return _once(base, sorted(found, key=str.encode))


def _hidden(path: str) -> bool:
    return any(p.startswith(("_", ".")) for p in path.split("/"))


def read_project(spark: SparkSession, root: str, project: str, contract: str | None = None) -> DataFrame:
    """(project, path, text) of all that ``discover`` lists; bytes that are no UTF-8 become U+FFFD."""
    fs, base = _file_system(spark, root)
    prefix = base.toString().rstrip("/") + "/"
    paths = discover(spark, root, contract)
    seen, unseen = [p for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]
    rows = []
    for p in unseen:  # few: names with an underscore, and the contract
        stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(prefix + p))
        try:
            rows.append((project, p, bytes(stream.readAllBytes()).decode(errors="replace")))
        finally:
            stream.close()
    out = spark.createDataFrame(rows, FILE_SCHEMA)
    if seen:
        read = spark.read.format("binaryFile").load([prefix + p for p in seen])
        # both spellings of a local path, file:/x and file:///x, end alike
        name = F.substring_index("path", "/" + prefix.split(":", 1)[-1].lstrip("/"), -1)
        out = out.unionByName(read.select(F.lit(project).alias("project"), name.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    return out


def relative_path(base: str, path: str) -> str:
    """The path from ``base``, with ``..`` where it leaves it."""
    return posixpath.relpath(path, base)


def write_report(findings: DataFrame, path: str, as_text: bool = True) -> None:
    """The report as text, one folder per project and class, or the findings as Parquet in report order."""
    if as_text:
        ordered = report_lines(findings)
        ordered.repartitionByRange("project", "class").sortWithinPartitions("project", "class", "path", "place").select("project", "class", F.col("text").alias("value")).write.partitionBy("project", "class").text(path)
    else:
        findings.orderBy("project", "path", "line", "col", "name").write.parquet(path)
