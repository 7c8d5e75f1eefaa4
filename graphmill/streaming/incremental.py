"""Keep the facts of projects current while source files change.

A stream of file versions (project, path, text, version) is folded into a table of the latest version of each file;
each micro-batch re-extracts facts of the touched projects alone and replaces their rows. The findings
are then a batch query over the fact table. Replays are harmless: an older or equal version changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.frontend.facts import SCHEMA
from graphmill.plans.projects import extract_facts

FILE_SCHEMA = "project string, path string, text string, version bigint"
SCHEMAS = {"files": f"{FILE_SCHEMA}, bucket int", "facts": f"{SCHEMA}, bucket int"}
#: Parts of a table; a micro-batch writes those anew that hold a touched project.
BUCKETS = 16


class FactStore:
    """Two tables below ``root`` (a shared path): ``files`` and ``facts``.

    A table is a folder of generations. Each is a Parquet table by bucket whose name tells its number and the buckets it replaces; one
    without a success mark does not count. So a store that is opened again sees what was written last. A
    generation of which no bucket is current any more is deleted by the next batch, which leaves readers that much time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generations(self, table: str) -> list[tuple[str, list[int]]]:
        """(folder, buckets) of the complete generations, the newest first."""
        fs, top = self._path(f"{self.root}/{table}")
        names = sorted((s.getPath().getName() for s in fs.listStatus(top)), reverse=True) if fs.exists(top) else []
        return [(f"{self.root}/{table}/{n}", [int(b) for b in n.split("-")[2].split("_")]) for n in names if fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")[1])]

    def _current(self, table: str) -> dict[int, str]:
        """The newest generation of each bucket."""
        out: dict[int, str] = {}
        for folder, buckets in self._generations(table):
            for b in buckets:
                out.setdefault(b, folder)
        return out

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        current = self._current(table)
        if not current:
            return None
        out = None
        for folder in sorted(set(current.values())):
            mine = [b for b, f in current.items() if f == folder and (buckets is None or b in buckets)]
            part = self.spark.read.schema(SCHEMAS[table]).parquet(folder).where(F.col("bucket").isin(mine))
            out = part if out is None else out.unionByName(part)
        return out

    def _replace(self, table: str, df: DataFrame, buckets: list[int]) -> None:
        known = self._generations(table)
        used = set(self._current(table).values())
        number = 1 + max([0, *(int(folder.rpartition("/")[2].split("-")[0]) for folder, _ in known)])
        df.write.partitionBy("bucket").parquet(f"{self.root}/{table}/{number:012d}-{uuid.uuid4().hex}-{'_'.join(map(str, buckets))}")
        for folder, _ in known:
            if folder not in used:
                fs, path = self._path(folder)
                fs.delete(path, True)

    @property
    def files(self) -> DataFrame | None:
        return self._read("files")

    @property
    def facts(self) -> DataFrame | None:
        return self._read("facts")

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Folds a micro-batch in; a null text removes the file."""
        bucket = F.pmod(F.xxhash64("project"), F.lit(BUCKETS)).cast("int").alias("bucket")
        incoming = batch.select("project", "path", "text", "version", bucket)
        buckets = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())  # at most BUCKETS
        if not buckets:
            return
        known = self._read("files", buckets)
        every = incoming if known is None else known.select(*incoming.columns).unionByName(incoming)
        latest = Window.partitionBy("project", "path").orderBy(F.desc("version"), F.desc(F.xxhash64("text")))
        self._replace("files", every.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place"), buckets)
        touched = incoming.select("project").distinct()
        fresh = extract_facts(self._read("files", buckets).where("text is not null").join(touched, "project", "left_semi").select("project", "path", "text")).withColumn("bucket", bucket)
        old = self._read("facts", buckets)
        self._replace("facts", fresh if old is None else old.join(touched, "project", "left_anti").select(*fresh.columns).unionByName(fresh), buckets)


def follow(store: FactStore, stream: DataFrame, checkpoint: str):
    """Starts a streaming query that folds every micro-batch of file versions into the store."""
    return stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
