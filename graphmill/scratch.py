"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def _delete(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the context may be gone at interpreter exit; the folder is scratch
        pass


def scratch_root(spark: SparkSession) -> str:
    """One folder per application below ``spark.checkpoint.dir``; where that is unset, a temporary one for a local session and an error on a cluster."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="graphmill-")
        _ROOTS[app] = f"{base.rstrip('/')}/graphmill-{app}"
        atexit.register(_delete, spark, _ROOTS[app])
    return _ROOTS[app]


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nobody refers to any more.

    Spark deletes them once the driver has collected its garbage, which a driver with little to do may not do for long,
    while executors' disks fill.
    """
    gc.collect()  # Python objects hold the plans of the JVM
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage: a later loss of executors re-reads the table instead of
    recomputing what led to it, and a table read twice is computed once. What earlier tables left behind is tidied first.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    tidy(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
