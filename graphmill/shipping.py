"""Prepare a session for the package's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to a worker. Spark's own bound counts rows, and ten thousand long texts
#: are more than a worker and the buffers of its executor should hold.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ensure_shipped(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once, and bounds Arrow batches where the session doesn't say."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphmill-src-")) / "graphmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
