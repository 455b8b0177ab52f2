"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application: they run with nothing but Spark installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "500")  # rows of long texts or sets of shingles: a batch stays small
    top = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="glyphframe-"), "glyphframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    spark.sparkContext.addPyFile(path)
