"""Tables in the folder that the driver and all executors share: what iterations and wide results go through.

The folder is the session's checkpoint folder. A table written and read again has no lineage and a plan of one scan, so
the plans of long loops don't grow, and a lost executor costs no more than the running step.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets one of its own; a cluster is told to set it."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="glyphframe-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for loops, and for wide rows of which later steps read single columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files that no result refers to any more, now and not when the driver's heap is next cleaned.

    Executors clean their heaps too, as far as a small job reaches them: workers in Python need room beside them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()
