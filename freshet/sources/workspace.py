"""Where intermediate tables go.

On a cluster this is the shared folder named by ``spark.checkpoint.dir``; a
machine-local folder is only ever used when the master itself is local.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes from which a Python worker asks the system for memory of its own.
LARGE_ARRAY = 1 << 21


def ship(spark: SparkSession) -> None:
    """Let Python workers started later import this package from where the driver has it.
    On a cluster the package is installed or sent with ``--py-files``. Workers give large arrays
    back to the system when they are freed, so that a reused one does not keep its largest size."""
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    environment.setdefault("MALLOC_MMAP_THRESHOLD_", str(LARGE_ARRAY))


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/freshet/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and continue from the file: lineage is cut, and a lost
    executor costs a re-read, not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Free the disk that finished steps still hold. Their shuffle files stay on the executors until
    the driver has collected the objects that stand for them, which may be long after; a job of many
    large steps asks for it between them. What is still referenced is not touched. The step that ran last
    is, until another has: an empty one."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
