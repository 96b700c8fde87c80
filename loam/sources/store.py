"""Tables that outlive executors: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one, removed at exit, only where that is unset (tests, local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loam-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loam-{uuid.uuid4().hex}"


#: Spark's setting by which an execution removes its shuffle files when it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the stored table: its lineage ends there."""
    return stored(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read, in whatever file system it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def stored(df: DataFrame, tag: str = "table") -> tuple[DataFrame, str]:
    """``written``, and where it was.

    What was shuffled for it is of no use after the commit, so it is removed then; the session's own setting is put back.
    """
    spark, path = df.sparkSession, f"{work_dir(df.sparkSession)}/{tag}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path
