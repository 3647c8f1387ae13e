"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set a temporary one serves a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the session's application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once and read back, and where it lies."""
    path = shared_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage and fixes its rows."""
    return written(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more, so that loops don't fill the disk."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
