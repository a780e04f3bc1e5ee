"""Cutting lineage so that a lost executor costs one stage and an iterative plan stays short."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names; only a session in one process without one (tests) gets a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh, empty folder within the shared one; what is written there goes when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder now instead of at the driver's end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the reread frame.

    Columns are compressed, later readers take only the ones they use, and any executor can read the table again.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by ``cut`` that no later step reads, and let go of what made them."""
    for df in frames:
        delete(df.sparkSession, df._cut_path)
    release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more.

    Its cleaner acts when the driver's garbage is collected, which a short driver program may never see; between the
    steps of a long operator this keeps the disk that is used to that of one step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
