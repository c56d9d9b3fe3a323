"""The folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

#: Only used where a local session names no spark.checkpoint.dir, as in tests.
LOCAL = "/tmp/checkpoints/tenderflow"


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Off a local master it must be set: what executors write to their own
    disks is lost to the others."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL


def run_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver's JVM ends."""
    return f"{shared_base(spark)}/tenderflow-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):
    """The path and its file system, of any store that Spark writes to."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(sc._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder."""
    folder, files = file_system(spark, run_folder(spark))
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{run_folder(spark)}/{name}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    folder, files = file_system(spark, path)
    files.delete(folder, True)


def end_run(spark: SparkSession) -> None:
    """Remove all that the run wrote to the shared folder; frames that read it end with it.

    For long sessions: a caller that has stored its results needs none of these files.
    """
    remove(spark, run_folder(spark))
