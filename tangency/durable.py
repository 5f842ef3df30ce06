"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where the session names none (tests, one machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tangency-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_MADE: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then left to its owner
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    atexit.register(remove, spark, path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes all tables made so far; for long sessions, once their results are stored elsewhere."""
    while _MADE:
        remove(spark, _MADE.pop())


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it is computed once, and any executor may be lost later."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # a table that is written needs the shuffles it was made by no longer; else their files stay until the driver collects garbage
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
