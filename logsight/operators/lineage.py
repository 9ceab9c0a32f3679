"""Cutting the lineage of long plans, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="logsight-")
    return f"{named.rstrip('/')}/logsight/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than there are cores, dealt to all of them; a larger input as it is.

    For work that takes far longer than moving the rows.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def settled(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder, in folders by the column `by`, and read them back.

    Later scans read the columns they need, with statistics and filters.
    """
    path = shared_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
