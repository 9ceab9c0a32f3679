"""Shared pieces of the corpus operators: materialised steps, global order, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="logsight-")
    return _own_dir[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/logsight/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    That cuts the lineage and survives the loss of executors; what depends on
    a partition's number or on sampled bounds is computed once only.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logsight_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a materialised step that nothing reads any more."""
    path = getattr(df, "_logsight_path", None)
    if path is None:
        return
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """Add, for each name: column of `sums`, the sum of that column over all earlier rows.

    `order` must be a total order up to rows that are equal throughout. The rows
    are dealt into ranges and written with their range's number; each range's
    totals (one row a range) give the range's start, and a window inside each
    range gives the rest. No task sees more than a range. Adds `_part` too.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    ranged = keyed.repartitionByRange(partitions(spark), *names).withColumn("_part", F.spark_partition_id())
    kept = materialize(ranged, label)
    totals = kept.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(F.broadcast(starts), "_part").withColumns(
        {n: F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    )
    return out.drop(*names, *(f"_s_{n}" for n in sums))


#: Parts that the rows of one key are dealt into for a join.
SALTS = 4


def join_in_parts(rows: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """Inner join of rows with `one` (a row for each key), each key's rows dealt into parts by the column `other`."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # no broadcast: `one` grows with the data
    return salted.join(spread.hint("merge"), [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of `edges`; component is the smallest node reachable.

    Alternating large-star and small-star steps. Each step takes a minimum by
    key, which Spark combines before the shuffle, and joins it back to the links
    of a node in `SALTS` parts, so a node of very many links is not gathered in
    one task. Each round is written to the shared folder; it ends when a round
    changes no link.
    """
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    pairs = materialize(pairs, "cc")
    seen = None
    while True:
        stat = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stat) == seen or stat[0] == 0:
            break
        seen = tuple(stat)
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_in_parts(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # every link now goes from a larger u to a smaller v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_in_parts(large, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(pairs)
        pairs = step
    child = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return child.union(roots)


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Hand texts to Python a few hundred at a time, so that a run of very long ones fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
