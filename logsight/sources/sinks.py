"""Writers: event tables, exports and alert files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsight.functions.text import SEVERITY_NAMES
from logsight.operators.lineage import exists, settled


def severity_name(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITY_NAMES)), (severity + 1).cast("int"))


def first_by_id(events: DataFrame, key: str = "event_id", order: str = "timestamp_ns") -> DataFrame:
    """One row an id: the first; of rows of one time the least as JSON, so that reruns agree."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order), F.to_json(F.struct(*events.columns))))
    return events.withColumn("_r", rank).where("_r = 1").drop("_r")


def _day() -> Column:
    return F.to_date(F.timestamp_micros(F.expr("timestamp_ns div 1000")))


def write_events(events: DataFrame, path: str, partition: str = "day", files: int = 16) -> None:
    """Add events to the event table, one row an id, in folders by day.

    An id that the table has keeps its row, so a batch may be written again. The
    table is looked at in the days of the batch only (an event keeps its time),
    and only its ids are read; new rows are appended and nothing else is touched.
    One writer at a time. Rows without an id or a time are left out.
    """
    spark = events.sparkSession
    rows = first_by_id(events.where("event_id IS NOT NULL AND timestamp_ns IS NOT NULL")).withColumn(partition, _day())
    if exists(spark, path):
        days = [r[0] for r in events.select(_day().alias("d")).where("d IS NOT NULL").distinct().collect()]  # calendar days
        there = spark.read.parquet(path).where(F.col(partition).isin(days)).select("event_id")
        rows = rows.join(there, "event_id", "left_anti")
    rows.repartition(partition, F.pmod(F.xxhash64("event_id"), F.lit(files))).write.mode("append").partitionBy(partition).parquet(path)


def compact_days(spark: SparkSession, path: str, days: Sequence[date], partition: str = "day", files: int = 16) -> None:
    """Rewrite the given days of the event table in `files` files each; the others stay as they are."""
    kept = settled(spark.read.parquet(path).where(F.col(partition).isin(list(days))), "compact")
    dealt = kept.repartition(partition, F.pmod(F.xxhash64("event_id"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def event_json(events: DataFrame) -> DataFrame:
    """Lines of the event export."""
    return events.select(F.to_json(F.struct("event_id", "timestamp_ns", severity_name(F.col("severity_id")).alias("severity"), "source_type", "template_id", "message")).alias("value"))


def alert_json(alerts: DataFrame) -> DataFrame:
    """Lines of the alert export; scores have three places."""
    return alerts.select(F.to_json(F.struct("alert_id", "timestamp_ns", severity_name(F.col("severity_id")).alias("severity"), F.col("alert_type").alias("type"), F.round("risk_score", 3).alias("score"), F.col("rule_name").alias("rule"), "entity_value", F.col("mitre_tactics").alias("tactics"))).alias("value"))


def alert_csv(alerts: DataFrame) -> DataFrame:
    """Columns of the alert export as text, arrays joined by ;."""
    return alerts.select("alert_id", F.col("timestamp_ns").cast("string").alias("timestamp_ns"), severity_name(F.col("severity_id")).alias("severity"), F.col("alert_type").alias("type"), F.format_string("%.3f", "risk_score").alias("score"), F.col("rule_name").alias("rule"), F.array_join("mitre_tactics", ";").alias("tactics"))


def write_export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write export lines as text, or columns as CSV with a header."""
    if kind == "json":
        df.write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, floor: int = 0, per_file: int = 100_000) -> StreamingQuery:
    """A stream of alerts to JSON files by day, from a severity on."""
    rows = alerts.where(F.col("severity_id") >= floor).withColumn("day", F.to_date(F.timestamp_micros(F.expr("timestamp_ns div 1000"))))
    return rows.writeStream.format("json").option("maxRecordsPerFile", per_file).option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def rotating_alert_sink(alerts: DataFrame, path: str, checkpoint: str, floor: int = 0, max_bytes: int = 50_000_000, every_ns: int = 86_400_000_000_000) -> StreamingQuery:
    """A stream of alerts to JSON files that change by time and size.

    A file holds alerts of one period of `every_ns` and begins anew after
    `max_bytes`, so it has at most one line more. A batch writes folders of its
    own (batch, period, file) and a repeated batch writes them again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("severity_id") >= floor)
        lines = rows.select(F.expr(f"timestamp_ns div {every_ns}").alias("period"), "timestamp_ns", "alert_id", F.to_json(F.struct(*batch.columns)).alias("value"))
        before = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("period").orderBy("timestamp_ns", "alert_id", "value").rowsBetween(Window.unboundedPreceding, -1))
        filed = lines.withColumn("file", F.floor(F.coalesce(before, F.lit(0)) / max_bytes))
        dealt = filed.repartition("period", "file").sortWithinPartitions("period", "file", "timestamp_ns", "alert_id")
        dealt.select("period", "file", "value").write.mode("overwrite").partitionBy("period", "file").text(f"{path}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
