"""Readers: text, syslog, webhook bodies, log records, security tables (A1-A10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight.functions.text import synthetic_ip, syslog_header


def read_lines(spark: SparkSession, paths: str | Sequence[str], source_type: str = "file") -> DataFrame:
    """Lines of text files, compressed or not, with where they come from (A1).

    Blank lines are left out, and so is every line of a file that holds a NUL: it is no text.
    """
    rows = spark.read.text(paths).select(F.col("value"), F.lit(source_type).alias("source_type"), F.col("_metadata.file_path").alias("source_id"))
    binary = rows.where(F.contains("value", F.lit("\x00"))).select("source_id").distinct()
    return rows.where(F.trim("value") != "").join(binary, "source_id", "left_anti").select(*rows.columns)


def stream_lines(spark: SparkSession, folder: str, source_type: str = "file", max_bytes: int = 65_536) -> DataFrame:
    """New files of a folder as a stream of lines; lines that are too long are left out (A2)."""
    rows = spark.readStream.text(folder).select(F.col("value"), F.lit(source_type).alias("source_type"))
    return rows.where((F.trim("value") != "") & (F.octet_length("value") <= max_bytes))


def syslog(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with facility, severity and format (A4)."""
    return lines.withColumns(syslog_header(F.col(column)))


def webhook(bodies: DataFrame, mapping: Mapping[str, str], column: str = "body") -> DataFrame:
    """Fields of JSON bodies by dotted path; objects, arrays and missing fields are left out (A5)."""

    def scalar(path: str) -> Column:
        v = F.get_json_object(column, "$." + path)
        return F.when(~F.rlike(v, F.lit(r"^\s*[\[{]")), v)

    pairs = F.array(*(F.struct(F.lit(k).alias("key"), scalar(p).alias("value")) for k, p in mapping.items()))
    return bodies.withColumn("fields", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
OTLP = (
    "resourceLogs array<struct<scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:{_VALUE},attributes:array<struct<key:string,value:{_VALUE}>>>>>>>>"
)


def otlp_logs(bodies: DataFrame, column: str = "body") -> DataFrame:
    """One row a log record of JSON bodies."""
    each = bodies.select(F.explode(F.from_json(column, OTLP)["resourceLogs"]).alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("l"))
    attributes = F.map_from_entries(F.transform(F.coalesce("l.attributes", F.array().cast(f"array<struct<key:string,value:{_VALUE}>>")), lambda a: F.struct(a["key"], F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")))))
    return each.select(F.col("l.timeUnixNano").cast("long").alias("timestamp_ns"), F.col("l.severityNumber").alias("severity_number"), F.col("l.severityText").alias("severity_text"), F.coalesce("l.body.stringValue", "l.body.intValue").alias("message"), attributes.alias("attributes"), F.to_json("l").alias("record"))


#: Layouts of the security tables (no header).
SECURITY = {
    "auth": "time LONG, src_user STRING, dst_user STRING, src_computer STRING, dst_computer STRING, auth_type STRING, logon_type STRING, auth_orientation STRING, success STRING",
    "proc": "time LONG, user STRING, computer STRING, process_name STRING, start_end STRING",
    "flow": "time LONG, duration LONG, src_computer STRING, src_port STRING, dst_computer STRING, dst_port STRING, protocol INT, packet_count LONG, byte_count LONG",
    "dns": "time LONG, src_computer STRING, resolved_computer STRING",
    "redteam": "time LONG, user STRING, src_computer STRING, dst_computer STRING",
}


def security_rows(df: DataFrame, kind: str) -> DataFrame:
    """Typed fields: unknown ports are -1, success is a boolean."""
    port = lambda c: F.when(F.col(c) == "?", -1).otherwise(F.col(c).try_cast("int"))
    if kind == "flow":
        return df.withColumns({"src_port": port("src_port"), "dst_port": port("dst_port")})
    return df.withColumn("success", F.col("success") == "Success") if kind == "auth" else df


def read_security(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """A security table; a row of the wrong width is an error."""
    return security_rows(spark.read.csv(paths, schema=SECURITY[kind], mode="FAILFAST", enforceSchema=True), kind)


def merged_by_time(tables: Sequence[DataFrame], time: str = "time") -> DataFrame:
    """One table in order of time, then source; a range-partitioned sort."""
    out = None
    for rank, t in enumerate(tables):
        t = t.withColumn("source_rank", F.lit(rank))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.orderBy(time, "source_rank")


def user_name(raw: Column) -> Column:
    return F.lower(F.substring_index(raw, "@", 1))


def security_events(rows: DataFrame, kind: str) -> DataFrame:
    """Event text and entities of security rows; a log-in gives a view by user and one by address."""
    ip = lambda c: synthetic_ip(F.col(c))
    view = lambda entity, kind_, message, source: F.struct(entity.alias("entity"), F.lit(kind_).alias("entity_type"), message.alias("message"), F.lit(source).alias("source_type"))
    if kind == "auth":
        text = F.concat(F.when(F.col("success"), "Accepted ").otherwise("authentication failure "), F.col("auth_type"), F.lit(" for user "), user_name(F.col("src_user")), F.lit(" from "), F.col("src_computer"), F.lit(" to "), F.col("dst_computer"))
        views = [view(user_name(F.col("src_user")), "user", text, "syslog"), view(ip("src_computer"), "ip", text, "syslog")]
    elif kind == "proc":
        views = [view(user_name(F.col("user")), "user", F.concat(F.lit("process "), F.lower("start_end"), F.lit(" "), F.col("process_name"), F.lit(" host="), F.col("computer")), "syslog")]
    elif kind == "flow":
        views = [view(ip("src_computer"), "ip", F.concat(F.lit("flow "), F.col("src_computer"), F.lit(" -> "), F.col("dst_computer"), F.lit(":"), F.col("dst_port").cast("string"), F.lit(" bytes="), F.col("byte_count").cast("string")), "netflow")]
    else:
        views = [view(ip("src_computer"), "ip", F.concat(F.lit("dns query "), F.col("resolved_computer"), F.lit(" from "), F.col("src_computer")), "dns")]
    return rows.select(F.col("time").alias("time_s"), F.explode(F.array(*views)).alias("v")).select("time_s", "v.*").where("entity IS NOT NULL AND entity <> '?'")


def rebased(rows: DataFrame, time: str, target: int, newest: bool = True) -> DataFrame:
    """All times moved by one offset, so that the newest (or first) is at the target (A10)."""
    edge = rows.agg((F.max(time) if newest else F.min(time)).alias("_edge"))
    return rows.join(F.broadcast(edge)).withColumn(time, F.col(time) + target - F.col("_edge")).drop("_edge")
