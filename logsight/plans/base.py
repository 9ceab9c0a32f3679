"""Roles that the given tables play in the registered queries, in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight.operators.lineage import spread

Query = Callable[[SparkSession, str], DataFrame]
DAY, HOUR, SECOND = 86_400_000_000_000, 3_600_000_000_000, 1_000_000_000
#: 2024-01-01 and 2024-01-31, UTC.
FIRST, LAST = 1_704_067_200 * SECOND, 1_706_659_200 * SECOND

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The same expression in both engines: a log line of an event.
LINE = (
    "'<' || (8 * (event_id % 26) + event_id % 8) || '>' || CASE WHEN event_id % 2 = 0 THEN '1 ' ELSE '' END || 'host' || (user_id % 7) || ' sshd[' || (1000 + event_id % 500) || ']: ' || "
    "CASE source_type WHEN 'error' THEN 'Failed password for user u' || user_id || '@corp from 10.' || (user_id % 256) || '.' || (event_id % 256) || '.7 ' "
    "WHEN 'purchase' THEN 'Accepted publickey user=U' || user_id || ' from 192.168.' || (event_id % 300) || '.9 process=pay pid=' || (event_id % 99) "
    "WHEN 'click' THEN 'GET /api/v1/item/' || (event_id % 50) || '.json host=web' || (user_id % 5) || ' path /var/log/app' || (event_id % 4) || '.log' "
    "WHEN 'view' THEN 'session  opened   for user u' || user_id || ' id 123e4567-e89b-12d3-a456-4266141740' || (10 + event_id % 90) "
    "ELSE 'sudo: u' || user_id || ' incorrect password attempt hostname cdn' || (user_id % 4) || '.example.org' END"
)
# Tactics and techniques of alerts by event type.
MARKS = {
    "error": (("credential-access", "initial_access"), ("T1110.001", "T1078")),
    "purchase": (("TA0010",), ("T1041",)),
    "click": (("execution",), ("T1203", "t1059.001")),
    "signup": (("persistence", "TA0003"), ("T1136",)),
    "view": (("discovery",), ("T1033",)),
}
EV = (
    "ev AS (SELECT event_id, epoch_us(ts) * 1000 AS timestamp_ns, 'u' || user_id AS entity, user_id, event_type AS source_type, "
    "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS template_id, "
    "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END AS severity_id, value, props FROM events)"
)
LN = f"{EV}, ln AS (SELECT *, {LINE} AS message FROM ev)"


def _case(i: int) -> str:
    return "CASE source_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v[i])}]" for k, v in MARKS.items()) + " END"


AL = (
    f"{EV}, al AS (SELECT 'a' || event_id AS alert_id, event_id, timestamp_ns, severity_id, source_type AS rule_name, CASE event_id % 3 WHEN 0 THEN 'ml' WHEN 1 THEN 'sigma' ELSE 'correlation' END AS alert_type, "
    f"entity AS entity_value, 'user' AS entity_type, value / 500 AS risk_score, source_type || ':' || entity AS dedup_key, 'value ' || event_id || ' of ' || entity AS description, "
    f"{_case(0)} AS mitre_tactics, {_case(1)} AS mitre_techniques FROM ev WHERE value > 60)"
)
GR = "gr AS (SELECT 'u' || user_id AS source_id, 'u' || ((user_id * 7 + event_id % 3) % 1000) AS target_id, event_type AS rel_type, epoch_us(ts) * 1000 AS timestamp_ns FROM events)"
GRE = f"{GR}, ge AS (SELECT DISTINCT source_id, target_id FROM gr), un AS (SELECT source_id AS u, target_id AS v FROM ge UNION SELECT target_id, source_id FROM ge), vx AS (SELECT DISTINCT u AS node FROM un)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(column: str) -> str:
    """SQL text for a TIMESTAMP_NTZ column's nanoseconds, whatever the session's time zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) * 1000"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{nanoseconds('ts')} AS timestamp_ns", "'u' || user_id AS entity", "user_id", "event_type AS source_type",
        "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS template_id",
        "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END AS severity_id", "value", "props",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(events(spark, sf_dir)).withColumn("message", F.expr(LINE))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def marks(i: int):
        out = None
        for k, v in MARKS.items():
            value = F.array(*map(F.lit, v[i]))
            out = F.when(F.col("source_type") == k, value) if out is None else out.when(F.col("source_type") == k, value)
        return out

    kind = F.when(F.col("event_id") % 3 == 0, "ml").when(F.col("event_id") % 3 == 1, "sigma").otherwise("correlation")
    return events(spark, sf_dir).where("value > 60").select(
        F.expr("'a' || event_id").alias("alert_id"), "event_id", "timestamp_ns", "severity_id", F.col("source_type").alias("rule_name"), kind.alias("alert_type"), F.col("entity").alias("entity_value"), F.lit("user").alias("entity_type"),
        (F.col("value") / 500).alias("risk_score"), F.expr("source_type || ':' || entity").alias("dedup_key"), F.expr("'value ' || event_id || ' of ' || entity").alias("description"), marks(0).alias("mitre_tactics"), marks(1).alias("mitre_techniques"),
    )


def graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("'u' || user_id AS source_id", "'u' || ((user_id * 7 + event_id % 3) % 1000) AS target_id", "event_type AS rel_type", f"{nanoseconds('ts')} AS timestamp_ns")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_rows(spark, sf_dir).select("source_id", "target_id").distinct()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})
