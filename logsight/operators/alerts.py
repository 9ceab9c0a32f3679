"""Alerts: deduplication, families, risk entries, routing and digests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight.functions.identity import alert_id
from logsight.operators.lineage import settled
from logsight.operators.windows import join_back

# Severity 0 to 6 as numbers and names of log records.
OTEL = ((1, "TRACE"), (9, "INFO"), (10, "INFO2"), (13, "WARN"), (17, "ERROR"), (21, "FATAL"), (24, "FATAL4"))


def anchored(alerts: DataFrame, keys: Sequence[str], window_ns: int = 900_000_000_000, time: str = "timestamp_ns", tie: str = "alert_id") -> DataFrame:
    """Alerts of a key with the anchor they fold into and their number under it.

    An alert within the window of the anchor, either way, folds into it; any
    other is the next anchor. The anchor doesn't move, so this is a fold and no
    session, yet no task walks along it:

    1. Each time of a key points to the first one beyond its window, which lies
       in the next cell of the window's width or is the first of a later one.
    2. What follows a gap longer than the window is an anchor for sure. From
       these, anchors are reached by pointers that double in each round: after
       k rounds the first 2^k anchors of every unbroken burst are known.
    3. A cell holds one anchor at most, so a row's anchor is that of its own
       cell or of the one before, an equi-join. Nothing holds more than the
       rows of one cell, or one row a cell of a key.
    """
    cell = lambda t: F.expr(f"({t} - pmod({t}, {window_ns})) div {window_ns}")
    rows = alerts.select(*keys, F.col(time).alias("_t"), tie)
    times = settled(rows.select(*keys, "_t").distinct().withColumn("_cell", cell("_t")), "anchor-times")
    order = Window.partitionBy(*keys).orderBy("_cell")
    cells = times.groupBy(*keys, "_cell").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    begins = F.coalesce(F.col("_low") - F.lag("_high").over(order) > window_ns, F.lit(True))
    far = F.when(F.lead("_cell").over(order) > F.col("_cell") + 1, F.lead("_low").over(order)).otherwise(F.lead("_low", 2).over(order))
    cells = settled(cells.withColumns({"_begins": begins, "_far": far}), "anchor-cells")
    # the first time of the next cell that is beyond the window's end: asked for in that cell, behind times equal to it
    asks = times.select(*keys, (F.col("_t") + window_ns).alias("_at"), (F.col("_cell") + 1).alias("_cell"), F.lit(True).alias("_asks"), "_t")
    both = times.select(*keys, F.col("_t").alias("_at"), "_cell", F.lit(False).alias("_asks"), "_t").union(asks)
    ahead = Window.partitionBy(*keys, "_cell").orderBy(F.col("_at").desc(), F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.min(F.when(~F.col("_asks"), F.col("_at"))).over(ahead)).where("_asks").select(*keys, "_t", (F.col("_cell") - 1).alias("_cell"), "_near")
    step = join_back(near, cells.select(*keys, "_cell", "_far"), [*keys, "_cell"]).select(*keys, "_t", F.coalesce("_near", "_far").alias("_next"))
    step = settled(step.where("_next IS NOT NULL"), "anchor-steps")
    known = settled(cells.where("_begins").select(*keys, F.col("_low").alias("_t")), "anchors")
    n = known.count()
    while True:
        reached = join_back(known, step, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        known = settled(known.union(reached).distinct(), "anchors")
        if (grown := known.count()) == n:
            break
        n = grown
        further = step.select(*keys, F.col("_next").alias("_after"), F.col("_t").alias("_next"))
        step = settled(join_back(step, further, [*keys, "_next"]).select(*keys, "_t", F.col("_after").alias("_next")), "anchor-steps")
    at = settled(known.select(*keys, F.col("_t").alias("_a"), cell("_t").alias("_cell")), "anchors")
    dealt = join_back(rows.withColumn("_cell", cell("_t")), at.withColumnRenamed("_a", "_own"), [*keys, "_cell"], "left")
    dealt = join_back(dealt, at.select(*keys, F.col("_a").alias("_before"), (F.col("_cell") + 1).alias("_cell")), [*keys, "_cell"], "left")
    anchor = F.when(F.col("_own") <= F.col("_t"), F.col("_own")).otherwise(F.col("_before"))
    number = F.row_number().over(Window.partitionBy(*keys, "anchor_ns").orderBy("_t", tie)).cast("long")
    return dealt.withColumn("anchor_ns", anchor).withColumn("dedup_count", number).select(*keys, tie, "anchor_ns", "dedup_count")


def deduplicated(alerts: DataFrame, keys: Sequence[str], window_ns: int = 900_000_000_000) -> DataFrame:
    """One row an anchor: the newest alert's id, first time, count."""
    return anchored(alerts, keys, window_ns).groupBy(*keys, "anchor_ns").agg(F.max("dedup_count").alias("dedup_count"), F.max_by("alert_id", "dedup_count").alias("alert_id"))


def ml_alerts(events: DataFrame) -> DataFrame:
    """One alert for each typed entity of an anomalous event, one with an empty entity without any (K9).

    events: timestamp_ns, severity_id, source_type, template_id, anomaly_score, typed array<struct<kind, uuid, value>>.
    """
    empty = F.array(F.struct(F.lit("ip").alias("kind"), F.lit("").alias("uuid"), F.lit("").alias("value")))
    each = events.withColumn("e", F.explode(F.when(F.size("typed") > 0, F.col("typed")).otherwise(empty)))
    return each.select(
        alert_id("hst", F.col("template_id"), F.col("source_type"), F.col("timestamp_ns"), F.col("e.uuid")).alias("alert_id"), F.lit("ml").alias("alert_type"), "timestamp_ns", "severity_id",
        F.lit("hst-anomaly").alias("rule_name"), F.col("e.uuid").alias("entity_uuid"), F.col("e.value").alias("entity_value"), F.col("e.kind").alias("entity_type"),
        F.greatest(F.lit(0.0), F.least(F.col("anomaly_score"), F.lit(1.0))).alias("risk_score"),
    )


def risk_entries(alerts: DataFrame) -> DataFrame:
    """Risk points of alerts by family (K6)."""
    points = F.when(F.col("alert_type") == "ml", 10 * F.col("risk_score")).when(F.col("alert_type") == "sigma", F.when(F.col("severity_id") >= 4, 15.0).otherwise(5.0))
    points = points.when(F.col("alert_type").isin("correlation", "ioc"), 20 * F.col("risk_score"))
    return alerts.select("alert_id", "entity_value", "timestamp_ns", points.alias("points")).where(F.col("points").isNotNull())


def event_risk(behaviour: Column, confidence: Column) -> Column:
    """Larger of the behaviour score and the best indicator's confidence (K7)."""
    return F.greatest(F.coalesce(behaviour, F.lit(0.0)), F.coalesce(confidence / 100, F.lit(0.0)))


@dataclass(frozen=True)
class Route:
    """A routing rule: what it matches, and channels with their mode."""

    notify: tuple[tuple[str, str], ...]
    alert_types: tuple[str, ...] = ()
    rule_glob: str | None = None
    entity_types: tuple[str, ...] = ()
    min_severity: int | None = None
    max_severity: int | None = None

    def matches(self) -> Column:
        out = F.lit(True)
        if self.alert_types:
            out = out & F.col("alert_type").isin(*self.alert_types)
        if self.rule_glob is not None:
            out = out & F.rlike("rule_name", F.lit(glob_pattern(self.rule_glob)))
        if self.entity_types:
            out = out & F.col("entity_type").isin(*self.entity_types)
        if self.min_severity is not None:
            out = out & (F.col("severity_id") >= self.min_severity)
        if self.max_severity is not None:
            out = out & (F.col("severity_id") <= self.max_severity)
        return out


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for * and ?."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "_- " else c for c in glob) + "$"


def routed(alerts: DataFrame, routes: Sequence[Route], default: tuple[tuple[str, str], ...] = (), floors: dict[str, int] | None = None, quiet: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """(alert, rule_order, channel, mode) of the first rule that matches.

    floors: least severity of a channel; quiet: channel to (start, end, least
    severity), minutes of the UTC day, which may wrap midnight.
    """
    pairs = lambda n: F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(m).alias("mode")) for c, m in n)) if n else F.array().cast("array<struct<channel:string,mode:string>>")
    order, notify = F.lit(-1), pairs(default)
    for i, r in reversed(list(enumerate(routes))):
        order = F.when(r.matches(), i).otherwise(order)
        notify = F.when(r.matches(), pairs(r.notify)).otherwise(notify)
    out = alerts.withColumn("rule_order", order).withColumn("n", F.explode(notify)).withColumns({"channel": F.col("n.channel"), "mode": F.col("n.mode")}).drop("n")
    for channel, least in (floors or {}).items():
        out = out.where((F.col("channel") != channel) | (F.col("severity_id") >= least))
    minute = F.pmod(F.floor(F.col("timestamp_ns") / 60_000_000_000), F.lit(1440))
    for channel, (start, end, least) in (quiet or {}).items():
        inside = (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)
        out = out.where(~((F.col("channel") == channel) & inside & (F.col("severity_id") < least)))
    return out


def digests(routed_alerts: DataFrame, window_ns: int = 900_000_000_000) -> DataFrame:
    """Digest batches: alerts of a rule and channel for some minutes from the first.

    The window reaches forward from the first alert only.
    """
    each = anchored(routed_alerts.where("mode = 'digest'"), ["rule_order", "channel"], window_ns)
    return each.groupBy("rule_order", "channel", "anchor_ns").agg(F.count("*").alias("n"), F.min("alert_id").alias("first_id"))


def otel_records(alerts: DataFrame) -> DataFrame:
    """Alerts as log records with attributes."""
    level = F.element_at(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(t).alias("text")) for n, t in OTEL)), F.when(F.col("severity_id").between(0, 6), F.col("severity_id") + 1).otherwise(2).cast("int"))
    attributes = F.to_json(F.struct(F.col("alert_id").alias("alert.id"), F.col("alert_type").alias("alert.type"), F.col("rule_name").alias("rule.name"), F.col("entity_value").alias("entity.value"), F.col("entity_type").alias("entity.type"), F.col("risk_score").alias("risk.score"), F.col("dedup_key").alias("dedup.key")))
    return alerts.select(F.col("timestamp_ns").alias("time_unix_nano"), level["number"].alias("severity_number"), level["text"].alias("severity_text"), F.col("description").alias("body"), attributes.alias("attributes"))


def incidents(alerts: DataFrame, feedback: Column | None = None) -> DataFrame:
    """Alerts as incident payload columns; a false positive resolves."""
    severity = F.when(F.col("severity_id") >= 5, "critical").when(F.col("severity_id") >= 4, "error").when(F.col("severity_id") >= 2, "warning").otherwise("info")
    action = F.lit("trigger") if feedback is None else F.when(feedback == "fp", "resolve").otherwise("trigger")
    return alerts.select(
        action.alias("event_action"), F.concat_ws(":", "alert_type", "rule_name", "entity_value").alias("dedup_key"), F.substring(F.concat(F.col("description"), F.lit(" ["), F.col("rule_name"), F.lit("]")), 1, 1024).alias("summary"), severity.alias("severity"), "alert_id"
    )
