"""Correlation of several conditions in a window, and kill chains (K1-K5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from logsight.functions.identity import alert_id
from logsight.operators.folds import fold_by_key
from logsight.operators.query import regex_condition
from logsight.operators.windows import join_back, running_total, within


@dataclass(frozen=True)
class Condition:
    source_type: str
    min_count: int
    patterns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CorrelationRule:
    name: str
    entity_type: str
    window_seconds: int
    min_sources: int
    severity: int
    conditions: tuple[Condition, ...]
    tactics: tuple[str, ...] = ()
    techniques: tuple[str, ...] = ()


# The four built-in rules, with their windows, counts, patterns and marks (K3).
RULES = (
    CorrelationRule(
        "brute-force-lateral-movement", "user", 600, 2, 5,
        (
            Condition("syslog", 5, {"message": r"(?i)(authentication fail|login fail|invalid password|failed password|access denied)"}),
            Condition("syslog", 1, {"message": r"(?i)(accepted[^\n]{0,200}password|session opened|login[^\n]{0,200}success|authenticated)"}),
        ),
        ("credential-access", "lateral-movement"), ("T1110", "T1021"),
    ),
    CorrelationRule(
        "c2-beaconing", "ip", 1800, 1, 5,
        (Condition("syslog", 5, {"message": r"(?i)(beacon|callback|connect[^\n]{0,200}external|outbound[^\n]{0,200}http|reverse[^\n]{0,200}shell|established[^\n]{0,200}\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)"}),),
        ("command-and-control",), ("T1071",),
    ),
    CorrelationRule(
        "data-exfiltration", "ip", 900, 2, 5,
        (
            Condition("syslog", 3, {"message": r"(?i)(large[^\n]{0,200}transfer|upload[^\n]{0,200}completed?|exfil|outbound[^\n]{0,200}bytes|sent[^\n]{0,200}\d{6,}|POST[^\n]{0,200}\d{6,})"}),
            Condition("syslog", 2, {"message": r"(?i)(file[^\n]{0,200}access|read[^\n]{0,200}sensitive|scp\b|rsync\b|tar\b|zip\b|curl[^\n]{0,200}upload|wget[^\n]{0,200}post)"}),
        ),
        ("exfiltration",), ("T1048",),
    ),
    CorrelationRule(
        "privilege-escalation-chain", "user", 600, 2, 5,
        (
            Condition("syslog", 1, {"message": r"(?i)(sudo\b|su\b|privilege[^\n]{0,200}change|role[^\n]{0,200}change|usermod\b|passwd\b|chmod[^\n]{0,200}\+s)"}),
            Condition("syslog", 1, {"message": r"(?i)(/etc/shadow|/etc/sudoers|/etc/passwd|root[^\n]{0,200}shell|sensitive[^\n]{0,200}file)"}),
        ),
        ("privilege-escalation",), ("T1548",),
    ),
)


def correlation_pack(rows: Sequence[Row | Mapping]) -> list[CorrelationRule]:
    """Correlation rules from Spark rows or dicts (X2); the first of a repeated name counts.

    conditions: a list of {source_type, min_count, patterns}; the other keys are those of `CorrelationRule`.
    """
    out: dict[str, CorrelationRule] = {}
    for r in (r.asDict(recursive=True) if isinstance(r, Row) else r for r in rows):
        conditions = tuple(Condition(c["source_type"], c.get("min_count") or 1, dict(c.get("patterns") or {})) for c in r["conditions"])
        rule = CorrelationRule(r["name"], r["entity_type"], r["window_seconds"], r["min_sources"], r["severity"], conditions, tuple(r.get("tactics") or ()), tuple(r.get("techniques") or ()))
        out.setdefault(rule.name, rule)
    return list(out.values())


def correlate(events: DataFrame, rule: CorrelationRule, arrays: Sequence[str] = (), contributing: bool = False) -> DataFrame:
    """Events at which the rule fires, with counts and risk (K1, K2).

    events: entity, entity_type and the fields of the conditions. A condition
    is one flag column summed over the window by `within`, so rows are read once
    for all conditions and the work is linear in the rows of a busy entity. The
    window holds events of the same time, also later ones in input order. The
    contributing events are joined back to the fired ones by entity and stretch
    of time; no list grows inside a window.
    """
    span = rule.window_seconds * 1_000_000_000
    marked = events.where(F.col("entity_type") == rule.entity_type)
    for i, c in enumerate(rule.conditions):
        hit = F.col("source_type") == c.source_type
        for name, pattern in c.patterns.items():
            hit = hit & regex_condition(F.col(name), pattern, name in arrays)
        marked = marked.withColumn(f"_f{i}", hit)
    counted = within(marked, ["entity"], span, {f"_c{i}": ("sum", F.col(f"_f{i}").cast("int")) for i in range(len(rule.conditions))})
    met = sum(((F.col(f"_c{i}") >= c.min_count).cast("int") for i, c in enumerate(rule.conditions)), F.lit(0))
    n = sum((F.when(F.col(f"_c{i}") >= c.min_count, F.col(f"_c{i}")).otherwise(0) for i, c in enumerate(rule.conditions)), F.lit(0))
    fired = counted.withColumn("n_events", n).where(met >= rule.min_sources)
    risk = F.lit(0.6 * rule.severity / 6) + 0.4 * F.least(F.col("n_events") / 10, F.lit(1.0))
    out = fired.select(
        alert_id("corr", rule.name, F.col("entity"), F.col("timestamp_ns")).alias("alert_id"), F.lit(rule.name).alias("rule_name"), "event_id", "entity", "timestamp_ns", F.col("n_events").cast("long").alias("n_events"), F.round(risk, 6).alias("risk_score")
    )
    if not contributing:
        return out
    any_flag = F.lit(False)
    for i in range(len(rule.conditions)):
        any_flag = any_flag | F.col(f"_f{i}")
    stretch = F.expr(f"timestamp_ns div {span}")
    hits = marked.where(any_flag).select(F.col("entity").alias("hit_entity"), F.col("event_id").alias("hit_id"), F.col("timestamp_ns").alias("hit_ns"), stretch.alias("hit_stretch"))
    asked = out.select("event_id", "entity", "timestamp_ns", F.explode(F.array(stretch - 1, stretch)).alias("stretch"))
    near = (F.col("entity") == F.col("hit_entity")) & (F.col("stretch") == F.col("hit_stretch")) & F.col("hit_ns").between(F.col("timestamp_ns") - span, F.col("timestamp_ns"))
    lists = asked.join(hits, near).groupBy("event_id").agg(F.collect_list("hit_id").alias("contributing_events"))
    return out.join(lists, "event_id")


def kill_chain_window(alerts: DataFrame, least: int = 3, span_ns: int = 86_400_000_000_000) -> DataFrame:
    """Alerts at which an entity has at least `least` distinct tactics in the window (K5, the window form).

    A tactic counts from each of its times for the span; such stretches of one
    tactic that meet are one. An alert's tactics are the stretches begun up to
    it less those that have ended, a running total of +1 and -1 by entity, split
    by time. No window moves and none collects a set.
    """
    own = alerts.select("entity_value", "timestamp_ns", F.explode(F.array_distinct("mitre_tactics")).alias("tactic")).distinct()
    w = Window.partitionBy("entity_value", "tactic").orderBy("timestamp_ns")
    opens = F.coalesce(F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) > span_ns, F.lit(True))
    closes = F.coalesce(F.lead("timestamp_ns").over(w) - F.col("timestamp_ns") > span_ns, F.lit(True))
    marked = own.withColumns({"opens": opens, "closes": closes})
    steps = marked.where("opens").select("entity_value", "timestamp_ns", F.lit(1).alias("step"))
    steps = steps.union(marked.where("closes").select("entity_value", (F.col("timestamp_ns") + span_ns + 1).alias("timestamp_ns"), F.lit(-1).alias("step")))
    asked = alerts.select("entity_value", "timestamp_ns", F.lit(0).alias("step")).distinct()
    # of one time: what begins and ends before what asks
    ordered = steps.groupBy("entity_value", "timestamp_ns").agg(F.sum("step").alias("step")).withColumn("asks", F.lit(False)).union(asked.withColumn("step", F.lit(0).cast("long")).withColumn("asks", F.lit(True)))
    counted = running_total(ordered, ["entity_value"], "step", "n", ["timestamp_ns", "asks"]).where("asks").select("entity_value", "timestamp_ns", F.col("n").cast("int").alias("n_tactics"))
    found = join_back(alerts.select("alert_id", "entity_value", "timestamp_ns").distinct(), counted.where(F.col("n_tactics") >= least), ["entity_value", "timestamp_ns"])
    return found.select("alert_id", "entity_value", "timestamp_ns", "n_tactics")


def kill_chain_fold(frame: pd.DataFrame, least: int = 3, span_ns: int = 86_400_000_000_000, most: int = 14, state: tuple[dict, bool] | None = None) -> tuple[pd.DataFrame, tuple[dict, bool]]:
    """The exact form over one entity's alerts in order: first times of tactics, one alert until something expires (K5)."""
    first, fired = state or ({}, False)
    first, rows = dict(first), []
    for r in frame.itertuples():
        stale = [t for t, at in first.items() if at < r.timestamp_ns - span_ns]
        for t in stale:
            del first[t]
        fired = fired and not stale
        changed = False
        for t in r.mitre_tactics:
            if t not in first and len(first) < most:
                first[t], changed = r.timestamp_ns, True
        if (changed or not fired) and len(first) >= least and not fired:
            fired = True
            rows.append((r.entity_value, r.alert_id, r.timestamp_ns, len(first), min(1.0, len(first) / 5)))
    return pd.DataFrame(rows, columns=["entity_value", "alert_id", "timestamp_ns", "n_tactics", "risk_score"]), (first, fired)


def kill_chain(alerts: DataFrame, least: int = 3, span_ns: int = 86_400_000_000_000, segment: int = 100_000) -> DataFrame:
    """Kill chain alerts of each entity (K5): the exact fold, in segments of an entity's alerts."""
    kind = dict(alerts.dtypes)["alert_id"]

    def fold(pdf: pd.DataFrame, state: tuple[dict, bool] | None) -> tuple[pd.DataFrame, tuple[dict, bool]]:
        return kill_chain_fold(pdf, least, span_ns, state=state)

    rows = alerts.select("entity_value", "alert_id", "timestamp_ns", "mitre_tactics")
    return fold_by_key(rows, ["entity_value"], fold, f"entity_value string, alert_id {kind}, timestamp_ns long, n_tactics int, risk_score double", ("timestamp_ns", "alert_id"), segment)
