"""Filters, lookups, pages and joins of the query surface (Q*, J1, J2, J6, J8-J11, T*)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

_SPANS = {"m": 60, "h": 3600, "d": 86_400}


def span_ns(text: str) -> int:
    """Nanoseconds of 30m, 1h or 7d."""
    found = re.fullmatch(r"([0-9]+)([mhd])", text)
    if not found or not int(found[1]):
        raise ValueError(f"not a span: {text!r}")
    return int(found[1]) * _SPANS[found[2]] * 1_000_000_000


def time_range(as_of_ns: int, last: str = "24h") -> tuple[int, int]:
    return as_of_ns - span_ns(last), as_of_ns


def _all(conditions: list[Column | None]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def event_filter(start_ns: int | None = None, end_ns: int | None = None, source_type: str | None = None, min_severity: int | None = None, template_id: int | None = None, entity: str | None = None, text: str | None = None) -> Column:
    """AND of the given conditions; both ends of the time belong to it (Q1)."""
    return _all([
        F.col("timestamp_ns") >= start_ns if start_ns is not None else None,
        F.col("timestamp_ns") <= end_ns if end_ns is not None else None,
        F.col("source_type") == source_type if source_type is not None else None,
        F.col("severity_id") >= min_severity if min_severity is not None else None,
        F.col("template_id") == template_id if template_id is not None else None,
        F.array_contains("entity_refs", entity) if entity is not None else None,
        phrase_match(F.col("message"), text) if text is not None else None,
    ])


def alert_filter(start_ns: int | None = None, end_ns: int | None = None, alert_type: str | None = None, min_severity: int | None = None, tactic: str | None = None, technique: str | None = None) -> Column:
    """As `event_filter`, for alerts (Q2); a technique matches its parts too (Q4)."""
    return _all([
        F.col("timestamp_ns") >= start_ns if start_ns is not None else None,
        F.col("timestamp_ns") <= end_ns if end_ns is not None else None,
        F.col("alert_type") == alert_type if alert_type is not None else None,
        F.col("severity_id") >= min_severity if min_severity is not None else None,
        F.array_contains("mitre_tactics", tactic) if tactic is not None else None,
        technique_match(F.col("mitre_techniques"), technique) if technique is not None else None,
    ])


def technique_match(techniques: Column, wanted: str) -> Column:
    """A parent matches itself and its parts, a part only itself (Q4)."""
    return F.exists(techniques, lambda t: (t == wanted) | F.startswith(t, F.lit(wanted + ".")))


def _tokens(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def phrase_match(text: Column, phrase: str, most: int = 256) -> Column:
    """The phrase's words stand next to each other in the text (Q3)."""
    clean = "".join(c for c in phrase if c.isprintable() and c != '"')[:most].lower()
    words = " ".join(re.findall(r"[^\W_]+", clean))
    return F.contains(F.concat(F.lit(" "), _tokens(text), F.lit(" ")), F.lit(f" {words} "))


def words_match(text: Column, words: Sequence[str]) -> Column:
    """All words stand somewhere in the text (Q3, the other form)."""
    own = F.split(_tokens(text), " ")
    return _all([F.array_contains(own, w.lower()) for w in words])


def newest(df: DataFrame, page: int = 1, limit: int = 100, most: int = 1000, time: str = "timestamp_ns", key: str = "event_id") -> DataFrame:
    """One page, newest first."""
    limit = max(1, min(limit, most))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).offset((page - 1) * limit).limit(limit)


def page_info(total: int, page: int, limit: int) -> dict[str, int | bool]:
    """What a page belongs to (Q10)."""
    return {"total": total, "page": page, "limit": limit, "has_next": page * limit < total}


def regex_condition(field: Column, pattern: str, is_array: bool = False, most_values: int = 20, most_chars: int = 4096) -> Column:
    """The pattern is found in the value, or in one of the first values; null is false (Q5)."""
    if len(pattern) > 512:
        raise ValueError("a pattern has at most 512 characters")
    if is_array:
        hit = F.exists(F.slice(field, 1, most_values), lambda v: F.rlike(F.substring(v, 1, most_chars), F.lit(pattern)))
    else:
        hit = F.rlike(F.substring(field.cast("string"), 1, most_chars), F.lit(pattern))
    return F.coalesce(hit, F.lit(False))


def live_filter(sources: Sequence[str] = (), min_severity: int = 0, templates: Sequence[int] = ()) -> Column:
    """Filter of a live view; an empty set lets all pass (Q7)."""
    return _all([F.col("source_type").isin(*sources) if sources else None, F.col("severity_id") >= min_severity, F.col("template_id").isin(*templates) if templates else None])


def rule_filter(category: str | None = None, severities: Sequence[str] = (), product: str | None = None, enabled: bool | None = None, title: str | None = None, technique: str | None = None) -> Column:
    """Filter of the rule list (Q9)."""
    return _all([
        F.col("category") == category if category else None,
        F.col("level").isin(*severities) if severities else None,
        F.col("product") == product if product else None,
        F.col("enabled") == enabled if enabled is not None else None,
        F.contains(F.lower("title"), F.lit(title.lower())) if title else None,
        technique_match(F.col("techniques"), technique) if technique else None,
    ])


def entity_timeline(events: DataFrame, entity: str, start_ns: int, end_ns: int, source_type: str | None = None, min_severity: int | None = None, limit: int | None = None) -> DataFrame:
    """Events that refer to the entity, oldest first."""
    links = events.select("event_id", F.explode("entity_refs").alias("entity_uuid")).where(F.col("entity_uuid") == entity).distinct()
    found = events.where(event_filter(start_ns, end_ns, source_type, min_severity)).join(links, "event_id").orderBy("timestamp_ns", "event_id")
    return found.limit(limit) if limit else found


def alerts_with(alerts: DataFrame, tactic: str, technique: str | None = None) -> DataFrame:
    """Alerts joined with their tactics, a technique asked for by semi-join; one row a dedup_key."""
    tactics = alerts.select("alert_id", F.explode("mitre_tactics").alias("tactic")).where(F.col("tactic") == tactic).select("alert_id").distinct()
    out = alerts.join(tactics, "alert_id")
    if technique:
        marked = alerts.select("alert_id", F.explode("mitre_techniques").alias("t")).where((F.col("t") == technique) | F.startswith("t", F.lit(technique + ".")))
        out = out.join(marked, "alert_id", "left_semi")
    return out


def latest_per_key(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, in order of that time."""
    newest_row = df.groupBy(key).agg(F.max(time).alias("last_ns"), F.max_by(tie, F.struct(time, tie)).alias(tie), F.count("*").alias("n"))
    return newest_row.orderBy(F.col("last_ns").desc(), F.col(key))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (T4). Spark keeps only k rows a group before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def _runs(ids: Column) -> Column:
    """The stretches of an array in which each whole number follows the one before, as (first, last); a repeated number is in several."""
    follows = lambda i: F.coalesce(F.get(ids, i) == F.try_add(F.get(ids, i - 1), F.lit(1)), F.lit(False))
    first = F.filter(ids, lambda x, i: ~follows(i))
    last = F.filter(ids, lambda x, i: ~follows(i + 1))
    stretches = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    low, high = F.get(ids, F.lit(0)), F.get(ids, F.size(ids) - 1)
    # one stretch, the usual case, is found by comparing arrays, which is far cheaper
    whole = F.when(F.try_subtract(high, low) == F.size(ids) - 1, F.sequence(low, high) == ids)
    return F.when(whole, F.array(F.struct(low.alias("first"), high.alias("last")))).otherwise(stretches)


def hydrate(alerts: DataFrame, events: DataFrame, span: int = 86_400_000_000_000, most: int = 16, block: int = 256) -> DataFrame:
    """The last `most` contributing events of each alert within `span` of it.

    Whole numbers as ids are not joined one by one: an alert has a row for each
    block of ids that a stretch of them lies in, which meets the events of its
    entity in that block. Other ids are joined as they are.
    """
    own = events.select("event_id", "timestamp_ns", "entity", "source_type")
    wanted = alerts.select("alert_id", F.col("timestamp_ns").alias("alert_ns"), "entity_value", "contributing_events")
    if isinstance(alerts.schema["contributing_events"].dataType.elementType, IntegralType) and isinstance(own.schema["event_id"].dataType, IntegralType):
        runs = wanted.select("alert_id", "alert_ns", "entity_value", F.explode(_runs(F.col("contributing_events"))).alias("run")).where("run.first IS NOT NULL")
        at = lambda c: F.expr(f"{c} div {block}")
        parts = runs.select("alert_id", "alert_ns", "entity_value", "run", F.explode(F.sequence(at("run.first"), at("run.last"))).alias("block"))
        same = (F.col("entity") == F.col("entity_value")) & (F.col("_block") == F.col("block")) & F.col("event_id").between(F.col("run.first"), F.col("run.last"))
        met = parts.join(own.withColumn("_block", at("event_id")), same)
    else:
        met = wanted.withColumn("event_id", F.explode("contributing_events")).join(own, "event_id").where(F.col("entity") == F.col("entity_value"))
    near = met.where(F.abs(F.col("timestamp_ns") - F.col("alert_ns")) <= span)
    return top_per_group(near, ["alert_id"], [F.col("timestamp_ns").desc(), F.col("event_id").desc()], most).select("alert_id", "event_id", "timestamp_ns", "source_type")


def related(edges: DataFrame, entity: str | Column) -> DataFrame:
    """Neighbours of an entity either way."""
    both = edges.select("source_id", "target_id", "rel_type").union(edges.select("target_id", "source_id", "rel_type"))
    return both.where(F.col("source_id") == entity).select(F.col("target_id").alias("neighbour"), "rel_type").distinct()
