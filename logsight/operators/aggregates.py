"""Aggregates over events, alerts and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight.functions import attack


def floor_to(time: Column, bucket: int) -> Column:
    return (time - F.pmod(time, F.lit(bucket))).cast("long")


def bucketed_counts(alerts: DataFrame, bucket_ns: int, start_ns: int, end_ns: int) -> DataFrame:
    """Alerts by bucket, type and rule in [start, end)."""
    inside = alerts.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns))
    return inside.groupBy(floor_to(F.col("timestamp_ns"), bucket_ns).alias("bucket_ns"), "alert_type", "rule_name").agg(F.count("*").alias("n"))


def grouped_counts(alerts: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Alerts by rule in [start, end)."""
    return alerts.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns)).groupBy("rule_name").agg(F.count("*").alias("n"))


def severity_counts(alerts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Alerts by lower-case severity name; other numbers are unknown."""
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, [n.lower() for n in names])), (F.when(F.col("severity_id") >= 0, F.col("severity_id") + 1).otherwise(100)).cast("int")), F.lit("unknown"))
    return alerts.groupBy(name.alias("severity")).agg(F.count("*").alias("n"))


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """The newest verdict of each alert."""
    return feedback.groupBy("alert_id").agg(F.max_by("feedback", F.struct("submitted_at_ns", "id")).alias("feedback"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """tp, fp and total of the newest verdicts."""
    is_ = lambda v: F.coalesce(F.sum(F.when(F.col("feedback") == v, 1)), F.lit(0))
    return latest_verdicts(feedback).agg(is_("tp").alias("tp"), is_("fp").alias("fp"), F.count("*").alias("total"))


def tp_patterns(feedback: DataFrame, alerts: DataFrame, min_tp: int = 3, most_ids: int = 16) -> DataFrame:
    """Groups of alerts confirmed by the newest verdict."""
    confirmed = latest_verdicts(feedback).where("feedback = 'tp'").join(alerts, "alert_id")
    ranked = confirmed.withColumn("r", F.row_number().over(Window.partitionBy("alert_type", "rule_name", "entity_type").orderBy(F.col("timestamp_ns").desc(), F.col("alert_id").desc())))
    groups = ranked.groupBy("alert_type", "rule_name", "entity_type").agg(
        F.count("*").alias("tp_count"),
        F.max("timestamp_ns").alias("last_ns"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most_ids, F.struct("r", "alert_id")))), lambda s: s["alert_id"]).alias("ids"),
    )
    return groups.where(F.col("tp_count") >= min_tp).select("alert_type", "rule_name", "entity_type", "tp_count", "last_ns", F.array_join("ids", ",").alias("sample_ids"))


def template_catalog(lines: DataFrame, example_chars: int = 500) -> DataFrame:
    """First and last time, count and first example of each template."""
    return lines.groupBy("template").agg(
        F.min("timestamp_ns").alias("first_seen_ns"), F.max("timestamp_ns").alias("last_seen_ns"), F.count("*").alias("event_count"), F.substring(F.min_by("message", F.struct("timestamp_ns", "event_id")), 1, example_chars).alias("example")
    )


def edge_table(pairs: DataFrame) -> DataFrame:
    """First and last time and count of each (source, target, relation)."""
    return pairs.groupBy("source_id", "target_id", "rel_type").agg(F.min("timestamp_ns").alias("first_seen"), F.max("timestamp_ns").alias("last_seen"), F.count("*").alias("event_count"))


def grid(bounds: DataFrame, bucket: int, low: str = "low", high: str = "high") -> DataFrame:
    """Every bucket from low up to high, high itself left out."""
    first = floor_to(F.col(low), bucket)
    return bounds.withColumn("bucket_ns", F.explode(F.sequence(first, F.greatest(first, F.col(high) - 1), F.lit(bucket))))


def anomaly_timeline(scores: DataFrame, bucket_ns: int, base_ns: int = 60_000_000_000) -> DataFrame:
    """Scores by bucket on a dense grid; thresholds are carried forward.

    scores: source_type, timestamp_ns, event_id, score, threshold.
    """
    base = scores.groupBy("source_type", floor_to(F.col("timestamp_ns"), base_ns).alias("base_ns")).agg(
        F.max("score").alias("m"), F.sum("score").alias("s"), F.count("*").alias("n"), F.max_by("threshold", F.struct("timestamp_ns", "event_id")).alias("t"), F.max("timestamp_ns").alias("at")
    )
    per_source = base.groupBy("source_type", floor_to(F.col("base_ns"), bucket_ns).alias("bucket_ns")).agg(F.max("m").alias("m"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.max_by("t", "at").alias("t"))
    merged = per_source.groupBy("bucket_ns").agg(F.max("m").alias("max_score"), F.sum("s").alias("sum_score"), F.sum("n").alias("event_count"), F.max("t").alias("t"))
    bounds = merged.agg(F.min("bucket_ns").alias("low"), (F.max("bucket_ns") + 1).alias("high")).where("low IS NOT NULL")
    dense = grid(bounds, bucket_ns).select("bucket_ns").join(merged, "bucket_ns", "left")
    carried = F.last("t", ignorenulls=True).over(Window.orderBy("bucket_ns").rowsBetween(Window.unboundedPreceding, 0))  # one row a bucket of time
    return dense.select("bucket_ns", F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("sum_score", F.lit(0.0)).alias("sum_score"), F.coalesce(F.col("sum_score") / F.col("event_count"), F.lit(0.0)).alias("avg_score"), F.coalesce("event_count", F.lit(0)).alias("event_count"), carried.alias("threshold"))


def risk_history(alerts: DataFrame, bucket_ns: int, start_ns: int, end_ns: int) -> DataFrame:
    """Dense buckets of summed risk for each entity, with the rule of most risk."""
    inside = alerts.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns))
    found = inside.groupBy("entity_value", floor_to(F.col("timestamp_ns"), bucket_ns).alias("bucket_ns")).agg(F.sum("risk_score").alias("risk"), F.count("*").alias("n"), F.max_by("rule_name", F.struct(F.col("risk_score"), -F.col("timestamp_ns"))).alias("top_rule"))
    cells = grid(inside.select("entity_value").distinct().select("entity_value", F.lit(start_ns).alias("low"), F.lit(end_ns).alias("high")), bucket_ns).select("entity_value", "bucket_ns")
    return cells.join(found, ["entity_value", "bucket_ns"], "left").select("entity_value", "bucket_ns", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("n", F.lit(0)).alias("n"), "top_rule")


def firing_sparkline(alerts: DataFrame, end_ns: int, hours: int = 24) -> DataFrame:
    """Counts of each rule in exactly `hours` hourly buckets."""
    hour = 3_600_000_000_000
    start = end_ns - hours * hour
    slot = ((F.col("timestamp_ns") - start) / hour).cast("int")
    counted = alerts.where((F.col("timestamp_ns") >= start) & (F.col("timestamp_ns") < end_ns)).groupBy("rule_name", slot.alias("slot")).agg(F.count("*").alias("n"))
    cells = alerts.select("rule_name").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return cells.join(counted, ["rule_name", "slot"], "left").select("rule_name", "slot", F.coalesce("n", F.lit(0)).alias("n"))


def _tactic_pairs(df: DataFrame, key: str) -> DataFrame:
    """(tactic, parent technique) of each row, parents once a row."""
    parents = F.array_distinct(F.transform("techniques", attack.parent))
    own = F.array_distinct(F.filter(F.transform("tactics", attack.tactic), lambda t: t.isNotNull()))
    return df.select(key, F.explode(own).alias("tactic"), parents.alias("parents")).select(key, "tactic", F.explode("parents").alias("technique"))


def coverage(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules and alerts for each tactic and parent technique.

    rules: rule_id, title, tactics, techniques; alerts: alert_id, tactics, techniques.
    """
    by_rule = _tactic_pairs(rules, "title").groupBy("tactic", "technique").agg(F.count("*").alias("rule_count"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("rules"))
    by_alert = _tactic_pairs(alerts, "alert_id").groupBy("tactic", "technique").agg(F.count("*").alias("alert_count"))
    both = by_rule.join(by_alert, ["tactic", "technique"], "full_outer")
    order = F.lit(len(attack.TACTICS))
    for i, (name, _) in enumerate(attack.TACTICS.values()):
        order = F.when(F.col("tactic") == name, i).otherwise(order)
    return both.select("tactic", "technique", F.coalesce("rule_count", F.lit(0)).alias("rule_count"), F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("alert_count", F.lit(0)).alias("alert_count"), (F.coalesce("rule_count", F.lit(0)) > 0).alias("covered"), (F.coalesce("alert_count", F.lit(0)) > 0).alias("detected"), order.alias("tactic_order"))


def entity_facets(matched: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Distinct (type, value) over events, with when each was first seen."""
    pairs = F.flatten(F.array(*(_typed(c, k) for k, c in lists.items())))
    return matched.select("timestamp_ns", F.explode(pairs).alias("p")).groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(F.min("timestamp_ns").alias("first_ns"), F.count("*").alias("n"))


def _typed(column: str, kind: str) -> Column:
    return F.transform(F.col(column), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def pipeline_stats(events: DataFrame) -> DataFrame:
    """Totals, sources, span and rate in one pass."""
    span = (F.max("timestamp_ns") - F.min("timestamp_ns")) / F.lit(1e9)
    return events.agg(F.count("*").alias("events"), F.countDistinct("source_type").alias("sources"), F.sum(F.when(F.col("severity_id") >= 4, 1).otherwise(0)).alias("errors"), F.max("timestamp_ns").alias("last_ns"), F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("rate"))


def latency_percentiles(samples: DataFrame, key: str, value: str) -> DataFrame:
    """p50, p95 and p99 with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return samples.groupBy(key).agg(p.alias("p"), F.count("*").alias("n")).select(key, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "n")


def latency_sketches(samples: DataFrame, keys: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """One KLL sketch of the values for each group, to be kept and merged.

    A sketch has a few thousand bytes whatever it has seen, and is made and
    merged on both sides of the shuffle, so no task holds the values of a key.
    The rank of a quantile is wrong by about 2 / k of the rows at most (0.5 %).
    """
    return samples.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p50, p95 and p99 of the groups' merged sketches."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    return merged.select(*keys, *(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(q))).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)), "n")


def rule_counters(matches: DataFrame) -> DataFrame:
    """Lifetime count and last time of each rule."""
    return matches.groupBy("rule_id").agg(F.count("*").alias("match_count"), F.max("timestamp_ns").alias("last_fired_ns"))


def rules_with_counts(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Every rule with its alerts, 0 without any."""
    return rules.join(counts, rules.title == counts.rule_name, "left").select("rule_id", "title", F.coalesce("n", F.lit(0)).alias("alerts"))


def busiest_hours(events: DataFrame, key: str = "entity", most: int = 3) -> DataFrame:
    """The hours of day with most events of each key."""
    hour = F.pmod(F.floor(F.col("timestamp_ns") / 3_600_000_000_000), F.lit(24)).cast("int")
    counted = events.groupBy(key, hour.alias("hour")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "hour"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)
