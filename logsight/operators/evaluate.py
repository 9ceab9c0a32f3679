"""Detection quality against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_labels(alerts: DataFrame, labels: DataFrame, window_s: int = 60) -> DataFrame:
    """(alert_id, label_id) with equal entity and times at most window_s apart.

    alerts: alert_id, entity_value, time_s; labels: label_id, time_s, candidates
    array<string>. An equi-join on entity and time bucket, the neighbouring
    buckets included, with the exact test after it: never all pairs.
    """
    wide = max(1, window_s)
    probe = alerts.select("alert_id", F.lower(F.trim("entity_value")).alias("entity"), F.col("time_s").alias("a_s"), F.explode(F.array(*(F.floor(F.col("time_s") / wide) + d for d in (-1, 0, 1)))).alias("bucket"))
    wanted = labels.select("label_id", F.col("time_s").alias("l_s"), F.explode(F.array_distinct("candidates")).alias("entity"), F.floor(F.col("time_s") / wide).alias("bucket"))
    return probe.join(wanted, ["entity", "bucket"]).where(F.abs(F.col("a_s") - F.col("l_s")) <= window_s).select("alert_id", "label_id").distinct()


def verdicts(alerts: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(kind, id): tp and fp alerts, fn labels."""
    tp = alerts.join(matches, "alert_id", "left_semi").select(F.lit("tp").alias("kind"), F.col("alert_id").cast("string").alias("id"))
    fp = alerts.join(matches, "alert_id", "left_anti").select(F.lit("fp").alias("kind"), F.col("alert_id").cast("string").alias("id"))
    fn = labels.join(matches, "label_id", "left_anti").select(F.lit("fn").alias("kind"), F.col("label_id").cast("string").alias("id"))
    return tp.unionByName(fp).unionByName(fn)


def _ratio(top: Column, low: Column) -> Column:
    return F.when(low > 0, top / low).otherwise(0.0)


def metrics(found: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and share of false alerts."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, 1)), F.lit(0))
    c = found.agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), _ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("fp_rate"))


def scenarios(labels: DataFrame, alerts: DataFrame, matches: DataFrame, scenario: Column) -> DataFrame:
    """Size, first time, time to detection and misses of each scenario."""
    named = labels.withColumn("scenario", scenario)
    hit = matches.join(alerts.select("alert_id", F.col("time_s").alias("a_s")), "alert_id").groupBy("label_id").agg(F.min("a_s").alias("a_s"))
    each = named.join(hit, "label_id", "left")
    return each.groupBy("scenario").agg(F.count("*").alias("n"), F.min("time_s").alias("first_s"), F.min("a_s").alias("detected_s"), F.sum(F.col("a_s").isNull().cast("int")).alias("missed")).withColumn("time_to_detect_s", F.col("detected_s") - F.col("first_s"))


def sweep(scored: DataFrame, score: str = "score", truth: str = "is_tp") -> DataFrame:
    """TP, FP, precision, recall and FP share at each threshold: distinct scores, 0 and 1.

    Counts are grouped by score first, so the running sum sees one row a score.
    """
    per = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("t"), F.sum((~F.col(truth)).cast("long")).alias("f"))
    ends = scored.sparkSession.createDataFrame([(0.0,), (1.0,)], "threshold double").join(per.select("threshold"), "threshold", "left_anti")
    every = per.unionByName(ends.select("threshold", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("f")))
    w = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    c = every.select("threshold", F.sum("t").over(w).alias("tp"), F.sum("f").over(w).alias("fp"), F.sum("t").over(whole).alias("p"), F.sum("f").over(whole).alias("n"))
    return c.select("threshold", "tp", "fp", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"), _ratio(F.col("fp"), F.col("n")).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """Area under (fpr, recall) by trapezoids, between 0 and 1; null without points."""
    points = curve.select(F.col("fpr").alias("x"), F.col("recall").alias("y")).distinct()
    w = Window.orderBy("x", "y")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    return points.select(area.alias("a")).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("a"))).alias("auc"))


def missed_attribution(labels: DataFrame, matches: DataFrame, scenario: Column, families: dict[str, str]) -> DataFrame:
    """Missed labels with the detector family that should have spoken."""
    family = F.create_map(*(F.lit(x) for pair in families.items() for x in pair))
    return labels.join(matches, "label_id", "left_anti").withColumn("scenario", scenario).select("label_id", "scenario", F.coalesce(F.try_element_at(family, F.col("scenario")), F.lit("unknown")).alias("family"))
