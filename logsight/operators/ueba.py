"""Behaviour of entities against their own past."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight.operators.aggregates import floor_to
from logsight.operators.folds import fold_by_key
from logsight.operators.lineage import settled
from logsight.operators.windows import ORDER, join_back

#: Weights of time of day, source novelty, volume and pattern novelty.
WEIGHTS = (0.25, 0.30, 0.20, 0.25)


def hour_of(ns: Column) -> Column:
    return F.pmod(F.floor(ns / 3_600_000_000_000), F.lit(24)).cast("int")


_HOUR = 3_600_000_000_000
_PAST = ("_seen", "_first_ns", "_last_ns", "_hour_n", "_top_n")


def past(events: DataFrame, key: str = "entity") -> DataFrame:
    """Adds what the key's earlier events are: their number, first and last time, the number in the event's hour of the day, and the largest of an hour.

    Events are counted by hour first. Inside one hour only that hour of the day
    grows, so a row needs its place in the hour and one row of what came before
    it: no window holds more than the events of one hour, or one row an hour.
    """
    cut = events.withColumn("_b", floor_to(F.col("timestamp_ns"), _HOUR))
    per = cut.groupBy(key, "_b").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"))
    of_hour = Window.partitionBy(key, "hour").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = per.withColumn("hour", hour_of(F.col("_b"))).withColumn("_h0", F.coalesce(F.sum("n").over(of_hour), F.lit(0)))
    starts = counted.select(key, "_b", "_h0", F.coalesce(F.sum("n").over(of_key), F.lit(0)).alias("_s0"), F.min("low").over(of_key).alias("_f0"), F.max("high").over(of_key).alias("_l0"), F.max(F.col("_h0") + F.col("n")).over(of_key).alias("_t0"))
    own = Window.partitionBy(key, "_b").orderBy(*ORDER)
    placed = cut.withColumns({"_r": F.row_number().over(own) - 1, "_f1": F.first("timestamp_ns").over(own), "_l1": F.lag("timestamp_ns").over(own)})
    both = join_back(placed, starts, [key, "_b"])
    hour_n = F.col("_h0") + F.col("_r")
    after = {"_seen": F.col("_s0") + F.col("_r"), "_first_ns": F.coalesce("_f0", F.when(F.col("_r") > 0, F.col("_f1"))), "_last_ns": F.coalesce("_l1", "_l0"), "_hour_n": hour_n, "_top_n": F.greatest(F.coalesce("_t0", F.lit(0)), hour_n)}
    return both.withColumns(after).drop("_b", "_r", "_f1", "_l1", "_h0", "_s0", "_f0", "_l0", "_t0")


def time_of_day(events: DataFrame, key: str = "entity") -> DataFrame:
    """1 - count of the hour / largest count of an hour, before the event."""
    return past(events, key).withColumn("time_of_day", _time_of_day()).drop(*_PAST)


def _time_of_day() -> Column:
    return F.when(F.col("_seen") > 0, 1 - F.col("_hour_n") / F.col("_top_n")).otherwise(0.0)


def source_novelty(events: DataFrame, key: str = "entity", ips: str = "related_ips") -> DataFrame:
    """Share of the event's addresses that the key has not had before; 0 without any."""
    return events.join(_new_share(events, key, ips), "event_id", "left").withColumn("source_novelty", F.coalesce("source_novelty", F.lit(0.0)))


def _new_share(events: DataFrame, key: str, ips: str) -> DataFrame:
    each = events.select("event_id", key, "timestamp_ns", F.explode(ips).alias("ip"))
    firsts = each.groupBy(key, "ip").agg(F.min(F.struct("timestamp_ns", "event_id")).alias("first"))
    new = join_back(each, firsts, [key, "ip"]).withColumn("new", F.struct("timestamp_ns", "event_id") == F.col("first"))
    return new.groupBy("event_id").agg(F.avg(F.col("new").cast("double")).alias("source_novelty"))


def volume_score(rate: Column) -> Column:
    """z of one event a minute against a mean rate, a third of it, from 0 to 1 (U4)."""
    lam = F.greatest(rate, F.lit(1e-6))
    return F.when(rate <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - lam) / F.sqrt(lam) / 3)))


def pattern_novelty(events: DataFrame, key: str = "entity") -> DataFrame:
    """1 for a template that the key has not had, 0 else or without a template (U5, the "seen before" form)."""
    return _pattern_novelty(events, _first_templates(events, key), key)


def _first_templates(events: DataFrame, key: str) -> DataFrame:
    return events.where("template_id IS NOT NULL").groupBy(key, "template_id").agg(F.min(F.struct(*ORDER)).alias("_first"))


def _pattern_novelty(events: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    seen = join_back(events, firsts, [key, "template_id"], "left")
    return seen.withColumn("pattern_novelty", F.coalesce((F.struct(*ORDER) == F.col("_first")).cast("double"), F.lit(0.0))).drop("_first")


def pattern_novelty_exact(events: DataFrame, key: str = "entity", alpha: float = 0.05, top: int = 32, segment: int = 100_000) -> DataFrame:
    """1 - weight / largest weight of decayed template weights, the `top` largest kept (U5), in segments of a key's events."""
    types = dict(events.dtypes)

    def fold(pdf: pd.DataFrame, weights: dict | None) -> tuple[pd.DataFrame, dict]:
        weights = weights or {}
        out = np.zeros(len(pdf))
        for i, t in enumerate(pdf["template_id"]):
            if pd.isna(t):
                continue
            most = max(weights.values(), default=0.0)
            out[i] = 1.0 if t not in weights else 0.0 if most <= 0 else 1 - weights[t] / most
            weights = {k: w * (1 - alpha) for k, w in weights.items()}
            weights[t] = weights.get(t, 0.0) + alpha
            if len(weights) > top:
                weights = dict(sorted(weights.items(), key=lambda x: -x[1])[:top])
        return pdf[[key, "event_id"]].assign(pattern_novelty=out), weights

    scored = fold_by_key(events.select(key, *ORDER, "template_id"), [key], fold, f"{key} {types[key]}, event_id {types['event_id']}, pattern_novelty double", segment=segment)
    return events.join(scored, [key, "event_id"])


def baselines(events: DataFrame, key: str = "entity", warm_events: int = 50, warm_ns: int = 7 * 86_400_000_000_000) -> DataFrame:
    """First and last time, count, busiest hour, volumes and warm-up of each key (U1); two shuffles of counts.

    A rate is observed at an event only, and then as 1, and the first one is
    taken as it is. So the moving averages of both rates are 1 from a key's
    first event on.
    """
    hours = events.groupBy(key, hour_of(F.col("timestamp_ns")).alias("hour")).agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"))
    per = hours.groupBy(key).agg(F.min("low").alias("first_seen_ns"), F.max("high").alias("last_seen_ns"), F.sum("n").alias("event_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "n")))).alias("hours"), F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))
    return per.withColumns({"volume_ema_min": F.lit(1.0), "volume_ema_hour": F.lit(1.0)}).withColumn("warm", (F.col("event_count") >= warm_events) & (F.col("last_seen_ns") - F.col("first_seen_ns") >= warm_ns))


def known_ips(events: DataFrame, key: str = "entity", ips: str = "related_ips", most: int = 64) -> DataFrame:
    """Addresses of each key, the most recent ones."""
    each = events.select(key, "timestamp_ns", F.explode(ips).alias("ip")).groupBy(key, "ip").agg(F.max("timestamp_ns").alias("last_ns"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("last_ns").desc(), "ip"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)


def warm_state(events: DataFrame, key: str = "entity", warm_events: int = 50, warm_ns: int = 7 * 86_400_000_000_000) -> DataFrame:
    """Whether the key had warmed up before the event."""
    return past(events, key).withColumn("warm", _warm(warm_events, warm_ns)).drop(*_PAST)


def _warm(warm_events: int, warm_ns: int) -> Column:
    return F.coalesce((F.col("_seen") >= warm_events) & (F.col("_last_ns") - F.col("_first_ns") >= warm_ns), F.lit(False))


def composite(events: DataFrame, key: str = "entity", weights: tuple[float, ...] = WEIGHTS, limit: float = 0.75, warm_events: int = 50, warm_ns: int = 7 * 86_400_000_000_000, volume: Column | None = None) -> DataFrame:
    """All scores against the past, their weighted sum, severity and alert flag (U6); 0 before warm-up.

    volume: the mean rate before the event; without it, that of `baselines`.
    """
    rate = volume if volume is not None else F.when(F.col("_seen") > 0, 1.0).otherwise(0.0)
    kept = settled(events, "behaviour")
    seen = past(kept, key).withColumns({"warm": _warm(warm_events, warm_ns), "time_of_day": _time_of_day(), "volume_ema_min": rate}).drop(*_PAST)
    known = seen.join(_new_share(kept, key, "related_ips"), "event_id", "left").withColumn("source_novelty", F.coalesce("source_novelty", F.lit(0.0)))
    scored = _pattern_novelty(known, _first_templates(kept, key), key).withColumn("volume", volume_score(F.col("volume_ema_min")))
    parts = ("time_of_day", "source_novelty", "volume", "pattern_novelty")
    total = sum((w * F.col(c) for w, c in zip(weights[1:], parts[1:], strict=True)), weights[0] * F.col(parts[0]))
    out = scored.withColumn("composite", F.when(F.col("warm"), total).otherwise(0.0))
    return out.withColumn("severity", F.least(F.lit(6), 1 + F.floor(6 * F.col("composite"))).cast("int")).withColumn("alert", F.col("composite") >= limit)


def lookup(baseline: DataFrame, wanted: DataFrame, key: str = "entity") -> DataFrame:
    """State of each asked key: warm, warming or unknown."""
    state = F.when(F.col("event_count").isNull(), "unknown").when(F.col("warm"), "warm").otherwise("warming")
    return wanted.join(baseline, key, "left").select(key, state.alias("state"), F.coalesce("event_count", F.lit(0)).alias("event_count"))
