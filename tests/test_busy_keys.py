"""Operators on keys with very many rows: equal to plain folds, without one task that holds a key."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logsight.operators import alerts as al
from logsight.operators import correlate, detectors, folds, ueba, windows
from logsight.sources import sinks


def plain_anchors(rows, window):
    """(key, id): (anchor, number), one row after the other."""
    out, state = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        anchor, n = state.get(key, (None, 0))
        anchor, n = (anchor, n + 1) if anchor is not None and abs(t - anchor) <= window else (t, 1)
        state[key] = (anchor, n)
        out[key, i] = (anchor, n)
    return out


def test_anchors_of_bursts(spark):
    rng = random.Random(4)
    window, rows = 100, []
    for key, step in (("steady", 7), ("dense", 1), ("edges", 100), ("beyond", 101), ("wide", 260), (None, 30), ("same", 0), ("mixed", None)):
        t = rng.randint(-500, 500)
        for i in range(400):
            t += rng.choice((0, 1, 50, 99, 100, 101, 102, 250, 1000)) if step is None else step
            rows.append((key, t, f"{key}{i:04d}"))
    df = spark.createDataFrame(rows, "k string, timestamp_ns long, alert_id string").repartition(7)
    got = {(r.k, r.alert_id): (r.anchor_ns, r.dedup_count) for r in al.anchored(df, ["k"], window).collect()}
    assert got == plain_anchors(rows, window)
    assert al.anchored(df.limit(0), ["k"], window).count() == 0


def test_one_long_burst(spark):
    """A million alerts without a gap: anchors follow from arithmetic, and the plan holds no Python."""
    n, step, window = 1_000_000, 3, 1000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * step).alias("timestamp_ns"), F.col("id").alias("alert_id"))
    found = al.anchored(df, ["k"], window)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    every = window // step + 1  # rows of an anchor
    wrong = found.where((F.col("anchor_ns") != F.floor(F.col("alert_id") / every) * every * step) | (F.col("dedup_count") != F.col("alert_id") % every + 1))
    assert wrong.count() == 0 and found.count() == n


def test_window_without_a_moving_frame(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice((rng.randint(-3000, 3000), rng.randint(0, 40))), i, None if i % 9 == 0 else rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "entity string, timestamp_ns long, event_id long, value double").repartition(5)
    w = Window.partitionBy("entity").orderBy("timestamp_ns").rangeBetween(-70, 0)
    moving = df.select("event_id", F.count("*").over(w).alias("n"), F.max("value").over(w).alias("top"), F.min("value").over(w).alias("low"))
    found = windows.within(df, ["entity"], 70, {"n": ("sum", F.lit(1)), "top": ("max", F.col("value")), "low": ("min", F.col("value"))})
    assert sorted(map(tuple, found.select("event_id", "n", "top", "low").collect())) == sorted(map(tuple, moving.collect()))
    frames = found._jdf.queryExecution().optimizedPlan().toString()
    assert "-70" not in frames.replace("- 70", "") or "RangeFrame, -70" not in frames


def test_kill_chain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"a{i}", rng.randint(0, 2000), rng.sample(["t1", "t2", "t3", "t4"], rng.randint(0, 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "entity_value string, alert_id string, timestamp_ns long, mitre_tactics array<string>")
    wanted = set()
    for e, i, t, _ in rows:
        n = len({x for e2, _, t2, m in rows if e2 == e and t - 15 <= t2 <= t for x in m})
        if n >= 3:
            wanted.add((i, e, t, n))
    assert {tuple(r) for r in correlate.kill_chain_window(df, 3, 15).collect()} == wanted and len(wanted) > 20


@pytest.mark.parametrize("segment", [1, 7, 50, 10_000])
def test_folds_hand_their_state_on(spark, segment):
    """Segments of any size give what one group gives."""
    rng = random.Random(6)
    rows = [(rng.choice("ab") if i % 3 else "a", i * 10 + rng.randint(0, 9), 2**60 + i, rng.randint(1, 6)) for i in range(60 if segment == 1 else 300)]
    df = spark.createDataFrame(rows, "entity string, timestamp_ns long, event_id long, template_id int").repartition(3)

    def total(pdf, state):
        sums = (state or 0) + pdf["template_id"].cumsum()
        return pdf[["entity", "event_id"]].assign(total=sums, text="x"), int(sums.iloc[-1])

    got = {(r.entity, r.event_id): r.total for r in folds.fold_by_key(df, ["entity"], total, "entity string, event_id long, total long, text string", segment=segment).collect()}
    sums, wanted = {}, {}
    for e, _, i, x in sorted(rows, key=lambda r: r[1:3]):
        sums[e] = sums.get(e, 0) + x
        wanted[e, i] = sums[e]
    assert got == wanted
    if segment > 1:
        whole = {r.event_id: r.pattern_novelty for r in ueba.pattern_novelty_exact(df, top=3).collect()}
        assert {r.event_id: r.pattern_novelty for r in ueba.pattern_novelty_exact(df, top=3, segment=segment).collect()} == whole


def test_exact_kill_chain_and_tails_in_segments(spark):
    rng = random.Random(8)
    marks = [(rng.choice("xy"), f"a{i:03d}", i * 5, rng.sample(["t1", "t2", "t3", "t4", "t5"], rng.randint(0, 2))) for i in range(200)]
    df = spark.createDataFrame(marks, "entity_value string, alert_id string, timestamp_ns long, mitre_tactics array<string>")
    whole = sorted(map(tuple, correlate.kill_chain(df, 3, 60).collect()))
    assert whole and sorted(map(tuple, correlate.kill_chain(df, 3, 60, segment=9).collect())) == whole
    t = detectors.TailThreshold(window=40)
    scored = spark.createDataFrame([("s", i, i, rng.gauss(0, 1) + 4 * (i % 37 == 0)) for i in range(400)], "source_type string, timestamp_ns long, event_id long, score double")
    whole = sorted(map(tuple, detectors.tail_anomalies(scored, "source_type", t).collect()))
    assert whole and sorted(map(tuple, detectors.tail_anomalies(scored, "source_type", t, segment=11).collect())) == whole


def test_no_rows_to_fold(spark):
    none = spark.createDataFrame([], "entity string, timestamp_ns long, event_id long, template_id int")
    assert ueba.pattern_novelty_exact(none).count() == 0


DAY = 86_400_000_000_000


def table(spark, path):
    return sorted((r.event_id, r.timestamp_ns, r.note, r.day.isoformat()) for r in spark.read.parquet(path).collect())


def test_event_writes_go_on(spark, tmp_path):
    path = str(tmp_path / "events")
    batch = lambda *rows: spark.createDataFrame(rows, "event_id long, timestamp_ns long, note string")
    sinks.write_events(batch((1, 10, "b"), (1, 10, "a"), (1, 11, "c"), (None, 5, "x"), (4, None, "x")), path)
    sinks.write_events(batch((2, DAY + 1, "d")), path)
    both = [(1, 10, "a", "1970-01-01"), (2, DAY + 1, "d", "1970-01-02")]
    assert table(spark, path) == both
    before = {f for f in (tmp_path / "events").rglob("*.parquet")}
    sinks.write_events(batch((2, DAY + 1, "again"), (3, DAY + 2, "e"), (-(2**63), 12, "f")), path)
    assert table(spark, path) == sorted([*both, (3, DAY + 2, "e", "1970-01-02"), (-(2**63), 12, "f", "1970-01-01")])
    assert before <= {f for f in (tmp_path / "events").rglob("*.parquet")}
    kept = table(spark, path)
    sinks.write_events(batch((2, DAY + 1, "again"), (3, DAY + 2, "e")), path)
    sinks.write_events(batch(), path)
    assert table(spark, path) == kept
    sinks.compact_days(spark, path, [datetime.date(1970, 1, 2)], files=1)
    assert table(spark, path) == kept
    assert len(list((tmp_path / "events" / "day=1970-01-02").glob("*.parquet"))) == 1


def past_rows():
    """Two keys and a null one over some days, with ties of time and templates left out."""
    rng = random.Random(12)
    hour = 3_600_000_000_000
    rows = []
    for i in range(900):
        t = rng.choice((rng.randint(-30 * hour, 60 * hour), rng.randint(0, 3) * hour, 5 * hour + rng.randint(0, 5)))
        rows.append((rng.choice(["a", "a", "a", "b", None]), t, i, rng.choice([None, 1, 2, 3, 4, 5]), [rng.choice("pqrs") for _ in range(rng.randint(0, 3))]))
    return rows


def plain_sequences(rows, epsilon, warm_up):
    """{event_id: score}, one event after the other."""
    out, state = {}, {}
    for key, _, i, cur, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, {"prev": None, "learned": 0, "pairs": {}, "totals": {}})
        prev, met, out[i] = s["prev"], len(s["totals"]), 0.0
        if prev is not None:
            pair, total = s["pairs"].get((prev, cur), 0), s["totals"].get(prev, 0)
            if s["learned"] >= warm_up and met:
                low = total + epsilon * met
                out[i] = (1.0 if met > 1 else 0.0) if not total else min(1.0, max(0.0, math.log((pair + epsilon) / low) / math.log(epsilon / low)))
            s["pairs"][prev, cur], s["totals"][prev] = pair + 1, total + 1
        s["prev"], s["learned"] = cur, s["learned"] + 1
    return out


@pytest.mark.parametrize("bucket", [1, 3_600_000_000_000, 10**18])
def test_sequences_by_buckets(spark, bucket):
    rows = past_rows()
    df = spark.createDataFrame(rows, "entity string, timestamp_ns long, event_id long, template_id int, related_ips array<string>").repartition(5)
    found = windows.markov_scores(df, ["entity"], 1e-4, 7, bucket)
    assert found.columns == [*df.columns, "score"]
    assert {r.event_id: r.score for r in found.collect()} == pytest.approx(plain_sequences(rows, 1e-4, 7))
    assert windows.markov_scores(df.limit(0), ["entity"]).count() == 0


def plain_behaviour(rows, warm_events, warm_ns):
    """{event_id: (warm, time_of_day, pattern_novelty, source_novelty)}, one event after the other."""
    out, state = {}, {}
    for key, t, i, template, ips in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, {"times": [], "hours": {}, "templates": set(), "ips": set()})
        hour = t // 3_600_000_000_000 % 24
        usual = 1 - s["hours"].get(hour, 0) / max(s["hours"].values()) if s["hours"] else 0.0
        warm = len(s["times"]) >= max(warm_events, 1) and s["times"][-1] - s["times"][0] >= warm_ns
        out[i] = (warm, usual, float(template is not None and template not in s["templates"]), sum(ip not in s["ips"] for ip in ips) / len(ips) if ips else 0.0)
        s["times"].append(t)
        s["hours"][hour] = s["hours"].get(hour, 0) + 1
        s["templates"].add(template)
        s["ips"].update(ips)
    return out


def test_behaviour_by_hours(spark):
    rows = past_rows()
    warm_ns = 20 * 3_600_000_000_000
    df = spark.createDataFrame(rows, "entity string, timestamp_ns long, event_id long, template_id int, related_ips array<string>").repartition(5)
    plain = plain_behaviour(rows, 30, warm_ns)
    found = ueba.composite(df, warm_events=30, warm_ns=warm_ns).collect()
    assert sorted(r.event_id for r in found) == list(range(len(rows)))
    for r in found:
        warm, usual, pattern, sources = plain[r.event_id]
        assert (r.warm, r.time_of_day, r.pattern_novelty, r.source_novelty) == pytest.approx((warm, usual, pattern, sources))
    assert {r.event_id: r.warm for r in ueba.warm_state(df, "entity", 30, warm_ns).collect()} == {i: p[0] for i, p in plain.items()}
    assert {r.event_id: r.time_of_day for r in ueba.time_of_day(df).collect()} == pytest.approx({i: p[1] for i, p in plain.items()})
    assert any(p[0] for p in plain.values()) and ueba.composite(df.limit(0)).count() == 0


@pytest.mark.parametrize("score", [lambda df: windows.markov_scores(df, ["entity"]), ueba.composite])
def test_no_window_over_a_whole_key(spark, score):
    """Windows over rows are partitioned by bucket as well; those by key alone read one row a bucket."""
    df = spark.createDataFrame(past_rows(), "entity string, timestamp_ns long, event_id long, template_id int, related_ips array<string>")
    plan = score(df)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "timestamp_ns" in line.split("windowspecdefinition", 1)[-1]]
    assert over_rows and all("_b#" in line for line in over_rows)
