"""Streams give what the batch operators give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsight.operators import alerts as al
from logsight.operators import correlate, detectors, graph, templates, windows
from logsight.plans.base import DAY, HOUR, alerts, events
from logsight.streaming import stream


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """Events and alerts as three files in order of time."""
    out = {}
    for name, df in (("events", events(spark, sf_dir)), ("alerts", al.risk_entries(alerts(spark, sf_dir)).join(alerts(spark, sf_dir).select("alert_id", "dedup_key", "mitre_tactics"), "alert_id"))):
        folder = str(tmp_path_factory.mktemp(name))
        pdf = df.toPandas().sort_values(["timestamp_ns", df.columns[0]], ignore_index=True)
        for i, rows in enumerate(np.array_split(np.arange(len(pdf)), 3)):
            spark.createDataFrame(pdf.iloc[rows], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        out[name] = (folder, spark.createDataFrame(pdf, df.schema))
    return out


def source(spark, parts, name):
    folder, df = parts[name]
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder), df


def same(a: pd.DataFrame, b: pd.DataFrame, keys: list[str], value: str):
    a, b = (x.sort_values(keys, ignore_index=True) for x in (a, b))
    assert a[keys].astype(str).equals(b[keys].astype(str))
    np.testing.assert_allclose(a[value].astype(float), b[value].astype(float), rtol=1e-9, atol=1e-12)


def test_risk(spark, parts, tmp_path):
    rows, df = source(spark, parts, "alerts")
    got = stream.with_state(rows, ["entity_value"], ["timestamp_ns", "alert_id"], stream.risk_step(DAY), "entity_value string, alert_id string, timestamp_ns long, risk double")
    stream.run_once(got, "risk", str(tmp_path))
    batch = windows.decayed_risk(df.withColumn("event_id", F.col("alert_id")), "entity_value", "points", DAY)
    same(spark.table("risk").toPandas(), batch.select("alert_id", "risk").toPandas(), ["alert_id"], "risk")


def test_dedup(spark, parts, tmp_path):
    rows, df = source(spark, parts, "alerts")
    got = stream.with_state(rows, ["dedup_key"], ["timestamp_ns", "alert_id"], stream.dedup_step(DAY), "dedup_key string, alert_id string, anchor_ns long, dedup_count long")
    stream.run_once(got, "dedup", str(tmp_path))
    same(spark.table("dedup").toPandas(), al.anchored(df, ["dedup_key"], DAY).toPandas(), ["alert_id", "anchor_ns"], "dedup_count")


def test_kill_chain(spark, parts, tmp_path):
    rows, df = source(spark, parts, "alerts")
    got = stream.with_state(rows, ["entity_value"], ["timestamp_ns", "alert_id"], stream.kill_chain_step(3, 3 * DAY), "entity_value string, alert_id string, timestamp_ns long, n_tactics int, risk_score double")
    stream.run_once(got, "chain", str(tmp_path))
    batch = correlate.kill_chain(df, 3, 3 * DAY).toPandas()
    assert len(batch)
    same(spark.table("chain").toPandas(), batch, ["alert_id"], "n_tactics")


def test_sliding_rule(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    flag = F.when(F.col("source_type").isin("error", "purchase"), F.col("source_type"))
    got = stream.windows_met(rows.withColumn("flag", flag), ["entity"], DAY, {"error": 3, "purchase": 1})
    stream.run_once(got, "rule", str(tmp_path))
    rule = correlate.CorrelationRule("x", "user", 86_400, 2, 5, (correlate.Condition("error", 3), correlate.Condition("purchase", 1)))
    batch = correlate.correlate(df.withColumn("entity_type", F.lit("user")), rule).toPandas()
    assert len(batch)
    same(spark.table("rule").toPandas(), batch, ["event_id"], "n_events")


@pytest.mark.parametrize("detector", [detectors.Cusum(warm_up=5), detectors.HoltWinters(season=24)])
def test_detectors(spark, parts, tmp_path, detector):
    rows, df = source(spark, parts, "events")
    name = type(detector).__name__
    got = stream.with_state(rows, ["source_type"], ["timestamp_ns", "event_id"], stream.bucket_step(detector, HOUR, ["source_type"]), "source_type string, event_id long, score double")
    stream.run_once(got, name, str(tmp_path))
    scores = detectors.fold_buckets(df, ["source_type"], detector, HOUR)
    same(spark.table(name).toPandas(), detectors.score_events(df, scores, ["source_type"], HOUR).select("event_id", "score").toPandas(), ["event_id"], "score")


def test_sequences(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    stream.run_once(stream.markov(rows, ["source_type", "entity"], warm_up=2), "markov", str(tmp_path))
    by_user = windows.markov_scores(df, ["source_type", "entity"], warm_up=2)
    same(spark.table("markov").toPandas(), by_user.select("event_id", "score").toPandas(), ["event_id"], "score")
    stream.run_once(stream.markov(rows.withColumn("all", F.lit("x")), ["all"], warm_up=5), "markov_all", str(tmp_path / "all"))
    batch = windows.markov_scores(df.withColumn("all", F.lit("x")), ["all"], warm_up=5).select("event_id", "score").toPandas()
    assert (batch["score"] > 0).sum() > 50
    same(spark.table("markov_all").toPandas(), batch, ["event_id"], "score")


def test_running_moments(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    got = stream.with_state(rows, ["source_type"], ["timestamp_ns", "event_id"], stream.z_step("value", ["source_type"]), "source_type string, event_id long, z double")
    stream.run_once(got, "moments", str(tmp_path))
    same(spark.table("moments").toPandas(), windows.running_z(df, ["source_type"], "value").select("event_id", "z").toPandas(), ["event_id"], "z")


def test_template_volume(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    detector = detectors.HoltWinters(season=24)
    got = stream.with_state(rows, ["source_type", "template_id"], ["timestamp_ns", "event_id"], stream.template_volume_step(detector, HOUR, 20), "source_type string, template_id int, event_id long, score double")
    stream.run_once(got, "volumes", str(tmp_path))
    batch = detectors.template_volume(df, detector, HOUR, 20).select("event_id", "score").toPandas()
    assert batch["score"].isna().any() and batch["score"].notna().any()
    same(spark.table("volumes").toPandas(), batch, ["event_id"], "score")


@pytest.mark.parametrize("window", [7, 50, 400])
def test_content_masses(spark, parts, tmp_path, window):
    rows, df = source(spark, parts, "events")
    forest = detectors.Forest(("f", "g"), trees=5, height=4, window=window)
    unit = lambda x: x.withColumns({"f": F.pmod(F.hash("event_id"), F.lit(1000)) / 1000, "g": F.pmod(F.col("value"), F.lit(1.0))})
    got = stream.with_state(unit(rows), ["source_type"], ["timestamp_ns", "event_id"], stream.forest_step(forest, "source_type"), "source_type string, event_id long, score double")
    stream.run_once(got, f"masses{window}", str(tmp_path))
    batch = detectors.forest_scores(unit(df), "source_type", forest).select("event_id", "score").toPandas()
    assert window > 50 or (batch["score"] > 0).any()
    same(spark.table(f"masses{window}").toPandas(), batch, ["event_id"], "score")


def test_entity_volume(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    refs = lambda x: x.withColumn("entity_refs", F.array("entity", F.concat(F.lit("h"), F.pmod(F.col("event_id"), F.lit(3)))))
    detector = detectors.HoltWinters(season=24)
    out = []
    query = stream.entity_volumes(refs(rows), detector, HOUR).writeStream.foreachBatch(lambda b, _: out.extend(stream.largest(b).collect())).outputMode("update").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = detectors.entity_volume(refs(df), detector, HOUR).select("event_id", "score").toPandas()
    assert (batch["score"] > 0).any() and len(out) == len(batch)
    same(pd.DataFrame([r.asDict() for r in out]), batch, ["event_id"], "score")


def test_tail_limits(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    t = detectors.TailThreshold(window=60, risk=0.01)
    got = stream.with_state(rows.withColumn("score", F.col("value")), ["source_type"], ["timestamp_ns", "event_id"], stream.tail_step(t, "source_type"), "source_type string, event_id long, anomaly boolean")
    stream.run_once(got, "tails", str(tmp_path))
    live = {r.event_id for r in spark.table("tails").where("anomaly").collect()}
    batch = detectors.tail_anomalies(df.withColumn("score", F.col("value")), "source_type", t)
    assert live == {r.event_id for r in batch.where("anomaly").collect()} and live


def test_branches(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    whole, timely = [], []
    stream.branches(rows, lambda b, _: whole.append(b.count()), lambda b, _: timely.append(b.count()), str(tmp_path)).awaitTermination()
    assert sum(whole) == df.count() and sum(timely) == sum(whole) and len(whole) == 3


def drained(result, checkpoint):
    """What a stream gives for the files that are there, and the rows in its state store after the last batch."""
    out = []
    query = result.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    return out, progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else None


SECOND = 10**9


def written(spark, folder, *batches, schema="k string, timestamp_ns long, alert_id string, points double, dedup_key string, entity string, event_id long, flag string"):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, t * SECOND, f"a{t}", 1.0, k, k, t, f) for k, t, f in rows], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_silent_keys_leave_the_store(spark, tmp_path):
    """Of 60 keys that speak once, none is left when time has passed; late rows behind the watermark are left out."""
    old = [(f"k{i}", i, "x") for i in range(1, 61)]
    rows = written(spark, str(tmp_path / "in"), old, [("new", 5000, "x")], [("new", 5001, "x")], [("new", 5002, "x"), ("k1", 100, "x")], [("new", 5003, "x")])
    schema = "dedup_key string, alert_id string, anchor_ns long, dedup_count long"
    step = stream.dedup_step(900 * SECOND)
    kept, total = drained(stream.with_state(rows, ["dedup_key"], ["timestamp_ns", "alert_id"], step, schema), str(tmp_path / "a"))
    short, left = drained(stream.with_state(rows, ["dedup_key"], ["timestamp_ns", "alert_id"], step, schema, idle_ns=900 * SECOND), str(tmp_path / "b"))
    late = {r.alert_id for r in kept} - {r.alert_id for r in short}
    assert late == {"a100"} and sorted(r for r in kept if r.alert_id != "a100") == sorted(short)
    assert left < 10 < total


def test_window_lists_expire(spark, tmp_path):
    batches = [[(f"k{i}", i % 7, "x") for i in range(40)], [("k1", 8, "y"), ("k2", 9, "x")], [("k3", 4000, "x")], [("k3", 4001, "y")], [("k3", 4003, "y")]]
    rows = written(spark, str(tmp_path / "in"), *batches)
    every, total = drained(stream.windows_met(rows, ["entity"], 60 * SECOND, {"x": 1, "y": 1}), str(tmp_path / "a"))
    found, left = drained(stream.windows_met(rows, ["entity"], 60 * SECOND, {"x": 1, "y": 1}, idle_ns=60 * SECOND), str(tmp_path / "b"))
    assert sorted(every) == sorted(found) and {(r.entity, r.n_events) for r in found} == {("k1", 2), ("k3", 2), ("k3", 3)}
    assert left < 12 < total


def test_mined_templates(spark, tmp_path):
    """Streamed templates are those of the batch rule on lines in order of how common their masks are; ids outlive a restart."""
    bodies = ["session opened for user {0}", "session closed for user root", "session opened for root {0}", "disk full on node {0}", "disk gone on node {0} now", "disk full at node x"]
    masks = [b.replace("{0}", "<*>") for b in bodies for _ in range(1)]
    lines = [(i, f"{bodies[k]}".replace("{0}", f"n{i}")) for i, k in enumerate(k for k in range(len(bodies)) for _ in range(20 - 3 * k))]
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")

    def put(part, number):
        spark.createDataFrame([(i, i * SECOND, m) for i, m in part], "event_id long, timestamp_ns long, message string").coalesce(1).write.parquet(f"{folder}/{number}")

    put(lines[:25], 0)
    rows = spark.readStream.schema("event_id long, timestamp_ns long, message string").option("recursiveFileLookup", True).parquet(folder)
    first, _ = drained(stream.mined(rows), checkpoint)
    put(lines[25:], 1)
    second, _ = drained(stream.mined(rows), checkpoint)
    got = first + second
    assert sorted(r.event_id for r in got) == [i for i, _ in lines]
    groups = {}
    for m, n in ((m, 20 - 3 * k) for k, m in enumerate(masks)):
        groups.setdefault((len(m.split()), tuple(m.split()[:2])), []).append((m, n))
    wanted = {t for g in groups.values() for t in templates.merge_masks(g).values()}
    final = {}
    for r in sorted(got, key=lambda r: r.event_id):
        final[r.template_id] = (r.template, r.n)
    assert {t for t, _ in final.values()} == wanted
    assert sum(n for _, n in final.values()) == len(lines)
    again, _ = drained(stream.mined(rows), str(tmp_path / "d"))
    assert {r.template_id for r in again} == set(final)


def test_counts(spark, parts, tmp_path):
    rows, df = source(spark, parts, "events")
    stream.run_once(stream.template_counts(rows.withColumn("template", F.col("source_type"))), "templates", str(tmp_path / "a"), "complete")
    assert {r.template: r.event_count for r in spark.table("templates").collect()} == {r.source_type: r["count"] for r in df.groupBy("source_type").count().collect()}


def test_detector_formulas():
    cusum = detectors.Cusum(warm_up=3)
    calm = cusum.step(cusum.start(), pd.DataFrame({"n": [5] * 40}))
    assert (calm == 0).all()
    jump = cusum.step(cusum.start(), pd.DataFrame({"n": [5] * 20 + [60] * 6}))
    assert jump[20:].max() > 0 and (jump < 1).all()
    shape, scale = detectors.fit_tail(np.random.default_rng(1).exponential(2.0, 4000))
    assert abs(shape) < 0.1 and abs(scale - 2) < 0.2


def test_graph_results(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source_id string, target_id string").withColumn("rel_type", F.lit("r"))
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and graph.shortest_path(e, "a", "x") == []
    assert {r.node: r.depth for r in graph.neighbours(e, "b", 2).collect()} == {"a": 1, "c": 1, "d": 2}
    b = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert b["a"] == 0 and abs(b["b"] - 2 / 10) < 1e-9
    assert abs(sum(r["rank"] for r in graph.pagerank(e).collect()) - 1) < 1e-9
    c = {r.node: r.community for r in graph.communities(e).collect()}
    assert c["x"] == c["y"] != c["a"]
