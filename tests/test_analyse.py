"""The whole batch analysis on lines whose alerts are worked out by hand and by plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from logsight.operators import correlate, rules
from logsight.plans import batch

SECOND = 10**9
ANN = "Failed password for user ann from 10.0.0.{}"


def lines():
    out = [(i, 60 * SECOND * i, ANN.format(i)) for i in range(5)]
    out += [(5, 400 * SECOND, "Accepted password for user ann from 10.0.0.9"), (6, 5000 * SECOND, "Accepted password for user ann from 10.0.0.9")]
    out += [(10 + i, 10_000 * SECOND + i, f"Accepted password for user bob from 192.168.1.{i}") for i in range(3)]
    out += [(20, 20_000 * SECOND, "sudo: user=eve incorrect"), (21, 20_100 * SECOND, "cat /etc/shadow user=eve"), (22, 20_200 * SECOND, "GET http://bad.example.org/x user=eve")]
    return out


SIGMA = [
    rules.Rule("s1", "Failed", "high", {"a": [("CommandLine", ("contains",), ("failed password",))]}, lambda s: s["a"], ("attack.credential-access",)),
    rules.Rule("s2", "Net", "low", {"a": [("SourceIp", ("cidr",), ("192.168.0.0/16",))]}, lambda s: s["a"], ("attack.discovery",)),
]


def plain_correlation(rule, key):
    """(entity, time) at which a rule fires, by walking over all lines before each line."""
    rows = [(re.search(key, m)[1], t, m) for _, t, m in lines() if re.search(key, m)]
    out = set()
    for e, t, _ in rows:
        window = [m for e2, t2, m in rows if e2 == e and t - rule.window_seconds * SECOND <= t2 <= t]
        met = sum(sum(bool(re.search(c.patterns["message"], m)) for m in window) >= c.min_count for c in rule.conditions)
        if met >= rule.min_sources:
            out.add((e, t))
    return out


def test_alerts_by_hand(spark):
    rows = spark.createDataFrame(lines(), "event_id long, timestamp_ns long, message string").withColumn("source_type", F.lit("auth"))
    bad = spark.createDataFrame([("BAD.example.org.", "domain", 90, ["command-and-control"], 1), ("10.0.0.9", "ipv4", 20, [], 1), ("10.9.9.9", "ipv4", 99, [], 1)], "value string, kind string, confidence int, phases array<string>, feed_order int")
    found = batch.all_alerts(rows, SIGMA, indicators=bad).collect()
    assert len({r.alert_id for r in found}) == len(found)
    by = Counter((r.alert_type, r.rule_name) for r in found)
    events = {r.timestamp_ns for r in found if r.rule_name == "s1"}
    assert events == {t for _, t, m in lines() if "Failed" in m}
    assert {r.timestamp_ns for r in found if r.rule_name == "s2"} == {t for _, t, m in lines() if "192.168." in m}
    for rule in correlate.RULES:
        if rule.entity_type == "user":
            wanted = plain_correlation(rule, r"user[ =](\w+)")
            assert {(r.entity, r.timestamp_ns) for r in found if r.rule_name == rule.name} == wanted
    assert by["correlation", "brute-force-lateral-movement"] == 1 and by["correlation", "privilege-escalation-chain"] == 2
    assert {(r.entity, r.severity_id, r.timestamp_ns) for r in found if r.alert_type == "ioc"} == {("bad.example.org", 5, 20_200 * SECOND), ("10.0.0.9", 2, 400 * SECOND), ("10.0.0.9", 2, 5000 * SECOND)}
    # nothing is warm yet
    assert not any(r.alert_type in ("ml", "ueba") for r in found)
    folded = batch.analyse(rows, SIGMA, 900 * SECOND, indicators=bad).collect()
    assert sum(r.dedup_count for r in folded) == len(found)
    one = next(r for r in folded if r.dedup_key.startswith("ioc:ioc-ipv4"))
    assert (one.dedup_count, one.anchor_ns) in {(1, 400 * SECOND), (1, 5000 * SECOND)}


def test_chains_across_families(spark):
    rows = [("c1", "sigma", 1, ["credential-access"]), ("c2", "ioc", 2, ["discovery", "lateral-movement"]), ("c3", "sigma", 3, [])]
    found = spark.createDataFrame([(a, k, "r", t * SECOND, 3, "ann", 0.5, m) for a, k, t, m in rows], "alert_id string, alert_type string, rule_name string, timestamp_ns long, severity_id int, entity string, risk_score double, tactics array<string>")
    got = batch.chain_alerts(found, 86_400 * SECOND).collect()
    assert [(r.entity, r.rule_name, r.timestamp_ns) for r in got] == [("ann", "kill-chain", 2 * SECOND)]


def test_graph_family(spark):
    day = 86_400 * SECOND
    rows = [(d * 10 + k, d * day + k, f"user=ann from 10.0.{d}.{k}") for d in range(6) for k in range(1 if d < 5 else 9)]
    events = batch.normalised(spark.createDataFrame(rows, "event_id long, timestamp_ns long, message string").withColumn("source_type", F.lit("s")))
    found = batch.graph_alerts(events, day).where("rule_name = 'fan-out'").collect()
    assert [(r.entity, r.timestamp_ns // day) for r in found] == [("user:ann", 5)]
