"""Queries on windows, detectors, behaviour, correlation, rules, alerts and the graph (W*, U*, K*, R*, H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsight.functions import identity
from logsight.operators import alerts as al
from logsight.operators import correlate, detectors, graph, rules, ueba, windows
from logsight.operators.lineage import settled
from logsight.plans import batch
from logsight.plans.base import AL, DAY, EV, GR, GRE, HOUR, LN, alerts, events, graph_edges, graph_rows, lines, query, rounded, table

BRUTE = correlate.CorrelationRule("brute-force", "user", 86_400, 2, 5, (correlate.Condition("error", 3), correlate.Condition("purchase", 1)))
UUID = "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12)"
K1 = f"{EV}, c AS (SELECT *, count(*) FILTER (WHERE source_type = 'error') OVER w AS c0, count(*) FILTER (WHERE source_type = 'purchase') OVER w AS c1 FROM ev WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)), k AS (SELECT *, c0 + c1 AS n_events, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('corr:brute-force:' || entity || ':' || timestamp_ns)) AS h FROM c WHERE c0 >= 3 AND c1 >= 1)"


@query("k1_bruteforce", f"WITH {K1} SELECT {UUID} AS alert_id, 'brute-force' AS rule_name, event_id, entity, timestamp_ns, n_events, round(0.5 + 0.4 * least(n_events / 10, 1), 6) AS risk_score FROM k")
def k1(spark, d):
    return correlate.correlate(events(spark, d).withColumn("entity_type", F.lit("user")), BRUTE)


@query("k2_contributing", f"WITH {EV}, c AS (SELECT *, count(*) FILTER (WHERE source_type = 'error') OVER w AS c0, count(*) FILTER (WHERE source_type = 'purchase') OVER w AS c1, list(event_id) FILTER (WHERE source_type IN ('error', 'purchase')) OVER w AS ids FROM ev WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)) SELECT event_id, array_to_string(list_sort(ids), ',') AS contributing FROM c WHERE c0 >= 3 AND c1 >= 1")
def k2(spark, d):
    found = correlate.correlate(events(spark, d).withColumn("entity_type", F.lit("user")), BRUTE, contributing=True)
    return found.select("event_id", F.array_join(F.array_sort("contributing_events"), ",").alias("contributing"))


# What the built-in rules look for, as lines of five addresses whose time runs 50 times as fast
SAID = (
    "CASE source_type WHEN 'error' THEN 'Failed password for u' || user_id WHEN 'view' THEN CASE WHEN value > 60 THEN 'Accepted password for u' || user_id ELSE 'session closed' END "
    "WHEN 'click' THEN CASE WHEN value > 40 THEN 'outbound http POST of 1048576 bytes' ELSE 'GET /' END WHEN 'purchase' THEN CASE WHEN value > 30 THEN 'scp of /etc/shadow' ELSE 'read page' END ELSE 'sudo: role change of u' || user_id END"
)


def said(spark, d, kind):
    return events(spark, d).select("event_id", F.expr("'e' || (user_id % 5)").alias("entity"), F.lit(kind).alias("entity_type"), F.lit("syslog").alias("source_type"), F.expr("timestamp_ns div 50").alias("timestamp_ns"), F.expr(SAID).alias("message"))


def _rule_sql(rule):
    counts = ", ".join(f"count(*) FILTER (WHERE regexp_matches(message, '{c.patterns['message']}')) OVER w AS c{i}" for i, c in enumerate(rule.conditions))
    met = " + ".join(f"CASE WHEN c{i} >= {c.min_count} THEN 1 ELSE 0 END" for i, c in enumerate(rule.conditions))
    n = " + ".join(f"CASE WHEN c{i} >= {c.min_count} THEN c{i} ELSE 0 END" for i, c in enumerate(rule.conditions))
    start = f"WITH {EV}, sd AS (SELECT event_id, 'e' || (user_id % 5) AS entity, timestamp_ns // 50 AS timestamp_ns, {SAID} AS message FROM ev), "
    window = f"WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns RANGE BETWEEN {rule.window_seconds * 1_000_000_000} PRECEDING AND CURRENT ROW)"
    ids = f"k AS (SELECT *, {n} AS n_events, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('corr:{rule.name}:' || entity || ':' || timestamp_ns)) AS h FROM c WHERE {met} >= {rule.min_sources})"
    return f"{start}c AS (SELECT *, {counts} FROM sd {window}), {ids} SELECT {UUID} AS alert_id, '{rule.name}' AS rule_name, event_id, entity, timestamp_ns, n_events, round({0.6 * rule.severity / 6} + 0.4 * least(n_events / 10, 1), 6) AS risk_score FROM k"


for _rule in correlate.RULES:
    query("k3_" + _rule.name.replace("-", "_"), _rule_sql(_rule))(lambda spark, d, rule=_rule: correlate.correlate(said(spark, d, rule.entity_type), rule))


@query("k5_kill_chain_window", f"WITH {AL}, e AS (SELECT entity_value, alert_id, timestamp_ns, unnest(mitre_tactics) AS tactic FROM al), w AS (SELECT a.alert_id, a.entity_value, a.timestamp_ns, count(DISTINCT b.tactic) AS n FROM al a JOIN e b ON a.entity_value = b.entity_value AND b.timestamp_ns BETWEEN a.timestamp_ns - {3 * DAY} AND a.timestamp_ns GROUP BY 1, 2, 3) SELECT alert_id, entity_value, timestamp_ns, CAST(n AS INT) AS n_tactics FROM w WHERE n >= 3")
def k5_window(spark, d):
    return correlate.kill_chain_window(alerts(spark, d), 3, 3 * DAY)


@query("k5_kill_chain")
def k5(spark, d):
    return correlate.kill_chain(alerts(spark, d), 3, 3 * DAY)


POINTS = "CASE alert_type WHEN 'ml' THEN 10 * risk_score WHEN 'sigma' THEN CASE WHEN severity_id >= 4 THEN 15.0 ELSE 5.0 END ELSE 20 * risk_score END"


@query("k6_risk_entries", f"WITH {AL} SELECT alert_id, entity_value, timestamp_ns, round({POINTS}, 9) AS points FROM al")
def k6(spark, d):
    return rounded(al.risk_entries(alerts(spark, d)), "points", places=9)


@query("k7_event_risk", f"WITH {EV} SELECT event_id, round(greatest(value / 500, (event_id % 101) / 100), 9) AS risk FROM ev")
def k7(spark, d):
    return rounded(events(spark, d).select("event_id", al.event_risk(F.col("value") / 500, F.col("event_id") % 101).alias("risk")), "risk", places=9)


HOSTS = "ob AS (SELECT page_id AS event_id, 'domain' AS kind, regexp_extract(url, '://([^/:]+)', 1) AS value, page_id AS timestamp_ns FROM pages), ind AS (SELECT DISTINCT ON (value) upper(value) AS value, value AS key, 'domain' AS kind, CAST(length(value) * 3 AS INT) AS confidence FROM ob WHERE regexp_matches(value, 'cheap|^www|^[^.]*[.]example'))"


def observables(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("event_id"), F.lit("domain").alias("kind"), F.regexp_extract("url", "://([^/:]+)", 1).alias("value"), F.col("page_id").alias("timestamp_ns"))


def indicators(spark, d):
    ob = observables(spark, d).where("value RLIKE 'cheap|^www|^[^.]*[.]example'").select("value").distinct()
    phases = F.array(F.lit("initial_access"), F.lit("Command-And-Control"))
    return ob.select(F.upper("value").alias("value"), F.lit("domain").alias("kind"), (F.length("value") * 3).cast("int").alias("confidence"), phases.alias("phases"), F.lit(1).alias("feed_order"), F.lit("feed").alias("source_feed"), F.lit(None).cast("long").alias("valid_until_ns"))


@query("j3_ioc_match", f"WITH {HOSTS} SELECT ob.event_id, ob.value, confidence FROM ob JOIN ind ON lower(ob.value) = lower(ind.key)")
def j3(spark, d):
    return rules.match_indicators(observables(spark, d), indicators(spark, d)).select("event_id", "value", "confidence")


@query("j4_indicator_snapshot", "WITH i AS (SELECT s_suppkey AS value, CAST(s_suppkey % 100 AS INT) AS confidence, s_nationkey AS feed, s_suppkey * 1000 AS valid_until_ns FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY confidence DESC, value) AS r FROM i WHERE valid_until_ns >= 20000 - 5000 AND confidence >= 10) SELECT value, confidence, feed FROM r WHERE r <= 3")
def j4(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS value", "CAST(s_suppkey % 100 AS INT) AS confidence", "s_nationkey AS feed", "s_suppkey * 1000 AS valid_until_ns", "'ipv4' AS kind")
    return rules.snapshot(rows, 20_000, 5000, 10, 3, "feed").select("value", "confidence", "feed")


@query("j5_entity_alignment", f"WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'id-a' WHEN 1 THEN 'id-' || entity ELSE '' END AS entity_uuid FROM ev")
def j5(spark, d):
    values, ids = F.array(F.lit("a"), F.col("entity")), F.array(F.lit("id-a"), F.concat(F.lit("id-"), F.col("entity")))
    wanted = F.when(F.col("event_id") % 4 == 0, "a").when(F.col("event_id") % 4 == 1, F.col("entity")).otherwise("missing")
    return events(spark, d).select("event_id", rules.aligned_entity(values, ids, wanted).alias("entity_uuid"))


@query("k8_ioc_alert", f"WITH {HOSTS} SELECT ob.event_id, ob.value, CASE WHEN least(confidence, 100) < 33 THEN 2 WHEN least(confidence, 100) < 67 THEN 3 WHEN least(confidence, 100) < 85 THEN 4 ELSE 5 END AS severity_id, round(least(confidence, 100) / 100, 6) AS risk_score, 'TA0001,TA0011' AS tactics FROM ob JOIN ind ON lower(ob.value) = lower(ind.key)")
def k8(spark, d):
    found = rules.indicator_alerts(rules.match_indicators(observables(spark, d), indicators(spark, d)))
    return rounded(found.select("event_id", "value", "severity_id", "risk_score", F.array_join("tactics", ",").alias("tactics")), "risk_score")


@query("k9_ml_alerts", f"WITH {EV}, t AS (SELECT *, unnest(CASE WHEN event_id % 5 = 0 THEN [{{'kind': 'ip', 'uuid': '', 'value': ''}}] ELSE [{{'kind': 'user', 'uuid': 'x-' || entity, 'value': entity}}, {{'kind': 'host', 'uuid': 'y', 'value': 'h'}}] END) AS e FROM ev WHERE value > 100), x AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('hst:' || template_id || ':' || source_type || ':' || timestamp_ns || ':' || e.uuid)) AS h FROM t) SELECT {UUID} AS alert_id, e.value AS entity_value, e.kind AS entity_type, round(least(value / 200, 1), 9) AS risk_score FROM x")
def k9(spark, d):
    typed = F.when(F.col("event_id") % 5 == 0, F.expr("CAST(array() AS ARRAY<STRUCT<kind:STRING,uuid:STRING,value:STRING>>)")).otherwise(F.expr("array(named_struct('kind', 'user', 'uuid', 'x-' || entity, 'value', entity), named_struct('kind', 'host', 'uuid', 'y', 'value', 'h'))"))
    found = al.ml_alerts(events(spark, d).where("value > 100").withColumns({"typed": typed, "anomaly_score": F.col("value") / 200}))
    return rounded(found.select("alert_id", "entity_value", "entity_type", "risk_score"), "risk_score", places=9)


# Windows ------------------------------------------------------------------


@query("w1_sliding_window", f"WITH {EV} SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 6) AS top FROM ev WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)")
def w1(spark, d):
    counted = windows.within(events(spark, d), ["entity"], 6 * HOUR, {"n": ("sum", F.lit(1)), "top": ("max", F.col("value"))})
    return rounded(counted.select("event_id", "n", "top"), "top")


BK = f"{EV}, b0 AS (SELECT source_type, timestamp_ns // {HOUR} AS bucket, count(*) AS n FROM ev GROUP BY 1, 2), b1 AS (SELECT *, coalesce(lead(bucket) OVER (PARTITION BY source_type ORDER BY bucket) - bucket - 1, 0) AS gap FROM b0), b2 AS (SELECT source_type, bucket, n, unnest(range(0, least(gap, 100) + 1)) AS step FROM b1), bk AS (SELECT source_type, bucket + step AS bucket, CASE WHEN step = 0 THEN n ELSE 0 END AS n, row_number() OVER (PARTITION BY source_type ORDER BY bucket, step) AS seq FROM b2)"


@query("w2_buckets", f"WITH {BK} SELECT source_type, bucket, n, CAST(seq AS INT) AS seq FROM bk")
def w2(spark, d):
    return windows.minute_buckets(events(spark, d), ["source_type"], HOUR, 100)


@query("w3_holt_winters")
def w3(spark, d):
    return detectors.fold_buckets(events(spark, d), ["source_type"], detectors.HoltWinters(season=24), HOUR).drop("seq")


CU = f"WITH RECURSIVE {BK}, r(source_type, seq, bucket, mean, var, up, down, score) AS (SELECT source_type, seq, bucket, n::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM bk WHERE seq = 1 UNION ALL SELECT source_type, seq, bucket, mean, var, CASE WHEN top >= 1 THEN 0 ELSE up END, CASE WHEN top >= 1 THEN 0 ELSE down END, CASE WHEN top >= 1 THEN 0 ELSE top END FROM (SELECT *, CASE WHEN seq <= 5 THEN 0 ELSE least(greatest(up, down) / 5, 1) END AS top FROM (SELECT source_type, seq, bucket, mean, var, CASE WHEN seq <= 5 THEN up0 ELSE greatest(0, up0 + off / greatest(sqrt(var), 1e-10) - 0.5) END AS up, CASE WHEN seq <= 5 THEN down0 ELSE greatest(0, down0 - off / greatest(sqrt(var), 1e-10) - 0.5) END AS down FROM (SELECT bk.source_type, bk.seq, bk.bucket, bk.n - r.mean AS off, 0.1 * bk.n + 0.9 * r.mean AS mean, 0.1 * (bk.n - r.mean) * (bk.n - r.mean) + 0.9 * r.var AS var, r.up AS up0, r.down AS down0 FROM r JOIN bk ON bk.source_type = r.source_type AND bk.seq = r.seq + 1) s1) s2) s3)"


@query("w4_cusum", f"{CU} SELECT source_type, bucket, round(score, 6) AS score FROM r")
def w4(spark, d):
    detector = detectors.Cusum(warm_up=5)
    buckets = windows.minute_buckets(events(spark, d), ["source_type"], HOUR, 100)
    return rounded(detectors.cusum_sql(buckets, ["source_type"], detector).select("source_type", "bucket", "score"), "score")


@query("j13_last_closed_score", f"{CU}, st AS (SELECT source_type, seq, bucket, lag(score) OVER (PARTITION BY source_type ORDER BY seq) AS standing FROM r), cl AS (SELECT st.* FROM st JOIN b0 USING (source_type, bucket)), e AS (SELECT *, max(timestamp_ns // {HOUR}) OVER (PARTITION BY source_type ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_b FROM ev) SELECT e.event_id, round(coalesce(standing, 0), 6) AS score FROM e LEFT JOIN cl ON cl.source_type = e.source_type AND cl.bucket = e.at_b")
def j13(spark, d):
    e = events(spark, d)
    buckets = windows.minute_buckets(e, ["source_type"], HOUR, 100)
    scores = detectors.cusum_sql(buckets, ["source_type"], detectors.Cusum(warm_up=5))
    return rounded(detectors.score_events(e, scores, ["source_type"], HOUR).select("event_id", "score"), "score")


@query("w5_markov", f"WITH {EV}, s AS (SELECT *, lag(template_id) OVER o AS prev, row_number() OVER o - 1 AS learned FROM ev WINDOW o AS (PARTITION BY entity ORDER BY timestamp_ns, event_id)), c AS (SELECT *, count(*) OVER (PARTITION BY entity, prev, template_id ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair, count(*) OVER (PARTITION BY entity, prev ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM s), m AS (SELECT *, coalesce(sum(CASE WHEN prev IS NOT NULL AND total = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM c) SELECT event_id, round(CASE WHEN prev IS NULL OR learned < 10 OR met = 0 THEN 0 WHEN total = 0 THEN CASE WHEN met > 1 THEN 1 ELSE 0 END ELSE greatest(0, least(ln((pair + 1e-6) / (total + 1e-6 * met)) / ln(1e-6 / (total + 1e-6 * met)), 1)) END, 6) AS score FROM m")
def w5(spark, d):
    return rounded(windows.markov_scores(events(spark, d).select("event_id", "timestamp_ns", "entity", "template_id"), ["entity"], 1e-6, 10).select("event_id", "score"), "score")


@query("w6_half_space")
def w6(spark, d):
    unit = events(spark, d).select("event_id", "timestamp_ns", "source_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("f1"), (F.col("template_id") / 6).alias("f2"), (F.col("severity_id") / 6).alias("f3"))
    return rounded(detectors.forest_scores(unit, "source_type", detectors.Forest(("f1", "f2", "f3"), window=250)), "score")


@query("w7_template_volume")
def w7(spark, d):
    return rounded(detectors.template_volume(events(spark, d), detectors.HoltWinters(season=24), HOUR).select("event_id", "score"), "score")


@query("w8_entity_volume")
def w8(spark, d):
    e = events(spark, d).withColumn("entity_refs", F.array("entity", F.expr("'t' || template_id")))
    return rounded(detectors.entity_volume(e, detectors.HoltWinters(season=24), HOUR), "score")


Z = "CASE WHEN count(value) OVER w < 2 THEN value ELSE (value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 1e-10) END"
ZW = "WINDOW w AS (PARTITION BY source_type ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("w9_znorm", f"WITH {EV} SELECT event_id, round({Z}, 5) AS z FROM ev {ZW}")
def w9(spark, d):
    return rounded(windows.running_z(events(spark, d), ["source_type"], "value").select("event_id", "z"), "z", places=5)


@query("w9_znorm_buckets", f"WITH {EV} SELECT event_id, round({Z}, 5) AS z FROM ev {ZW}")
def w9_buckets(spark, d):
    return rounded(windows.running_z_by_bucket(events(spark, d), ["source_type"], "value", DAY).select("event_id", "z"), "z", places=5)


S6 = "value / 500 AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 400 END AS b, value / 300 AS c, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 50 END AS d2, value / 60 AS e2, value / 70 AS f2"


def six(spark, d):
    v = F.col("value")
    cols = [v / 500, F.when(F.col("event_id") % 3 != 0, v / 400), v / 300, F.when(F.col("event_id") % 4 != 0, v / 50), v / 60, v / 70]
    return events(spark, d), cols


@query("w10_blend", f"WITH {EV}, s AS (SELECT event_id, {S6} FROM ev) SELECT event_id, round((0.3 * a + coalesce(0.25 * b, 0) + 0.2 * c + coalesce(0.25 * d2, 0) + 0.15 * e2 + 0.15 * f2) / (0.3 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + 0.2 + CASE WHEN d2 IS NULL THEN 0 ELSE 0.25 END + 0.3), 6) AS score FROM s")
def w10(spark, d):
    e, cols = six(spark, d)
    return rounded(e.select("event_id", windows.blended(cols).alias("score")), "score")


@query("w11_amplify", f"WITH {EV}, s AS (SELECT event_id, value, {S6} FROM ev), k AS (SELECT *, (a > 1)::INT + coalesce((b > 1)::INT, 0) + (c > 1)::INT + coalesce((d2 > 1)::INT, 0) + (e2 > 1)::INT + (f2 > 1)::INT AS k FROM s) SELECT event_id, round(value * CASE WHEN k >= 4 THEN 2.0 WHEN k >= 3 THEN 1.5 ELSE 1.0 END, 6) AS score FROM k")
def w11(spark, d):
    e, cols = six(spark, d)
    return rounded(e.select("event_id", windows.amplified(F.col("value"), cols).alias("score")), "score")


@query("w12_every_nth", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY source_type ORDER BY timestamp_ns, event_id) % 5 = 0 AS scored FROM ev")
def w12(spark, d):
    return windows.every_nth(events(spark, d), ["source_type"], 5).select("event_id", "scored")


TAIL = detectors.TailThreshold(window=200, risk=1e-3)


@query("w13_calibration", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY timestamp_ns, event_id) AS rank FROM ev) SELECT source_type, round(quantile_cont(value, 0.98), 6) AS u, round(quantile_cont(value, 0.02), 6) AS l FROM r WHERE rank <= 200 GROUP BY 1 HAVING count(*) >= 200")
def w13(spark, d):
    return rounded(detectors.calibration(events(spark, d).withColumn("score", F.col("value")), "source_type", TAIL), "u", "l")


@query("w13_evt")
def w13_evt(spark, d):
    return rounded(detectors.tail_anomalies(events(spark, d).withColumn("score", F.col("value")), "source_type", TAIL), "upper", "lower", places=4)


@query("w14_fp_adjustment", f"WITH {AL}, t AS (SELECT source_type, max(value) / 4 AS upper FROM ev GROUP BY 1), f AS (SELECT rule_name AS source_type, count(*) AS k FROM al WHERE risk_score > 0.4 GROUP BY 1) SELECT source_type, upper, round(least(upper * pow(1.05, coalesce(k, 0)), upper * 5), 6) AS adjusted, pow(1.05, coalesce(k, 0)) > 5 AS clamped FROM t LEFT JOIN f USING (source_type)")
def w14(spark, d):
    limits = events(spark, d).groupBy("source_type").agg((F.max("value") / 4).alias("upper"))
    wrong = alerts(spark, d).where("risk_score > 0.4").withColumnRenamed("rule_name", "source_type")
    return rounded(detectors.adjusted_thresholds(limits, wrong), "adjusted")


RISK = f"{AL}, p AS (SELECT alert_id, event_id, entity_value, timestamp_ns, {POINTS} AS points FROM al), rk AS (SELECT a.event_id, a.alert_id, a.entity_value, a.timestamp_ns, sum(b.points * pow(2, -((a.timestamp_ns - b.timestamp_ns) / 86400e9))) AS risk FROM p a JOIN p b ON a.entity_value = b.entity_value AND (b.timestamp_ns < a.timestamp_ns OR (b.timestamp_ns = a.timestamp_ns AND b.event_id <= a.event_id)) GROUP BY 1, 2, 3, 4)"


def risk_rows(spark, d):
    found = alerts(spark, d)
    points = al.risk_entries(found).join(found.select("alert_id", "event_id"), "alert_id")
    return windows.decayed_risk(points, "entity_value", "points", DAY)


@query("w15_risk", f"WITH {RISK} SELECT alert_id, round(risk, 6) AS risk FROM rk")
def w15(spark, d):
    return rounded(risk_rows(spark, d).select("alert_id", "risk"), "risk")


@query("w16_crossing", f"WITH {RISK}, x AS (SELECT *, row_number() OVER (PARTITION BY entity_value ORDER BY timestamp_ns, event_id) AS r FROM rk WHERE risk >= 15.5) SELECT entity_value, alert_id, round(risk, 6) AS risk FROM x WHERE r = 1")
def w16(spark, d):
    return rounded(windows.first_crossing(risk_rows(spark, d), "entity_value", 15.5).select("entity_value", "alert_id", "risk"), "risk")


@query("w17_dedup", f"WITH RECURSIVE {AL}, n AS (SELECT dedup_key, alert_id, timestamp_ns AS t, row_number() OVER (PARTITION BY dedup_key ORDER BY timestamp_ns, alert_id) AS i FROM al), r(dedup_key, alert_id, i, anchor_ns, dedup_count) AS (SELECT dedup_key, alert_id, i, t, 1::BIGINT FROM n WHERE i = 1 UNION ALL SELECT n.dedup_key, n.alert_id, n.i, CASE WHEN abs(n.t - r.anchor_ns) <= {DAY} THEN r.anchor_ns ELSE n.t END, CASE WHEN abs(n.t - r.anchor_ns) <= {DAY} THEN r.dedup_count + 1 ELSE 1 END FROM r JOIN n ON n.dedup_key = r.dedup_key AND n.i = r.i + 1) SELECT dedup_key, alert_id, anchor_ns, dedup_count FROM r")
def w17(spark, d):
    return al.anchored(alerts(spark, d), ["dedup_key"], DAY)


@query("w18_late", f"WITH {EV}, a AS (SELECT event_id, timestamp_ns, source_type, (event_id * 7919) % 10007 AS arrival FROM ev) SELECT event_id, timestamp_ns < max(timestamp_ns) OVER (PARTITION BY source_type ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - 30000000000 AS late FROM a")
def w18(spark, d):
    rows = events(spark, d).withColumn("arrival", F.col("event_id") * 7919 % 10_007)
    return windows.late_flags(rows, ["source_type"], "arrival", stretch=500).select("event_id", "late")


SN = f"{EV}, sn AS (SELECT source_type AS vertex, timestamp_ns // {DAY} AS snapshot, count(DISTINCT entity) AS fan_out FROM ev GROUP BY 1, 2), bl AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN greatest(avg(fan_out) OVER w + 3 * stddev_samp(fan_out) OVER w, 5) END AS threshold FROM sn WINDOW w AS (PARTITION BY vertex ORDER BY snapshot ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


def fan_rows(spark, d):
    snapshots = events(spark, d).groupBy(F.col("source_type").alias("vertex"), F.expr(f"timestamp_ns div {DAY}").alias("snapshot")).agg(F.countDistinct("entity").alias("fan_out"))
    return windows.fan_out_baseline(snapshots)


@query("w19_fan_out_baseline", f"WITH {SN} SELECT vertex, snapshot, fan_out, round(threshold, 6) AS threshold, coalesce(fan_out > threshold, FALSE) AS anomaly FROM bl")
def w19(spark, d):
    return rounded(fan_rows(spark, d), "threshold")


@query("h13_fan_out_alerts", f"WITH {SN} SELECT vertex, snapshot, round(least(1, fan_out / (threshold * 0.6)), 6) AS risk_score FROM bl WHERE fan_out > threshold * 0.6")
def h13(spark, d):
    low = fan_rows(spark, d).withColumn("threshold", F.col("threshold") * 0.6).withColumn("anomaly", F.coalesce(F.col("fan_out") > F.col("threshold"), F.lit(False)))
    return rounded(graph.fan_out_alerts(low).select("vertex", "snapshot", "risk_score"), "risk_score")


# Behaviour ----------------------------------------------------------------


def with_ips(spark, d):
    return events(spark, d).withColumn("related_ips", F.array(F.expr("'10.0.' || (event_id % 3) || '.' || (user_id % 4)"), F.expr("'10.1.0.' || (event_id % 7)")))


@query("u1_baselines", f"WITH {EV}, h AS (SELECT entity, CAST(timestamp_ns // {HOUR} % 24 AS INT) AS hour, count(*) AS n, min(timestamp_ns) AS low, max(timestamp_ns) AS high FROM ev GROUP BY 1, 2) SELECT entity, min(low) AS first_seen_ns, max(high) AS last_seen_ns, CAST(sum(n) AS BIGINT) AS event_count, arg_max(hour, n * 100 - hour) AS peak_hour, 1.0 AS volume_ema_min, 1.0 AS volume_ema_hour, sum(n) >= 50 AND max(high) - min(low) >= {7 * DAY} AS warm FROM h GROUP BY 1")
def u1(spark, d):
    return ueba.baselines(events(spark, d)).drop("hours")


@query("u1_known_ips", f"WITH {EV}, i AS (SELECT entity, unnest(['10.0.' || (event_id % 3) || '.' || (user_id % 4), '10.1.0.' || (event_id % 7)]) AS ip, timestamp_ns FROM ev), g AS (SELECT entity, ip, max(timestamp_ns) AS last_ns FROM i GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY last_ns DESC, ip) AS INT) AS rank FROM g) SELECT * FROM r WHERE rank <= 5")
def u1_ips(spark, d):
    return ueba.known_ips(with_ips(spark, d), most=5)


@query("u2_time_of_day", f"WITH {EV}, h AS (SELECT *, timestamp_ns // {HOUR} % 24 AS hour FROM ev), c AS (SELECT *, count(*) OVER (PARTITION BY entity, hour ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM h) SELECT event_id, round(coalesce(1 - own / max(own + 1) OVER (PARTITION BY entity ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS time_of_day FROM c")
def u2(spark, d):
    return rounded(ueba.time_of_day(events(spark, d)).select("event_id", "time_of_day"), "time_of_day")


@query("u3_novelty", f"WITH {EV}, i AS (SELECT event_id, entity, timestamp_ns, unnest(['10.0.' || (event_id % 3) || '.' || (user_id % 4), '10.1.0.' || (event_id % 7)]) AS ip FROM ev), f AS (SELECT *, row_number() OVER (PARTITION BY entity, ip ORDER BY timestamp_ns, event_id) = 1 AS new FROM i) SELECT event_id, avg(CASE WHEN new THEN 1.0 ELSE 0.0 END) AS source_novelty FROM f GROUP BY 1")
def u3(spark, d):
    return ueba.source_novelty(with_ips(spark, d)).select("event_id", "source_novelty")


@query("u4_volume", f"WITH {EV} SELECT event_id, round(CASE WHEN value - 5 <= 0 THEN 0 ELSE least(1, greatest(0, (1 - greatest((value - 5) / 50, 1e-6)) / sqrt(greatest((value - 5) / 50, 1e-6)) / 3)) END, 6) AS volume FROM ev")
def u4(spark, d):
    return rounded(events(spark, d).select("event_id", ueba.volume_score((F.col("value") - 5) / 50).alias("volume")), "volume")


@query("u5_pattern_seen", f"WITH {EV} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY entity, template_id ORDER BY timestamp_ns, event_id) = 1 THEN 1.0 ELSE 0.0 END AS pattern_novelty FROM ev")
def u5(spark, d):
    return ueba.pattern_novelty(events(spark, d)).select("event_id", "pattern_novelty")


@query("u5_pattern_exact")
def u5_exact(spark, d):
    return rounded(ueba.pattern_novelty_exact(events(spark, d)).select("event_id", "pattern_novelty"), "pattern_novelty")


U6 = (
    f"{EV}, h AS (SELECT *, timestamp_ns // {HOUR} % 24 AS hour FROM ev), c AS (SELECT *, count(*) OVER (PARTITION BY entity, hour ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own, row_number() OVER (PARTITION BY entity, template_id ORDER BY timestamp_ns, event_id) = 1 AS fresh FROM h), "
    f"b AS (SELECT *, coalesce(1 - own / max(own + 1) OVER w, 0) AS tod, count(*) OVER w AS n, max(timestamp_ns) OVER w - min(timestamp_ns) OVER w AS span FROM c WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "i AS (SELECT event_id, entity, timestamp_ns, unnest(['10.0.' || (event_id % 3) || '.' || (user_id % 4), '10.1.0.' || (event_id % 7)]) AS ip FROM ev), f AS (SELECT event_id, avg(CASE WHEN new THEN 1.0 ELSE 0.0 END) AS nov FROM (SELECT *, row_number() OVER (PARTITION BY entity, ip ORDER BY timestamp_ns, event_id) = 1 AS new FROM i) GROUP BY 1), "
    f"s AS (SELECT event_id, CASE WHEN n >= 20 AND span >= {7 * DAY} THEN 0.25::DOUBLE * tod + 0.3::DOUBLE * nov + 0.25::DOUBLE * CASE WHEN fresh THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS x FROM b JOIN f USING (event_id))"
)


@query("u6_composite", f"WITH {U6} SELECT event_id, round(x, 6) AS composite, CAST(least(6, 1 + floor(6 * x)) AS INT) AS severity, x >= 0.3::DOUBLE AS alert FROM s")
def u6(spark, d):
    return rounded(ueba.composite(with_ips(spark, d), limit=0.3, warm_events=20).select("event_id", "composite", "severity", "alert"), "composite")


@query("u7_lookup", f"WITH {EV}, b AS (SELECT entity, count(*) AS n, max(timestamp_ns) - min(timestamp_ns) AS span FROM ev GROUP BY 1), q AS (SELECT 'u' || c_custkey AS entity FROM customer) SELECT q.entity, CASE WHEN n IS NULL THEN 'unknown' WHEN n >= 50 AND span >= {7 * DAY} THEN 'warm' ELSE 'warming' END AS state, coalesce(n, 0) AS event_count FROM q LEFT JOIN b USING (entity)")
def u7(spark, d):
    wanted = table(spark, d, "customer").select(F.expr("'u' || c_custkey").alias("entity"))
    return ueba.lookup(ueba.baselines(events(spark, d)), wanted)


@query("j12_as_of_baseline", f"WITH {EV} SELECT event_id, count(*) OVER w AS seen, round(avg(value) OVER w, 9) AS usual FROM ev WINDOW w AS (PARTITION BY entity ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def j12(spark, d):
    w = windows.before("entity")
    return rounded(events(spark, d).select("event_id", F.count("*").over(w).alias("seen"), F.avg("value").over(w).alias("usual")), "usual", places=9)


# Rules and routing --------------------------------------------------------

SIGMA = (
    rules.Rule("r1", "Failed passwords", "high", {"selection": [("CommandLine", ("contains",), ("failed password",))], "filter": [("CommandLine", ("contains",), ("u1@",))]}, lambda s: s["selection"] & ~s["filter"], ("attack.credential-access", "attack.t1110.001"), "error"),
    rules.Rule("r2", "Payments", "low", {"selection_a": [("CommandLine", ("contains", "all"), ("accepted", "process=pay"))], "selection_b": [("EventID", (), (3, 4))]}, lambda s: rules.all_of(s, "selection_"), ("attack.exfiltration", "attack.s0029"), "purchase"),
    rules.Rule("r3", "Keywords", "critical", {"keywords": [(None, (), ("SUDO:", "incorrect"))]}, lambda s: s["keywords"]),
    rules.Rule("r4", "Wild", "medium", {"selection": [("Image", (), ("*get /api/*/item/1?.json*",))]}, lambda s: s["selection"], (), "click"),
    rules.Rule("r5", "Network", "medium", {"selection": [("SourceIp", ("cidr",), ("10.0.0.0/14",))]}, lambda s: s["selection"]),
    rules.Rule("r6", "Off", "low", {"keywords": [(None, (), ("a",))]}, lambda s: s["keywords"], enabled=False),
)
R1 = f"{LN}, rm AS (SELECT event_id, timestamp_ns, 'r1' AS rule_id FROM ln WHERE source_type = 'error' AND contains(lower(message), 'failed password') AND NOT contains(lower(message), 'u1@') UNION ALL SELECT event_id, timestamp_ns, 'r2' FROM ln WHERE source_type = 'purchase' AND contains(lower(message), 'accepted') AND contains(lower(message), 'process=pay') AND template_id IN (3, 4) UNION ALL SELECT event_id, timestamp_ns, 'r3' FROM ln WHERE contains(lower(message), 'sudo:') OR contains(lower(message), 'incorrect') UNION ALL SELECT event_id, timestamp_ns, 'r4' FROM ln WHERE source_type = 'click' AND regexp_matches(lower(message), 'get /api/.*/item/1.\\.json') UNION ALL SELECT event_id, timestamp_ns, 'r5' FROM ln WHERE user_id % 256 <= 3 AND source_type = 'error')"


def sigma_matches(spark, d):
    ip = F.when(F.col("source_type") == "error", F.array(F.expr("'10.' || (user_id % 256) || '.1.7'"))).otherwise(F.array().cast("array<string>"))
    rows = lines(spark, d).withColumns({"category": F.col("source_type"), "product": F.lit(""), "service": F.lit(""), "related_ips": ip})
    return rules.rule_matches(rows, SIGMA)


@query("r1_sigma", f"WITH {R1} SELECT event_id, rule_id FROM rm")
def r1(spark, d):
    return sigma_matches(spark, d).select("event_id", "rule_id")


# The rules as rows, their conditions in words
PACK = [
    {"rule_id": "r1", "title": "Failed passwords", "level": "high", "category": "error", "condition": "selection and not 1 of filter*", "selections": {"selection": [{"field": "CommandLine", "modifiers": ["contains"], "values": ["failed password"]}], "filter": [{"field": "CommandLine", "modifiers": ["contains"], "values": ["u1@"]}]}},
    {"rule_id": "r2", "title": "Payments", "level": "low", "category": "purchase", "condition": "all of selection_*", "selections": {"selection_a": [{"field": "CommandLine", "modifiers": ["contains", "all"], "values": ["accepted", "process=pay"]}], "selection_b": [{"field": "EventID", "modifiers": [], "values": [3, 4]}]}},
    {"rule_id": "r3", "title": "Keywords", "level": "critical", "condition": "1 of them", "selections": {"keywords": [{"values": ["SUDO:", "incorrect"]}]}},
    {"rule_id": "r3", "title": "Repeated id", "level": "low", "condition": "keywords", "selections": {"keywords": [{"values": ["a"]}]}},
]


@query("x2_rule_pack", f"WITH {R1} SELECT event_id, rule_id FROM rm WHERE rule_id IN ('r1', 'r2', 'r3')")
def x2(spark, d):
    rows = lines(spark, d).withColumns({"category": F.col("source_type"), "product": F.lit(""), "service": F.lit("")})
    return rules.rule_matches(rows, rules.rule_pack(PACK)).select("event_id", "rule_id")


@query("x4_infer_edges", f"WITH {EV} SELECT event_id, 'U' || entity AS source_id, 'I' || (user_id % 9) AS target_id, 'authenticated_from' AS rel_type FROM ev UNION ALL SELECT event_id, 'U' || entity, 'H' || (event_id % 5), 'logged_into' FROM ev UNION ALL SELECT event_id, 'I' || (user_id % 9), 'H' || (event_id % 5), 'has_ip' FROM ev UNION ALL SELECT event_id, 'P' || (event_id % 7), 'P' || (event_id % 11 + 100), 'spawned_by' FROM ev")
def x4_edges(spark, d):
    identity.register(spark)
    entity = lambda kind, t: f"named_struct('kind', '{kind}', 'uuid', {t})"
    typed = "array(" + ", ".join(entity(k, t) for k, t in (("ip", "'I' || (user_id % 9)"), ("user", "'U' || entity"), ("host", "'H' || (event_id % 5)"), ("process", "'P' || (event_id % 7)"), ("process", "'P' || (event_id % 11 + 100)"))) + ")"
    events(spark, d).selectExpr("event_id", f"{typed} AS typed").createOrReplaceTempView("logsight_x4_events")
    return spark.sql("SELECT event_id, source_id, target_id, rel_type FROM logsight_x4_events, LATERAL infer_edges(typed)")


@query("r4_sigma_alerts", f"WITH {R1} SELECT event_id, rule_id, CASE rule_id WHEN 'r1' THEN 4 WHEN 'r2' THEN 2 WHEN 'r3' THEN 5 ELSE 3 END AS severity_id, CASE rule_id WHEN 'r1' THEN 'credential_access' WHEN 'r2' THEN 'exfiltration' ELSE '' END AS tactics, CASE rule_id WHEN 'r1' THEN 'T1110.001' ELSE '' END AS techniques FROM rm")
def r4(spark, d):
    found = rules.rule_alerts(sigma_matches(spark, d), [r for r in SIGMA if r.enabled])
    return found.select("event_id", "rule_id", "severity_id", F.array_join("tactics", ",").alias("tactics"), F.array_join("techniques", ",").alias("techniques"))


@query("r5_disabled_rules", f"WITH {R1} SELECT rule_id, count(*) AS n FROM rm WHERE rule_id NOT IN ('r3', 'r4') GROUP BY 1")
def r5(spark, d):
    rows = lines(spark, d).withColumns({"category": F.col("source_type"), "product": F.lit(""), "service": F.lit(""), "related_ips": F.when(F.col("source_type") == "error", F.array(F.expr("'10.' || (user_id % 256) || '.1.7'"))).otherwise(F.array().cast("array<string>"))})
    return rules.rule_matches(rows, SIGMA, disabled=["r3", "r4"]).groupBy("rule_id").agg(F.count("*").alias("n"))


ROUTES = (al.Route((("pager", "immediate"), ("mail", "digest")), alert_types=("ml",), min_severity=4), al.Route((("mail", "digest"),), rule_glob="c*k"), al.Route((("chat", "immediate"),), entity_types=("user",), max_severity=1))
R6 = f"{AL}, rt AS (SELECT *, CASE WHEN alert_type = 'ml' AND severity_id >= 4 THEN 0 WHEN rule_name LIKE 'c%k' THEN 1 WHEN entity_type = 'user' AND severity_id <= 1 THEN 2 ELSE -1 END AS rule_order FROM al), ro AS (SELECT *, unnest(CASE rule_order WHEN 0 THEN ['pager', 'mail'] WHEN 1 THEN ['mail'] WHEN 2 THEN ['chat'] ELSE ['log'] END) AS channel FROM rt), rf AS (SELECT alert_id, timestamp_ns, CAST(rule_order AS INT) AS rule_order, channel, CASE WHEN channel = 'mail' THEN 'digest' ELSE 'immediate' END AS mode FROM ro WHERE (channel <> 'log' OR severity_id >= 2) AND NOT (channel = 'chat' AND severity_id < 3 AND (timestamp_ns // 60000000000 % 1440 >= 1320 OR timestamp_ns // 60000000000 % 1440 < 360)))"


def routed_alerts(spark, d):
    return al.routed(alerts(spark, d), ROUTES, (("log", "immediate"),), {"log": 2}, {"chat": (1320, 360, 3)})


@query("r6_routing", f"WITH {R6} SELECT alert_id, rule_order, channel, mode FROM rf")
def r6(spark, d):
    return routed_alerts(spark, d).select("alert_id", "rule_order", "channel", "mode")


@query("r7_digests", f"WITH RECURSIVE {R6}, n AS (SELECT rule_order, channel, alert_id, timestamp_ns AS t, row_number() OVER (PARTITION BY rule_order, channel ORDER BY timestamp_ns, alert_id) AS i FROM rf WHERE mode = 'digest'), r(rule_order, channel, alert_id, i, anchor_ns) AS (SELECT rule_order, channel, alert_id, i, t FROM n WHERE i = 1 UNION ALL SELECT n.rule_order, n.channel, n.alert_id, n.i, CASE WHEN n.t - r.anchor_ns <= {HOUR} THEN r.anchor_ns ELSE n.t END FROM r JOIN n ON n.rule_order = r.rule_order AND n.channel = r.channel AND n.i = r.i + 1) SELECT rule_order, channel, anchor_ns, count(*) AS n, min(alert_id) AS first_id FROM r GROUP BY 1, 2, 3")
def r7(spark, d):
    return al.digests(routed_alerts(spark, d), HOUR)


@query("r8_indicators", "SELECT 'indicator--' || s_suppkey AS id, '10.1.2.' || (s_suppkey % 256) AS value, 'ipv4' AS kind, CAST(s_suppkey % 100 AS INT) AS confidence FROM supplier UNION ALL SELECT 'indicator--' || s_suppkey, 'bad' || s_suppkey || '.example', 'domain', CAST(s_suppkey % 100 AS INT) FROM supplier WHERE s_suppkey % 2 = 0")
def r8(spark, d):
    pattern = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat('[ipv4-addr:value = ''10.1.2.', s_suppkey % 256, ''' AND domain-name:value = ''bad', s_suppkey, '.example'']') ELSE concat('[ipv4-addr:value = ''10.1.2.', s_suppkey % 256, ''']') END")
    document = F.to_json(F.struct(F.lit("indicator").alias("type"), F.expr("'indicator--' || s_suppkey").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("valid_from"), (F.col("s_suppkey") % 100).cast("int").alias("confidence"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type")))
    return rules.parse_indicators(table(spark, d, "supplier").select(document.alias("value"))).select("id", "value", "kind", "confidence")


OTEL = "[{'n': 1, 't': 'TRACE'}, {'n': 9, 't': 'INFO'}, {'n': 10, 't': 'INFO2'}, {'n': 13, 't': 'WARN'}, {'n': 17, 't': 'ERROR'}, {'n': 21, 't': 'FATAL'}, {'n': 24, 't': 'FATAL4'}][severity_id + 1]"


@query("a16_otel_records", f"WITH {AL} SELECT timestamp_ns AS time_unix_nano, {OTEL}.n AS severity_number, {OTEL}.t AS severity_text, description AS body FROM al")
def a16(spark, d):
    return al.otel_records(alerts(spark, d)).drop("attributes")


@query("a17_incidents", f"WITH {AL} SELECT alert_id, CASE WHEN event_id % 3 = 0 THEN 'resolve' ELSE 'trigger' END AS event_action, alert_type || ':' || rule_name || ':' || entity_value AS dedup_key, description || ' [' || rule_name || ']' AS summary, CASE WHEN severity_id >= 5 THEN 'critical' WHEN severity_id >= 4 THEN 'error' WHEN severity_id >= 2 THEN 'warning' ELSE 'info' END AS severity FROM al")
def a17(spark, d):
    return al.incidents(alerts(spark, d), F.when(F.col("event_id") % 3 == 0, "fp").otherwise("tp"))


# Graph --------------------------------------------------------------------


@query("h1_infer_edges", f"WITH {EV} SELECT 'U' || entity AS source_id, 'I' || (user_id % 9) AS target_id, 'authenticated_from' AS rel_type, event_id AS timestamp_ns FROM ev UNION ALL SELECT 'U' || entity, 'H' || (event_id % 5), 'logged_into', event_id FROM ev UNION ALL SELECT 'I' || (user_id % 9), 'H' || (event_id % 5), 'has_ip', event_id FROM ev UNION ALL SELECT 'P' || (event_id % 7), 'P' || (event_id % 11 + 100), 'spawned_by', event_id FROM ev")
def h1(spark, d):
    entity = lambda kind, text: f"named_struct('kind', '{kind}', 'uuid', {text})"
    typed = F.expr("array(" + ", ".join(entity(k, t) for k, t in (("ip", "'I' || (user_id % 9)"), ("user", "'U' || entity"), ("host", "'H' || (event_id % 5)"), ("process", "'P' || (event_id % 7)"), ("process", "'P' || (event_id % 11 + 100)"))) + ")")
    return graph.infer_edges(events(spark, d).withColumns({"timestamp_ns": F.col("event_id"), "typed": typed}))


@query("h2_neighbors", f"WITH {GRE}, d1 AS (SELECT DISTINCT v AS node FROM un WHERE u = 'u7' AND v <> 'u7'), d2 AS (SELECT DISTINCT v AS node FROM un WHERE u IN (SELECT node FROM d1) AND v <> 'u7' AND v NOT IN (SELECT node FROM d1)) SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2")
def h2(spark, d):
    return graph.neighbours(graph_edges(spark, d), "u7", 2)


@query("h3_shortest_path")
def h3(spark, d):
    e = graph_edges(spark, d)
    end = graph.neighbours(e, "u7", 3).agg(F.max("node")).first()[0]
    path = graph.shortest_path(e, "u7", end)
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "step int, node string")


@query("h4_ego", f"WITH {GRE}, d1 AS (SELECT DISTINCT v AS node FROM un WHERE u = 'u7' UNION SELECT 'u7') SELECT source_id, target_id FROM ge WHERE source_id IN (SELECT node FROM d1) AND target_id IN (SELECT node FROM d1)")
def h4(spark, d):
    return graph.ego(graph_edges(spark, d), "u7", 1)


def _ranks(rounds: int) -> str:
    sql = f"WITH {GRE}, cn AS (SELECT count(*) AS n FROM vx), ot AS (SELECT source_id AS node, count(*) AS o FROM ge GROUP BY 1), r0 AS (SELECT node, 1.0 / n AS rank FROM vx, cn)"
    for i in range(1, rounds + 1):
        sql += f", r{i} AS (SELECT vx.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT node FROM ot)) / n) AS rank FROM vx CROSS JOIN cn LEFT JOIN (SELECT target_id AS node, sum(rank / o) AS got FROM ge JOIN r{i - 1} ON r{i - 1}.node = source_id JOIN ot ON ot.node = source_id GROUP BY 1) g ON g.node = vx.node)"
    return sql + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("h5_pagerank", _ranks(6))
def h5(spark, d):
    return rounded(graph.pagerank(graph_edges(spark, d), 6, settle=3), "rank", places=9)


@query("h6_communities")
def h6(spark, d):
    return graph.communities(graph_edges(spark, d), 4)


@query("h6_modularity")
def h6_modularity(spark, d):
    weighed = graph_rows(spark, d).groupBy("source_id", "target_id").agg(F.count("*").alias("weight"))
    return graph.communities_by_modularity(weighed)


@query("h7_fan_out", f"WITH {GRE} SELECT node, count(target_id) AS fan_out FROM vx LEFT JOIN ge ON source_id = node GROUP BY 1")
def h7(spark, d):
    return graph.fan_out(graph_edges(spark, d))


@query("h8_fan_in", f"WITH {GRE} SELECT node, count(source_id) AS fan_in FROM vx LEFT JOIN ge ON target_id = node GROUP BY 1")
def h8(spark, d):
    return graph.fan_in(graph_edges(spark, d))


@query("h9_betweenness")
def h9(spark, d):
    return rounded(graph.betweenness(graph_edges(spark, d)), "betweenness")


@query("h10_ego_size", f"WITH {GRE} SELECT u AS node, count(*) AS neighbours FROM un WHERE u <> v GROUP BY 1")
def h10(spark, d):
    return graph.ego_size(graph_edges(spark, d))


@query("h11_crossings", f"WITH {GR}, ge AS (SELECT DISTINCT source_id, target_id FROM gr) SELECT source_id, target_id, 0.6 AS risk_score FROM ge WHERE substr(source_id, 2, 1) <> substr(target_id, 2, 1)")
def h11(spark, d):
    e = graph_edges(spark, d)
    labels = graph.vertices(e).withColumn("community", F.substring("node", 2, 1))
    return graph.crossings(e, labels).select("source_id", "target_id", "risk_score")


@query("h12_central")
def h12(spark, d):
    return rounded(graph.central(graph.betweenness(graph_edges(spark, d)), 0.01), "betweenness", "risk_score")


@query("h14_reconcile", f"WITH {GRE} SELECT (SELECT count(*) FROM ge) AS source_edges, (SELECT count(*) FROM vx) AS source_vertices, (SELECT count(*) FROM ge WHERE source_id <> 'u7') AS copy_edges, (SELECT count(DISTINCT n) FROM (SELECT source_id AS n FROM ge WHERE source_id <> 'u7' UNION SELECT target_id FROM ge WHERE source_id <> 'u7')) AS copy_vertices, FALSE AS equal")
def h14(spark, d):
    e = graph_edges(spark, d)
    return graph.reconciled(e, e.where("source_id <> 'u7'"))




@query("a18_analyse")
def a18(spark, d):
    rows = lines(spark, d).select("event_id", "timestamp_ns", "source_type", "message")
    bad = table(spark, d, "supplier").select(F.expr("'192.168.' || (s_suppkey % 300) || '.9'").alias("value"), F.lit("ipv4").alias("kind"), (F.col("s_suppkey") % 100).cast("int").alias("confidence"), F.array(F.lit("discovery")).alias("phases"), F.lit(1).alias("feed_order"))
    found = batch.analyse(rows, SIGMA, DAY, indicators=bad, sequence_warm_up=10, tail=TAIL, forest=detectors.Forest(batch.CONTENT, window=250), chain_ns=3 * DAY)
    return rounded(found, "risk_score")


@query("a19_detectors_only")
def a19(spark, d):
    rows = batch.content(batch.normalised(lines(spark, d).select("event_id", "timestamp_ns", "source_type", "message")))
    # the lines are parsed once, and the scores read what they need of the result
    rows = settled(rows.select("event_id", "timestamp_ns", "source_type", "severity_id", "entity", "template_id", "entity_refs", *batch.CONTENT), "events")
    return rounded(batch.anomalies(rows, HOUR, 30, 24, 10).select("event_id", "volume", "change", "sequence", "anomaly_score"), "volume", "change", "sequence", "anomaly_score", places=4)


@query("n1_normalise")
def n1(spark, d):
    rows = batch.normalised(lines(spark, d).select("event_id", "timestamp_ns", "source_type", "message"))
    return rows.select("event_id", "severity_id", "template", "entity_type", "entity", F.size("entity_refs").alias("n_refs"), F.coalesce(F.array_join("mapped.tactics", ","), F.lit("")).alias("tactics"))
