"""Queries on filters, joins, aggregates and evaluation (Q*, J*, G*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsight.functions import attack
from logsight.functions.text import SEVERITY_NAMES
from logsight.operators import aggregates, evaluate, search_index
from logsight.operators import query as q
from logsight.operators.lineage import shared_path
from logsight.plans.base import AL, DAY, EV, FIRST, GR, HOUR, LAST, LN, SECOND, alerts, events, graph_rows, lines, query, rounded, table
from logsight.sources import sinks

MID = FIRST + 10 * DAY
FB = f"{AL}, fb AS (SELECT event_id AS id, alert_id, CASE WHEN event_id % 3 = 0 THEN 'fp' ELSE 'tp' END AS feedback, timestamp_ns + 1000 AS submitted_at_ns FROM al UNION ALL SELECT event_id + 1000000, alert_id, CASE WHEN event_id % 5 = 0 THEN 'fp' ELSE 'tp' END, timestamp_ns + 2000 FROM al WHERE event_id % 2 = 0), lv AS (SELECT alert_id, arg_max(feedback, submitted_at_ns) AS feedback FROM fb GROUP BY alert_id)"


def feedback(spark, d):
    a = alerts(spark, d)
    one = a.select(F.col("event_id").alias("id"), "alert_id", F.when(F.col("event_id") % 3 == 0, "fp").otherwise("tp").alias("feedback"), (F.col("timestamp_ns") + 1000).alias("submitted_at_ns"))
    two = a.where("event_id % 2 = 0").select(F.col("event_id") + 1_000_000, "alert_id", F.when(F.col("event_id") % 5 == 0, "fp").otherwise("tp"), F.col("timestamp_ns") + 2000)
    return one.union(two)


@query("q1_event_query", f"WITH {EV} SELECT event_id, timestamp_ns, source_type, severity_id FROM ev WHERE timestamp_ns BETWEEN {FIRST} AND {MID} AND source_type = 'error' AND severity_id >= 3 ORDER BY timestamp_ns DESC, event_id DESC LIMIT 100")
def q1(spark, d):
    found = events(spark, d).where(q.event_filter(FIRST, MID, "error", 3))
    return q.newest(found, 1, 100).select("event_id", "timestamp_ns", "source_type", "severity_id")


@query("q2_alert_query", f"WITH {AL} SELECT alert_id, timestamp_ns, rule_name FROM al WHERE timestamp_ns BETWEEN {FIRST} AND {MID} AND alert_type = 'ml' AND list_contains(mitre_tactics, 'execution')")
def q2(spark, d):
    return alerts(spark, d).where(q.alert_filter(FIRST, MID, "ml", tactic="execution")).select("alert_id", "timestamp_ns", "rule_name")


TOKENS = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"


@query("q3_text_search", f"SELECT doc_id, n_chars FROM documents WHERE contains({TOKENS}, ' of the ')")
def q3(spark, d):
    return table(spark, d, "documents").where(q.phrase_match(F.col("text"), "of The")).select("doc_id", "n_chars")


def _stem_sql(words: str) -> str:
    """DuckDB text: CTEs that give the table st(word, stem) of the table `words`, by the rules of the search index."""
    x = search_index
    less = lambda n: f"left(w, length(w) - {n})"
    has = lambda e, p: f"regexp_matches({e}, '{p}')"

    def endings(table: dict[str, str], measure: str) -> str:
        cases = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {has(less(len(e)), measure)} THEN {less(len(e))} || '{table[e]}' ELSE w END" for e in sorted(table, key=len, reverse=True))
        return f"CASE {cases} ELSE w END"

    cut = f"CASE WHEN ends_with(w, 'ed') THEN {less(2)} WHEN ends_with(w, 'ing') THEN {less(3)} ELSE '' END"
    body = "rtrim(w, '#')"
    steps = [
        f"CASE WHEN {has('w', '(ss|i)es$')} THEN {less(2)} WHEN {has('w', '[^s]s$')} THEN {less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(less(3), x.SOME)} THEN {less(1)} ELSE w END WHEN {has(cut, x.VOWEL)} THEN {cut} || '#' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '#') THEN w WHEN {has(body, '(at|bl|iz)$')} THEN {body} || 'e' WHEN {has(body, x.DOUBLE)} THEN left({body}, length({body}) - 1) WHEN {has(body, x.SHORT)} THEN {body} || 'e' ELSE {body} END",
        f"CASE WHEN ends_with(w, 'y') AND {has(less(1), x.VOWEL)} THEN {less(1)} || 'i' ELSE w END",
        endings(x.SECOND, x.SOME), endings(x.THIRD, x.SOME), f"CASE WHEN {has('w', '[st]ion$')} THEN CASE WHEN {has(less(3), x.MORE)} THEN {less(3)} ELSE w END ELSE {endings(dict.fromkeys(x.FOURTH, ''), x.MORE)} END",
        f"CASE WHEN ends_with(w, 'e') AND ({has(less(1), x.MORE)} OR ({has(less(1), x.ONE)} AND NOT {has(less(1), x.SHORT)})) THEN {less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has(less(1), x.MORE)} THEN {less(1)} ELSE w END",
    ]
    chain = [f"s0 AS (SELECT word, CASE WHEN word[1] = 'y' THEN 'Y' || word[2:] ELSE word END AS w FROM {words})"]
    chain += [f"s{i + 1} AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN {step} ELSE w END AS w FROM s{i})" for i, step in enumerate(steps)]
    return ", ".join([*chain, f"st AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN lower(w) ELSE word END AS stem FROM s{len(steps)})"])


_PLACED = f"pl AS (SELECT event_id, timestamp_ns, unnest(list_zip(range(1, 1 + len(t)), t)) AS p FROM (SELECT event_id, timestamp_ns, regexp_extract_all(lower(message), '[\\pL\\pN]+') AS t FROM ln)), pw AS (SELECT event_id, timestamp_ns, p[1] AS place, p[2] AS word FROM pl)"
_ASKED = lambda phrase: f"ask AS (SELECT unnest(range(0, {len(phrase.split())})) AS i, unnest({phrase.split()}) AS word)"
_BEGUN = "SELECT DISTINCT event_id, timestamp_ns FROM (SELECT event_id, timestamp_ns, place - i AS b FROM pw JOIN st USING (word) JOIN ask_st USING (stem) GROUP BY event_id, timestamp_ns, b HAVING count(DISTINCT i) = (SELECT count(*) FROM ask_st))"
_ALL = "SELECT event_id, timestamp_ns FROM pw JOIN st USING (word) JOIN ask_st USING (stem) GROUP BY event_id, timestamp_ns HAVING count(DISTINCT stem) = (SELECT count(DISTINCT stem) FROM ask_st)"


def _index_sql(phrase: str, found: str) -> str:
    return f"WITH {LN}, {_PLACED}, {_ASKED(phrase)}, vocabulary AS (SELECT word FROM pw UNION SELECT word FROM ask), {_stem_sql('vocabulary')}, ask_st AS (SELECT i, stem FROM ask JOIN st USING (word)) {found}"


def _indexed(spark, d):
    path = shared_path(spark, "index")
    search_index.build(lines(spark, d), path)
    return path


@query("q3_index_phrase", _index_sql("failing passwords for users", _BEGUN))
def q3_index(spark, d):
    return search_index.phrase_hits(spark, _indexed(spark, d), "Failing passwords for users")


@query("q3_index_words", _index_sql("users opening sessions", _ALL))
def q3_index_words(spark, d):
    return search_index.word_hits(spark, _indexed(spark, d), "users opening sessions")


@query("q3_word_search", f"SELECT doc_id FROM documents WHERE contains({TOKENS}, ' the ') AND contains({TOKENS}, ' with ') AND contains({TOKENS}, ' this ')")
def q3_words(spark, d):
    return table(spark, d, "documents").where(q.words_match(F.col("text"), ["the", "with", "this"])).select("doc_id")


@query("q4_rollup", f"WITH {AL} SELECT alert_id FROM al WHERE len(list_filter(mitre_techniques, lambda t: t = 'T1110' OR t LIKE 'T1110.%')) > 0")
def q4(spark, d):
    return alerts(spark, d).where(q.technique_match(F.col("mitre_techniques"), "T1110")).select("alert_id")


@query("q5_regex_condition", f"WITH {LN} SELECT event_id FROM ln WHERE regexp_matches(substr(message, 1, 4096), '(?i)failed password.*u[0-9]*5@')")
def q5(spark, d):
    return lines(spark, d).where(q.regex_condition(F.col("message"), "(?i)failed password.*u[0-9]*5@")).select("event_id")


@query("q7_live_filter", f"WITH {EV} SELECT event_id FROM ev WHERE source_type IN ('error', 'purchase') AND severity_id >= 2 AND template_id IN (5)")
def q7(spark, d):
    return events(spark, d).where(q.live_filter(["error", "purchase"], 2, [5])).select("event_id")


RULES = "ru AS (SELECT p_partkey AS rule_id, p_name AS title, p_type AS category, p_brand AS product, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level, p_size % 3 <> 0 AS enabled FROM part)"


def rule_table(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS rule_id", "p_name AS title", "p_type AS category", "p_brand AS product", "CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level", "p_size % 3 <> 0 AS enabled")


@query("q9_rule_filter", f"WITH {RULES} SELECT rule_id, title FROM ru WHERE level IN ('high', 'critical') AND enabled AND contains(lower(title), 'a')")
def q9(spark, d):
    return rule_table(spark, d).where(q.rule_filter(severities=["high", "critical"], enabled=True, title="A")).select("rule_id", "title")


@query("q10_page", f"WITH {EV} SELECT event_id, timestamp_ns FROM ev ORDER BY timestamp_ns DESC, event_id DESC LIMIT 50 OFFSET 100")
def q10(spark, d):
    return q.newest(events(spark, d), 3, 50).select("event_id", "timestamp_ns")


@query("q13_point_lookup", f"WITH {AL} SELECT alert_id, rule_name, risk_score FROM al WHERE event_id = (SELECT min(event_id) FROM al)")
def q13(spark, d):
    a = alerts(spark, d)
    return a.join(F.broadcast(a.agg(F.min("event_id").alias("event_id"))), "event_id").select("alert_id", "rule_name", "risk_score")


@query("j1_timeline", f"WITH {EV} SELECT event_id, timestamp_ns, source_type FROM ev WHERE entity = 'u7' AND timestamp_ns BETWEEN {FIRST} AND {LAST}")
def j1(spark, d):
    return q.entity_timeline(events(spark, d).withColumn("entity_refs", F.array("entity")), "u7", FIRST, LAST).select("event_id", "timestamp_ns", "source_type")


@query("j2_mitre_join", f"WITH {AL} SELECT alert_id FROM al WHERE list_contains(mitre_tactics, 'initial_access') AND len(list_filter(mitre_techniques, lambda t: t = 'T1110' OR t LIKE 'T1110.%')) > 0")
def j2(spark, d):
    return q.alerts_with(alerts(spark, d), "initial_access", "T1110").select("alert_id")


@query("j6_hydrate", f"WITH {AL}, w AS (SELECT alert_id, timestamp_ns AS alert_ns, entity_value, unnest(range(greatest(event_id - 400, 0), event_id + 1)) AS event_id FROM al), m AS (SELECT w.alert_id, e.event_id, e.timestamp_ns, e.source_type, row_number() OVER (PARTITION BY w.alert_id ORDER BY e.timestamp_ns DESC, e.event_id DESC) AS r FROM w JOIN ev e USING (event_id) WHERE abs(e.timestamp_ns - alert_ns) <= {DAY} AND e.entity = w.entity_value) SELECT alert_id, event_id, timestamp_ns, source_type FROM m WHERE r <= 16")
def j6(spark, d):
    some = alerts(spark, d).withColumn("contributing_events", F.sequence(F.greatest(F.col("event_id") - 400, F.lit(0)), F.col("event_id")))
    return q.hydrate(some, events(spark, d))


LABELS = f"{AL}, lb AS (SELECT event_id AS label_id, timestamp_ns // {SECOND} AS time_s, entity AS who, 'u' || (user_id + 1) AS other, source_type FROM ev WHERE source_type IN ('error', 'signup') AND value > 150), aa AS (SELECT alert_id, entity_value, timestamp_ns // {SECOND} AS time_s, risk_score FROM al), mt AS (SELECT DISTINCT alert_id, label_id FROM aa JOIN lb ON entity_value IN (who, other) AND abs(aa.time_s - lb.time_s) <= 7200)"


def label_tables(spark, d):
    labels = events(spark, d).where("source_type IN ('error', 'signup') AND value > 150").select(F.col("event_id").alias("label_id"), F.expr(f"timestamp_ns div {SECOND}").alias("time_s"), F.array(F.col("entity"), F.expr("'u' || (user_id + 1)")).alias("candidates"), "source_type")
    found = alerts(spark, d).select("alert_id", "entity_value", F.expr(f"timestamp_ns div {SECOND}").alias("time_s"), "risk_score")
    return found, labels, evaluate.match_labels(found, labels, 7200)


@query("j7_label_match", f"WITH {LABELS} SELECT 'tp' AS kind, alert_id AS id FROM aa WHERE alert_id IN (SELECT alert_id FROM mt) UNION ALL SELECT 'fp', alert_id FROM aa WHERE alert_id NOT IN (SELECT alert_id FROM mt) UNION ALL SELECT 'fn', CAST(label_id AS VARCHAR) FROM lb WHERE label_id NOT IN (SELECT label_id FROM mt)")
def j7(spark, d):
    return evaluate.verdicts(*label_tables(spark, d))


@query("j8_related", f"WITH {GR} SELECT DISTINCT target_id AS neighbour, rel_type FROM gr WHERE source_id = 'u7' UNION SELECT DISTINCT source_id, rel_type FROM gr WHERE target_id = 'u7'")
def j8(spark, d):
    return q.related(graph_rows(spark, d), "u7")


@query("j9_rule_counts", f"WITH {AL}, c AS (SELECT rule_name, count(*) AS n FROM al WHERE timestamp_ns >= {FIRST} AND timestamp_ns < {FIRST + DAY} GROUP BY rule_name), r AS (SELECT * FROM (VALUES (1,'error'),(2,'click'),(3,'never')) t(rule_id, title)) SELECT r.rule_id, title, coalesce(n, 0) AS alerts FROM r LEFT JOIN c ON title = rule_name")
def j9(spark, d):
    counts = aggregates.grouped_counts(alerts(spark, d), FIRST, FIRST + DAY)
    rules = spark.createDataFrame([(1, "error"), (2, "click"), (3, "never")], "rule_id int, title string")
    return aggregates.rules_with_counts(rules, counts)


@query("j10_feedback_alerts", f"WITH {FB} SELECT al.alert_id, lv.feedback, al.rule_name FROM lv JOIN al USING (alert_id)")
def j10(spark, d):
    return aggregates.latest_verdicts(feedback(spark, d)).join(alerts(spark, d), "alert_id").select("alert_id", "feedback", "rule_name")


@query("j11_scores_alerts", f"WITH {AL}, s AS (SELECT timestamp_ns - timestamp_ns % {HOUR} AS bucket_ns, count(*) AS n_events FROM ev GROUP BY 1), a AS (SELECT timestamp_ns - timestamp_ns % {HOUR} AS bucket_ns, count(*) AS n FROM al GROUP BY 1) SELECT bucket_ns, n_events, coalesce(n, 0) AS n_alerts FROM s LEFT JOIN a USING (bucket_ns)")
def j11(spark, d):
    b = aggregates.floor_to(F.col("timestamp_ns"), HOUR).alias("bucket_ns")
    scores, found = events(spark, d).groupBy(b).agg(F.count("*").alias("n_events")), alerts(spark, d).groupBy(b).agg(F.count("*").alias("n"))
    return scores.join(found, "bucket_ns", "left").select("bucket_ns", "n_events", F.coalesce("n", F.lit(0)).alias("n_alerts"))


@query("g1_count_total", f"WITH {AL} SELECT count(*) AS n, count(DISTINCT dedup_key) AS keys FROM al")
def g1(spark, d):
    return alerts(spark, d).agg(F.count("*").alias("n"), F.countDistinct("dedup_key").alias("keys"))


@query("g2_bucketed", f"WITH {AL} SELECT timestamp_ns - timestamp_ns % {HOUR} AS bucket_ns, alert_type, rule_name, count(*) AS n FROM al WHERE timestamp_ns >= {FIRST} AND timestamp_ns < {MID} GROUP BY ALL")
def g2(spark, d):
    return aggregates.bucketed_counts(alerts(spark, d), HOUR, FIRST, MID)


@query("g3_grouped", f"WITH {AL} SELECT rule_name, count(*) AS n FROM al WHERE timestamp_ns >= {FIRST} AND timestamp_ns < {MID} GROUP BY 1")
def g3(spark, d):
    return aggregates.grouped_counts(alerts(spark, d), FIRST, MID)


@query("g4_severity", f"WITH {EV} SELECT CASE WHEN event_id % 9 <= 6 THEN ['trace','informational','notice','warning','error','critical','fatal'][CAST(event_id % 9 AS INT) + 1] ELSE 'unknown' END AS severity, count(*) AS n FROM ev GROUP BY 1")
def g4(spark, d):
    return aggregates.severity_counts(events(spark, d).withColumn("severity_id", (F.col("event_id") % 9).cast("int")), SEVERITY_NAMES)


@query("g5_feedback_stats", f"WITH {FB} SELECT CAST(sum(CASE WHEN feedback = 'tp' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN feedback = 'fp' THEN 1 ELSE 0 END) AS BIGINT) AS fp, count(*) AS total FROM lv")
def g5(spark, d):
    return aggregates.feedback_stats(feedback(spark, d))


@query("g6_tp_patterns", f"WITH {FB}, c AS (SELECT al.*, row_number() OVER (PARTITION BY alert_type, rule_name, entity_type ORDER BY timestamp_ns DESC, alert_id DESC) AS r FROM lv JOIN al USING (alert_id) WHERE feedback = 'tp') SELECT alert_type, rule_name, entity_type, count(*) AS tp_count, max(timestamp_ns) AS last_ns, string_agg(alert_id, ',' ORDER BY r) FILTER (WHERE r <= 16) AS sample_ids FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def g6(spark, d):
    return aggregates.tp_patterns(feedback(spark, d), alerts(spark, d))


@query("g7_feedback_history", f"WITH {FB} SELECT id, alert_id, feedback FROM fb ORDER BY submitted_at_ns DESC, id DESC LIMIT 200")
def g7(spark, d):
    return q.newest(feedback(spark, d), 1, 200, 200, "submitted_at_ns", "id").select("id", "alert_id", "feedback")


@query("g10_edges", f"WITH {GR} SELECT source_id, target_id, rel_type, min(timestamp_ns) AS first_seen, max(timestamp_ns) AS last_seen, count(*) AS event_count FROM gr GROUP BY 1, 2, 3")
def g10(spark, d):
    return aggregates.edge_table(graph_rows(spark, d))


@query("g11_timeline", f"WITH {EV}, p AS (SELECT source_type, timestamp_ns - timestamp_ns % {6 * HOUR} AS b, max(value) AS m, sum(value) AS s, count(*) AS n, arg_max(value / 2, timestamp_ns) AS t FROM ev GROUP BY 1, 2), g AS (SELECT b, max(m) AS m, sum(s) AS s, sum(n) AS n, max(t) AS t FROM p GROUP BY b), x AS (SELECT unnest(range((SELECT min(b) FROM g), (SELECT max(b) FROM g) + 1, {6 * HOUR})) AS b) SELECT x.b AS bucket_ns, coalesce(m, 0) AS max_score, round(coalesce(s, 0), 6) AS sum_score, round(coalesce(s / n, 0), 9) AS avg_score, CAST(coalesce(n, 0) AS BIGINT) AS event_count, last_value(t IGNORE NULLS) OVER (ORDER BY x.b ROWS UNBOUNDED PRECEDING) AS threshold FROM x LEFT JOIN g ON g.b = x.b")
def g11(spark, d):
    scores = events(spark, d).select("source_type", "timestamp_ns", "event_id", F.col("value").alias("score"), (F.col("value") / 2).alias("threshold"))
    return rounded(rounded(aggregates.anomaly_timeline(scores, 6 * HOUR), "sum_score"), "avg_score", places=9)


@query("g12_risk_history", f"WITH {AL}, i AS (SELECT * FROM al WHERE timestamp_ns >= {FIRST} AND timestamp_ns < {MID}), x AS (SELECT DISTINCT entity_value, unnest(range({FIRST}, {MID}, {DAY})) AS bucket_ns FROM i), g AS (SELECT entity_value, timestamp_ns - timestamp_ns % {DAY} AS bucket_ns, sum(risk_score) AS risk, count(*) AS n, arg_max(rule_name, struct_pack(a := risk_score, b := -timestamp_ns)) AS top_rule FROM i GROUP BY 1, 2) SELECT entity_value, bucket_ns, round(coalesce(risk, 0), 6) AS risk, coalesce(n, 0) AS n, top_rule FROM x LEFT JOIN g USING (entity_value, bucket_ns)")
def g12(spark, d):
    return rounded(aggregates.risk_history(alerts(spark, d), DAY, FIRST, MID), "risk")


@query("g13_sparkline", f"WITH {AL}, c AS (SELECT rule_name, CAST((timestamp_ns - {MID - DAY}) // {HOUR} AS INT) AS slot, count(*) AS n FROM al WHERE timestamp_ns >= {MID - DAY} AND timestamp_ns < {MID} GROUP BY 1, 2), x AS (SELECT DISTINCT rule_name, unnest(range(0, 24)) AS slot FROM al) SELECT rule_name, CAST(x.slot AS INT) AS slot, coalesce(n, 0) AS n FROM x LEFT JOIN c USING (rule_name, slot)")
def g13(spark, d):
    return aggregates.firing_sparkline(alerts(spark, d), MID)


CANON = "CASE " + " ".join(f"WHEN replace(lower(t), '-', '_') = '{n}' OR upper(t) = '{k}' THEN '{n}'" for k, (n, _) in attack.TACTICS.items()) + " END"
PAR = "CASE WHEN regexp_matches(upper(q), '^T[0-9]{4}(\\.[0-9]{3})?$') THEN string_split(upper(q), '.')[1] ELSE q END"
ORDER = "CASE tactic " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(attack.TACTICS.values())) + f" ELSE {len(attack.TACTICS)} END"


@query("g14_attack_matrix", f"WITH {AL}, aa AS (SELECT DISTINCT alert_id, {CANON} AS tactic, {PAR} AS technique FROM (SELECT alert_id, unnest(mitre_tactics) AS t, mitre_techniques FROM al) a, unnest(a.mitre_techniques) AS z(q)), ac AS (SELECT tactic, technique, count(*) AS alert_count FROM aa GROUP BY ALL), r AS (SELECT * FROM (VALUES ('brute', 'credential-access', 'T1110.003'), ('cron', 'persistence', 'T1053.003'), ('move', 'TA0008', 'T1021')) v(title, t, q)), rc AS (SELECT {CANON} AS tactic, {PAR} AS technique, count(*) AS rule_count, string_agg(title, ',' ORDER BY title) AS rules FROM r GROUP BY 1, 2) SELECT tactic, technique, coalesce(rule_count, 0) AS rule_count, coalesce(rules, '') AS rules, coalesce(alert_count, 0) AS alert_count, coalesce(rule_count, 0) > 0 AS covered, coalesce(alert_count, 0) > 0 AS detected, {ORDER} AS tactic_order FROM ac FULL JOIN rc USING (tactic, technique)")
def g14(spark, d):
    rules = spark.createDataFrame([("brute", ["credential-access"], ["T1110.003"]), ("cron", ["persistence"], ["T1053.003"]), ("move", ["TA0008"], ["T1021"])], "title string, tactics array<string>, techniques array<string>")
    return aggregates.coverage(rules, alerts(spark, d).select("alert_id", F.col("mitre_tactics").alias("tactics"), F.col("mitre_techniques").alias("techniques")))


@query("g15_entity_facets", f"WITH {EV}, p AS (SELECT timestamp_ns, 'user' AS kind, entity AS value FROM ev WHERE source_type = 'error' UNION ALL SELECT timestamp_ns, 'ip', '10.0.0.' || (user_id % 256) FROM ev WHERE source_type = 'error') SELECT kind, value, min(timestamp_ns) AS first_ns, count(*) AS n FROM p GROUP BY 1, 2")
def g15(spark, d):
    found = events(spark, d).where("source_type = 'error'").withColumns({"users": F.array("entity"), "ips": F.array(F.expr("'10.0.0.' || (user_id % 256)"))})
    return aggregates.entity_facets(found, {"user": "users", "ip": "ips"})


@query("g16_pipeline_stats", f"WITH {EV} SELECT count(*) AS events, count(DISTINCT source_type) AS sources, CAST(sum(CASE WHEN severity_id >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(timestamp_ns) AS last_ns, round(count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9), 9) AS rate FROM ev")
def g16(spark, d):
    return rounded(aggregates.pipeline_stats(events(spark, d)), "rate", places=9)


@query("g17_latency", "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY 1")
def g17(spark, d):
    return rounded(aggregates.latency_percentiles(table(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", "value"), "p50", "p95", "p99")


@query("g17_sketch")
def g17_sketch(spark, d):
    """Sketches of each hour, merged."""
    hours = events(spark, d).withColumn("hour", F.expr(f"timestamp_ns div {HOUR}"))
    return aggregates.merged_percentiles(aggregates.latency_sketches(hours, ["source_type", "hour"], "value"), ["source_type"])


@query("g18_rule_counters", f"WITH {AL} SELECT rule_name AS rule_id, count(*) AS match_count, max(timestamp_ns) AS last_fired_ns FROM al GROUP BY 1")
def g18(spark, d):
    return aggregates.rule_counters(alerts(spark, d).withColumnRenamed("rule_name", "rule_id"))


@query("g19_metrics", f"WITH {LABELS}, c AS (SELECT (SELECT count(*) FROM aa WHERE alert_id IN (SELECT alert_id FROM mt)) AS tp, (SELECT count(*) FROM aa WHERE alert_id NOT IN (SELECT alert_id FROM mt)) AS fp, (SELECT count(*) FROM lb WHERE label_id NOT IN (SELECT label_id FROM mt)) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round(fp / (tp + fp), 9) AS fp_rate FROM c")
def g19(spark, d):
    return rounded(evaluate.metrics(evaluate.verdicts(*label_tables(spark, d))), "precision", "recall", "f1", "fp_rate", places=9)


@query("g20_scenarios", f"WITH {LABELS}, h AS (SELECT label_id, min(aa.time_s) AS a_s FROM mt JOIN aa USING (alert_id) GROUP BY 1) SELECT lb.source_type AS scenario, count(*) AS n, min(lb.time_s) AS first_s, min(a_s) AS detected_s, CAST(sum(CASE WHEN a_s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed, min(a_s) - min(lb.time_s) AS time_to_detect_s FROM lb LEFT JOIN h USING (label_id) GROUP BY 1")
def g20(spark, d):
    found, labels, matches = label_tables(spark, d)
    return evaluate.scenarios(labels, found, matches, F.col("source_type"))


SWEEP = f"{AL}, sc AS (SELECT floor(risk_score * 100) / 100 AS s, event_id % 3 = 0 AS tp FROM al), th AS (SELECT DISTINCT s AS threshold FROM sc UNION SELECT 0.0 UNION SELECT 1.0), cu AS (SELECT threshold, (SELECT count(*) FROM sc WHERE tp AND s >= threshold) AS tp, (SELECT count(*) FROM sc WHERE NOT tp AND s >= threshold) AS fp, (SELECT count(*) FROM sc WHERE tp) AS p, (SELECT count(*) FROM sc WHERE NOT tp) AS n FROM th)"


def curve(spark, d):
    return evaluate.sweep(alerts(spark, d).select((F.floor(F.col("risk_score") * 100) / 100).alias("score"), (F.col("event_id") % 3 == 0).alias("is_tp")))


@query("g21_pr_roc", f"WITH {SWEEP} SELECT threshold, tp, fp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(tp / p, 9) AS recall, round(fp / n, 9) AS fpr FROM cu")
def g21(spark, d):
    return rounded(curve(spark, d), "precision", "recall", "fpr", places=9).withColumns({"tp": F.col("tp").cast("long"), "fp": F.col("fp").cast("long")})


@query("g22_auc", f"WITH {SWEEP}, pt AS (SELECT DISTINCT fp / n AS x, tp / p AS y FROM cu), a AS (SELECT (x - lag(x) OVER (ORDER BY x, y)) * (y + lag(y) OVER (ORDER BY x, y)) / 2 AS a FROM pt) SELECT round(greatest(0, least(1, sum(a))), 9) AS auc FROM a")
def g22(spark, d):
    return rounded(evaluate.auc(curve(spark, d)), "auc", places=9)


@query("g23_missed_attribution", f"WITH {LABELS} SELECT label_id, source_type AS scenario, CASE source_type WHEN 'error' THEN 'correlation' WHEN 'click' THEN 'sigma' ELSE 'unknown' END AS family FROM lb WHERE label_id NOT IN (SELECT label_id FROM mt)")
def g23(spark, d):
    _, labels, matches = label_tables(spark, d)
    return evaluate.missed_attribution(labels, matches, F.col("source_type"), {"error": "correlation", "click": "sigma"})


@query("g25_busiest_hours", f"WITH {EV}, c AS (SELECT entity, CAST((timestamp_ns // {HOUR}) % 24 AS INT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, hour) AS rank FROM c) SELECT entity, hour, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def g25(spark, d):
    return aggregates.busiest_hours(events(spark, d))


@query("t1_newest", f"WITH {AL} SELECT alert_id, timestamp_ns FROM al ORDER BY timestamp_ns DESC, alert_id DESC LIMIT 20 OFFSET 20")
def t1(spark, d):
    return q.newest(alerts(spark, d), 2, 20, 10_000, key="alert_id").select("alert_id", "timestamp_ns")


@query("t2_latest_per_key", f"WITH {AL} SELECT dedup_key, max(timestamp_ns) AS last_ns, arg_max(alert_id, timestamp_ns) AS alert_id, count(*) AS n FROM al GROUP BY 1")
def t2(spark, d):
    return q.latest_per_key(alerts(spark, d), "dedup_key", "timestamp_ns", "alert_id")


@query("t3_top_keys", f"WITH {AL} SELECT dedup_key, count(*) AS n FROM al GROUP BY 1 ORDER BY n DESC, dedup_key LIMIT 10")
def t3(spark, d):
    return alerts(spark, d).groupBy("dedup_key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dedup_key").limit(10)


@query("t4_top_per_group", f"WITH {AL}, r AS (SELECT rule_name, alert_id, CAST(row_number() OVER (PARTITION BY rule_name ORDER BY risk_score DESC, alert_id) AS INT) AS rank FROM al) SELECT * FROM r WHERE rank <= 16")
def t4(spark, d):
    return q.top_per_group(alerts(spark, d), ["rule_name"], [F.col("risk_score").desc(), F.col("alert_id")], 16).select("rule_name", "alert_id", "rank")


@query("t5_distinct_in_order", f"WITH {EV} SELECT entity, array_to_string(list(source_type ORDER BY f), ',') AS kinds FROM (SELECT entity, source_type, min(timestamp_ns) AS f FROM ev GROUP BY 1, 2) GROUP BY entity")
def t5(spark, d):
    first = events(spark, d).groupBy("entity", "source_type").agg(F.min("timestamp_ns").alias("f"))
    return first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "source_type"))), lambda x: x["source_type"]), ",").alias("kinds"))


@query("t6_union_families", f"WITH {AL} SELECT alert_type, count(*) AS n, round(sum(risk_score), 6) AS risk FROM al GROUP BY 1")
def t6(spark, d):
    a = alerts(spark, d)
    families = [a.where(F.col("alert_type") == k) for k in ("ml", "sigma", "correlation")]
    return rounded(families[0].unionByName(families[1]).unionByName(families[2]).groupBy("alert_type").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk")), "risk")


@query("t8_rules_without_alerts", f"WITH {AL} SELECT DISTINCT entity FROM ev WHERE entity NOT IN (SELECT entity_value FROM al WHERE risk_score > 0.4)")
def t8(spark, d):
    high = alerts(spark, d).where("risk_score > 0.4").select(F.col("entity_value").alias("entity"))
    return events(spark, d).select("entity").distinct().join(high, "entity", "left_anti")


@query("t9_empty_buckets", f"WITH {EV}, g AS (SELECT DISTINCT timestamp_ns - timestamp_ns % {HOUR // 6} AS b FROM ev), x AS (SELECT unnest(range((SELECT min(b) FROM g), (SELECT max(b) FROM g) + 1, {HOUR // 6})) AS b) SELECT b AS bucket_ns FROM x WHERE b NOT IN (SELECT b FROM g)")
def t9(spark, d):
    seen = events(spark, d).select(aggregates.floor_to(F.col("timestamp_ns"), HOUR // 6).alias("bucket_ns")).distinct()
    bounds = seen.agg(F.min("bucket_ns").alias("low"), (F.max("bucket_ns") + 1).alias("high"))
    return aggregates.grid(bounds, HOUR // 6).select("bucket_ns").join(seen, "bucket_ns", "left_anti")


@query("a12_alert_json_rows", f"WITH {AL} SELECT alert_id, round(CAST(risk_score AS DECIMAL(18,9)), 3)::DOUBLE AS score FROM al")
def a12_alerts(spark, d):
    return sinks.alert_json(alerts(spark, d)).select(F.get_json_object("value", "$.alert_id").alias("alert_id"), F.get_json_object("value", "$.score").cast("double").alias("score"))


@query("t7_key_union", f"WITH {AL} SELECT entity AS key FROM ev UNION SELECT rule_name FROM al")
def t7(spark, d):
    return events(spark, d).select(F.col("entity").alias("key")).union(alerts(spark, d).select("rule_name")).distinct()
