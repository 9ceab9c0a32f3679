"""Queries on sources, parsing and identity (A*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsight.functions import attack, identity, text
from logsight.operators import aggregates, templates
from logsight.operators.lineage import shared_path
from logsight.plans.base import AL, EV, LN, alerts, events, lines, query, table
from logsight.sources import readers, sinks

OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
MASKED = f"regexp_replace(regexp_replace(trim(regexp_replace(substr(message, 1, 8192), '\\s+', ' ', 'g')), '\\b(?:{OCTET}\\.){{3}}{OCTET}\\b', '<IP>', 'g'), '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<UUID>', 'g')"
TEMPLATE = f"array_to_string(list_transform(string_split({MASKED}, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')"
UUID = "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12)"


def distinct_list(expr: str) -> str:
    """DuckDB text for the distinct elements of a list in order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


@query("a1_line_source", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) SELECT count(*) AS n, sum(length(value)) AS chars FROM l WHERE trim(value) <> ''")
def a1(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).where(F.trim("value") != "")
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("a4_syslog_header", f"WITH {LN}, p AS (SELECT event_id, message, CAST(regexp_extract(message, '^<([0-9]{{1,3}})>', 1) AS INT) AS pri, regexp_replace(message, '^<[0-9]{{1,3}}>', '') AS rest FROM ln) SELECT event_id, CASE WHEN pri <= 191 THEN pri >> 3 ELSE 1 END AS facility, CASE WHEN pri <= 191 THEN pri & 7 ELSE 5 END AS syslog_severity, [6,5,5,4,3,2,1,0][(CASE WHEN pri <= 191 THEN pri & 7 ELSE 5 END) + 1] AS severity_id, CASE WHEN rest LIKE '1 %' THEN '5424' ELSE '3164' END AS rfc FROM p")
def a4(spark, d):
    return readers.syslog(lines(spark, d), "message").select("event_id", "facility", "syslog_severity", "severity_id", "rfc")


@query("a5_json_mapping", "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.missing') IS NULL THEN 1 ELSE 2 END AS n_fields FROM events")
def a5(spark, d):
    mapped = readers.webhook(table(spark, d, "events"), {"k": "k", "m": "missing.path"}, "props")
    return mapped.select("event_id", F.try_element_at("fields", F.lit("k")).alias("k"), F.size("fields").alias("n_fields"))


@query("a6_otlp_logs", f"WITH {LN} SELECT timestamp_ns, severity_id AS severity_number, message, entity AS user_attribute FROM ln")
def a6(spark, d):
    value = lambda c: F.struct(F.col(c).alias("stringValue"))
    record = F.struct(F.col("timestamp_ns").cast("string").alias("timeUnixNano"), F.col("severity_id").alias("severityNumber"), value("message").alias("body"), F.array(F.struct(F.lit("user").alias("key"), value("entity").alias("value"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return readers.otlp_logs(lines(spark, d).select(body.alias("body"))).select("timestamp_ns", "severity_number", "message", F.col("attributes")["user"].alias("user_attribute"))


AUTH = "au AS (SELECT event_id AS time, 'U' || user_id || '@DOM1' AS src_user, 'C' || (user_id % 40) AS src_computer, 'C' || (event_id % 90 + 1) AS dst_computer, CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END AS success FROM events)"


def auth_rows(spark, d):
    return table(spark, d, "events").selectExpr("event_id AS time", "'U' || user_id || '@DOM1' AS src_user", "'C' || (user_id % 40) AS src_computer", "'C' || (event_id % 90 + 1) AS dst_computer", "'Kerberos' AS auth_type", "CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END AS success")


FLOW = "fl AS (SELECT event_id AS time, 'C' || (user_id % 40) AS src_computer, 'C' || (event_id % 90 + 1) AS dst_computer, CASE WHEN event_id % 5 = 0 THEN '?' ELSE CAST(event_id % 1000 AS VARCHAR) END AS dst_port, CAST(value * 100 AS BIGINT) AS byte_count FROM events)"


def flow_rows(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS time", "'C' || (user_id % 40) AS src_computer", "'C' || (event_id % 90 + 1) AS dst_computer", "'1' AS src_port", "CASE WHEN event_id % 5 = 0 THEN '?' ELSE CAST(event_id % 1000 AS STRING) END AS dst_port", "CAST(round(value * 100) AS BIGINT) AS byte_count")
    return readers.security_rows(rows, "flow")


@query("a7_flow_ports", f"WITH {FLOW} SELECT time, src_computer, CASE WHEN dst_port = '?' THEN -1 ELSE CAST(dst_port AS INT) END AS dst_port, byte_count FROM fl")
def a7(spark, d):
    return flow_rows(spark, d).select("time", "src_computer", "dst_port", "byte_count")


@query("a8_time_merge", f"WITH {AUTH}, {FLOW} SELECT time, 0 AS source_rank, src_computer FROM au UNION ALL SELECT time, 1, src_computer FROM fl")
def a8(spark, d):
    return readers.merged_by_time([auth_rows(spark, d), flow_rows(spark, d)]).select("time", "source_rank", "src_computer")


IP = "'10.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255)"


@query("a9_security_events", f"WITH {AUTH}, m AS (SELECT *, (CASE WHEN success = 'Success' THEN 'Accepted ' ELSE 'authentication failure ' END) || 'Kerberos for user ' || lower(string_split(src_user, '@')[1]) || ' from ' || src_computer || ' to ' || dst_computer AS message, CAST(substr(src_computer, 2) AS BIGINT) AS n FROM au) SELECT time AS time_s, lower(string_split(src_user, '@')[1]) AS entity, 'user' AS entity_type, message FROM m UNION ALL SELECT time, {IP}, 'ip', message FROM m WHERE n >= 1")
def a9(spark, d):
    return readers.security_events(readers.security_rows(auth_rows(spark, d), "auth"), "auth").select("time_s", "entity", "entity_type", "message")


@query("a10_rebase", "SELECT event_id, event_id + 1000000 - (SELECT max(event_id) FROM events) AS time FROM events")
def a10(spark, d):
    return readers.rebased(table(spark, d, "events").select("event_id", F.col("event_id").alias("time")), "time", 1_000_000)


@query("a11_idempotent_write", f"WITH {EV}, twice AS (SELECT event_id % 5000 AS event_id, timestamp_ns FROM ev) SELECT event_id, min(timestamp_ns) AS timestamp_ns FROM twice GROUP BY event_id")
def a11(spark, d):
    return sinks.first_by_id(events(spark, d).select((F.col("event_id") % 5000).alias("event_id"), "timestamp_ns"))


@query("a11_upsert", f"WITH {EV} SELECT event_id, timestamp_ns, CASE WHEN event_id % 3 = 1 THEN value ELSE value + 1000 END AS value, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d') AS day FROM ev")
def a11_upsert(spark, d):
    """Two batches, the second with all events and changed values, and again."""
    path = shared_path(spark, "events")
    rows = events(spark, d).select("event_id", "timestamp_ns", "value")
    every = rows.withColumn("value", F.col("value") + 1000)
    for batch in (rows.where("event_id % 3 = 1"), every.unionByName(every), every):
        sinks.write_events(batch, path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


NAMES = "['TRACE','INFORMATIONAL','NOTICE','WARNING','ERROR','CRITICAL','FATAL'][severity_id + 1]"


@query("a12_event_json", f"WITH {EV} SELECT '{{\"event_id\":' || event_id || ',\"timestamp_ns\":' || timestamp_ns || ',\"severity\":\"' || {NAMES} || '\",\"source_type\":\"' || source_type || '\",\"template_id\":' || template_id || ',\"message\":\"' || entity || '\"}}' AS value FROM ev")
def a12(spark, d):
    return sinks.event_json(events(spark, d).withColumn("message", F.col("entity")))


@query("a13_alert_csv", f"WITH {AL} SELECT alert_id, CAST(timestamp_ns AS VARCHAR) AS timestamp_ns, {NAMES} AS severity, alert_type AS type, printf('%.3f', round(CAST(risk_score AS DECIMAL(18,9)), 3)) AS score, rule_name AS rule, array_to_string(mitre_tactics, ';') AS tactics FROM al")
def a13(spark, d):
    return sinks.alert_csv(alerts(spark, d))


# the character cut decides where 32,768 characters have 65,536 bytes at most, which holds for all given texts; the byte cut has a test of its own
@query("e1_decode_cut", "SELECT doc_id, length(substr(text, 1, 32768)) AS n, CASE WHEN strlen(substr(text, 1, 32768)) <= 65536 THEN md5(substr(text, 1, 32768)) END AS digest FROM documents")
def e1(spark, d):
    kept = text.decode(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.length(kept).alias("n"), F.md5(F.encode(kept, "UTF-8")).alias("digest"))


@query("e2_severity", "SELECT event_id, CASE WHEN (event_id % 12) - 2 BETWEEN 0 AND 6 THEN CAST((event_id % 12) - 2 AS INT) ELSE 1 END AS severity_id FROM events")
def e2(spark, d):
    return table(spark, d, "events").select("event_id", text.severity(F.col("event_id") % 12 - 2).alias("severity_id"))


@query("e3_mask", f"WITH {LN} SELECT event_id, {MASKED} AS masked FROM ln")
def e3(spark, d):
    return lines(spark, d).select("event_id", text.mask(F.col("message")).alias("masked"))


@query("e4_exact_templates", f"WITH {LN} SELECT {TEMPLATE} AS template, count(*) AS n FROM ln GROUP BY ALL")
def e4_exact(spark, d):
    return lines(spark, d).groupBy(text.template_of(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


@query("e4_templates")
def e4(spark, d):
    mined = templates.mine(lines(spark, d))
    return mined.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("masks"))


@query("e5_template_params", f"WITH {LN}, t AS (SELECT event_id, string_split(trim(regexp_replace(message, '\\s+', ' ', 'g')), ' ') AS own, string_split({TEMPLATE}, ' ') AS slots FROM ln) SELECT event_id, array_to_string(list_filter(own, lambda x, i: slots[i] = '<*>'), '|') AS params FROM t")
def e5(spark, d):
    return lines(spark, d).select("event_id", F.array_join(text.template_params(F.col("message"), text.template_of(F.col("message"))), "|").alias("params"))


@query("x4_template_params", f"WITH {LN}, t AS (SELECT event_id, string_split(trim(regexp_replace(message, '\\s+', ' ', 'g')), ' ') AS own, string_split({TEMPLATE}, ' ') AS slots FROM ln), p AS (SELECT *, unnest(range(len(own))) AS place FROM t) SELECT event_id, CAST(place AS INT) AS place, own[place + 1] AS param FROM p WHERE slots[place + 1] = '<*>'")
def x4_params(spark, d):
    identity.register(spark)
    lines(spark, d).withColumn("template", text.template_of(F.col("message"))).createOrReplaceTempView("logsight_x4_lines")
    return spark.sql("SELECT event_id, place, param FROM logsight_x4_lines, LATERAL template_params(message, template)")


# IPv6 addresses in four spellings; the pattern's first alternative that fits decides how much of each is found
SIX = "CASE event_id % 4 WHEN 0 THEN '2001:DB8::' || (user_id + 1) WHEN 1 THEN 'fe80::' || (event_id % 900) || ':' || (user_id + 1) WHEN 2 THEN '2001:0db8:0:0:1:2:3:' || (event_id % 9000) ELSE '::1' END"
ADDRESSES = f"{LN}, sx AS (SELECT event_id, message || ' peer ' || {SIX} AS message FROM ln), ad AS (SELECT event_id, message, list_concat(regexp_extract_all(message, '\\b(?:{OCTET}\\.){{3}}{OCTET}\\b'), regexp_extract_all(message, '{text.IPV6}')) AS a FROM sx)"


def with_peers(spark, d):
    return lines(spark, d).withColumn("message", F.expr(f"message || ' peer ' || {SIX}"))


@query("e6_extract_ips", f"WITH {ADDRESSES} SELECT event_id, array_to_string({distinct_list('a')}, ',') AS ips FROM ad")
def e6(spark, d):
    return with_peers(spark, d).select("event_id", F.array_join(text.ips(F.col("message")), ",").alias("ips"))


@query("e7_extract_users", f"WITH {LN}, f AS (SELECT event_id, regexp_extract_all(message, '(?i)(?:user=|for user )([a-z0-9._@-]{{1,64}})', 1) AS a FROM ln) SELECT event_id, array_to_string({distinct_list('a')}, ',') AS users FROM f")
def e7(spark, d):
    return lines(spark, d).select("event_id", F.array_join(text.users(F.col("message")), ",").alias("users"))


LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"


@query("e8_extract_hosts", f"WITH {LN}, f AS (SELECT event_id, list_filter(regexp_extract_all(message, '(?i)host(?:name)?[= ]({LABEL}(?:\\.{LABEL})*)', 1), lambda h: NOT regexp_full_match(h, '(?:{OCTET}\\.){{3}}{OCTET}')) AS a FROM ln) SELECT event_id, array_to_string({distinct_list('a')}, ',') AS hosts FROM f")
def e8(spark, d):
    return lines(spark, d).select("event_id", F.array_join(text.hosts(F.col("message")), ",").alias("hosts"))


@query("e9_extract_files", f"WITH {LN}, f AS (SELECT event_id, regexp_extract_all(message, '(?:^|\\s)(/(?:[a-zA-Z0-9._-]+/)*[a-zA-Z0-9._-]+)', 1) AS a FROM ln) SELECT event_id, array_to_string({distinct_list('a')}, ',') AS files FROM f")
def e9(spark, d):
    return lines(spark, d).select("event_id", F.array_join(text.files(F.col("message")), ",").alias("files"))


ENDINGS = "['" + "','".join(text.FILE_ENDINGS) + "']"


@query("e10_extract_domains", f"WITH f AS (SELECT page_id, list_filter(regexp_extract_all(url, '\\b({LABEL}(?:\\.{LABEL}){{0,10}}\\.[a-zA-Z]{{2,63}})\\b', 1), lambda x: NOT list_contains({ENDINGS}, lower(string_split(x, '.')[-1]))) AS a FROM pages) SELECT page_id, array_to_string({distinct_list('a')}, ',') AS domains FROM f")
def e10(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.domains(F.col("url")), ",").alias("domains"))


@query("e11_processes", f"WITH {LN}, f AS (SELECT event_id, list_concat(list_concat(list_transform(regexp_extract_all(message, '\\b[a-zA-Z][a-zA-Z0-9_.-]{{0,63}}\\[[0-9]{{1,7}}\\]:'), lambda x: replace(replace(replace(x, ']:', ''), '[', ':'), '::', ':')), regexp_extract_all(message, '(?i)process(?:_name)?[= ]([a-z][a-z0-9_.-]{{0,63}})', 1)), regexp_extract_all(message, '(?i)\\bpid[= ]([0-9]{{1,7}})\\b', 1)) AS a FROM ln) SELECT event_id, array_to_string({distinct_list('a')}, ',') AS processes FROM f")
def e11(spark, d):
    return lines(spark, d).select("event_id", F.array_join(text.processes(F.col("message")), ",").alias("processes"))


@query("e12_tagged_entities", f"WITH {LN}, t AS (SELECT event_id, 'u' || user_id AS v, list_filter(string_split(trim(regexp_replace(message, '\\s+', ' ', 'g')), ' '), lambda x, i: string_split({TEMPLATE}, ' ')[i] = '<*>') AS params FROM ln) SELECT event_id, v AS value, CASE WHEN len(params) = 0 THEN 'unknown' WHEN list_contains(params, v) THEN 'param' ELSE 'template' END AS source FROM t")
def e12(spark, d):
    params = text.template_params(F.col("message"), text.template_of(F.col("message")))
    return lines(spark, d).select("event_id", F.explode(text.tagged(F.array("entity"), params)).alias("t")).select("event_id", "t.value", "t.source")


@query("e13_uuid5", f"WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'corp:' || lower(c_name) ELSE lower(c_name) END AS name FROM customer), x AS (SELECT c_custkey, sha1(unhex('a1b2c3d4000100000000000000000001') || encode(name)) AS h FROM s) SELECT c_custkey, {UUID} AS entity_uuid FROM x")
def e13(spark, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("CORP\\"), F.col("c_name"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", identity.entity_id("user", raw).alias("entity_uuid"))


FULL = "CASE event_id % 4 WHEN 0 THEN '2001:0db8:0000:0000:0000:0000:0000:' || lpad(CAST(user_id + 1 AS VARCHAR), 4, '0') WHEN 1 THEN 'fe80:0000:0000:0000:0000:0000:' || lpad(CAST(event_id % 900 AS VARCHAR), 4, '0') || ':' || lpad(CAST(user_id + 1 AS VARCHAR), 4, '0') WHEN 2 THEN '2001:0db8:0000:0000:0001:0002:0003:' || lpad(CAST(event_id % 9000 AS VARCHAR), 4, '0') ELSE '0000:0000:0000:0000:0000:0000:0000:0001' END"


# a group of more than four digits is no address, so neither name nor id comes of it
@query("e13_ipv6", f"WITH s AS (SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) AND NOT (user_id + 1 BETWEEN 0 AND 9999) THEN NULL ELSE {FULL} END AS name FROM events), x AS (SELECT event_id, name, sha1(unhex('a1b2c3d4000200000000000000000002') || encode(name)) AS h FROM s) SELECT event_id, name, {UUID} AS entity_uuid FROM x")
def e13_ipv6(spark, d):
    raw = F.expr(SIX)
    return table(spark, d, "events").select("event_id", identity.canonical("ip", raw).alias("name"), identity.entity_id("ip", raw).alias("entity_uuid"))


@query("e13_entity_refs")
def e13_refs(spark, d):
    m = F.col("message")
    refs = identity.entity_refs(text.ips(m), text.users(m), text.hosts(m), text.domains(m), text.files(m), text.processes(m))
    return lines(spark, d).select("event_id", F.array_join(refs, ",").alias("refs"))


TACTIC = "CASE " + " ".join(f"WHEN replace(lower(v), '-', '_') = '{n}' OR upper(v) = '{k}' THEN '{n}'" for k, (n, _) in attack.TACTICS.items()) + " END"
PARENT = "CASE WHEN regexp_matches(upper(v), '^T[0-9]{4}(\\.[0-9]{3})?$') THEN string_split(upper(v), '.')[1] ELSE v END"


@query("e14_tactics", f"WITH {AL}, u AS (SELECT alert_id, unnest(mitre_tactics) AS v FROM al) SELECT alert_id, v AS raw, {TACTIC} AS tactic FROM u")
def e14(spark, d):
    return alerts(spark, d).select("alert_id", F.explode("mitre_tactics").alias("raw")).withColumn("tactic", attack.tactic(F.col("raw")))


@query("e14_techniques", f"WITH {AL}, u AS (SELECT alert_id, unnest(mitre_techniques) AS v FROM al) SELECT alert_id, v AS raw, {PARENT} AS parent FROM u")
def e14_techniques(spark, d):
    return alerts(spark, d).select("alert_id", F.explode("mitre_techniques").alias("raw")).withColumn("parent", attack.parent(F.col("raw")))


@query("e15_primary_entity", f"WITH {ADDRESSES}, f AS (SELECT event_id, a[1] AS ip, regexp_extract(message, '(?i)(?:user=|for user )([a-z0-9._@-]{{1,64}})', 1) AS u FROM (SELECT event_id, message, CASE WHEN event_id % 3 = 0 THEN a END AS a FROM ad)) SELECT event_id, CASE WHEN ip IS NOT NULL THEN 'ip' WHEN u <> '' THEN 'user' ELSE 'ip' END AS kind, CASE WHEN ip IS NOT NULL THEN ip WHEN u <> '' THEN u END AS value FROM f")
def e15(spark, d):
    m = F.col("message")
    some = F.when(F.col("event_id") % 3 == 0, text.ips(m)).otherwise(F.array().cast("array<string>"))
    kind, value = identity.primary_entity({"ip": some, "user": text.users(m)})
    return with_peers(spark, d).select("event_id", kind.alias("kind"), value.alias("value"))


SHAPES = "CASE event_id % 5 WHEN 0 THEN '10.0.0.' || (event_id % 300) WHEN 1 THEN 'u' || user_id || '@corp' WHEN 2 THEN 'host' || user_id || '.example.com' WHEN 3 THEN '123e4567-e89b-12d3-a456-4266141740' || (10 + event_id % 90) ELSE 'plain words' END"


@query("e16_entity_shape", f"WITH s AS (SELECT event_id, {SHAPES} AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN 'uuid' WHEN regexp_full_match(v, '(?:{OCTET}\\.){{3}}{OCTET}') THEN 'ip' WHEN regexp_full_match(v, '[^\\s@\\\\]+[@\\\\]\\S*') THEN 'user' WHEN regexp_full_match(v, '[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') THEN 'host' END AS shape FROM s")
def e16(spark, d):
    return table(spark, d, "events").withColumn("v", F.expr(SHAPES)).select("event_id", text.entity_shape(F.col("v")).alias("shape"))


E17 = "CASE " + " ".join(f"WHEN regexp_matches(message, '(?i){p}') THEN '{','.join(t)}|{','.join(q)}'" for p, t, q in attack.TEMPLATE_RULES) + " END"


@query("e17_template_attack", f"WITH {LN} SELECT event_id, {E17} AS mapped FROM ln")
def e17(spark, d):
    found = attack.of_template(F.col("message"))
    return lines(spark, d).select("event_id", F.when(found.isNotNull(), F.concat_ws("|", F.array_join(found["tactics"], ","), F.array_join(found["techniques"], ","))).alias("mapped"))


@query("e18_synthetic_ip", f"WITH s AS (SELECT event_id, event_id * 2000 AS n FROM events) SELECT event_id, CASE WHEN n BETWEEN 1 AND 16777215 THEN {IP} END AS ip FROM s")
def e18(spark, d):
    return table(spark, d, "events").select("event_id", text.synthetic_ip(F.concat(F.lit("C"), F.col("event_id") * 2000)).alias("ip"))


@query("e19_user_parts", "WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'DOM' || chr(92) || c_name WHEN 1 THEN c_name || '@Corp.Example' ELSE ' ' || c_name || ' ' END AS raw FROM customer) SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN string_split(lower(trim(raw)), chr(92))[2] WHEN 1 THEN string_split(lower(raw), '@')[1] ELSE lower(trim(raw)) END AS name, CASE c_custkey % 3 WHEN 0 THEN 'dom' WHEN 1 THEN 'corp.example' ELSE '' END AS domain FROM s")
def e19(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("DOM\\"), F.col("c_name"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_name"), F.lit("@Corp.Example"))).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    name, domain = identity.user_parts(raw)
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), domain.alias("domain"))


@query("e20_pattern_key", "SELECT p_partkey, 'ml:' || regexp_replace(lower(trim(p_name)), '[^a-z0-9_.-]', '-', 'g') || ':user' AS key FROM part")
def e20(spark, d):
    return table(spark, d, "part").select("p_partkey", text.pattern_key(F.lit("ML"), F.col("p_name"), F.lit("user")).alias("key"))


@query("e22_escaped", "SELECT doc_id, md5(replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS digest FROM documents")
def e22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.escaped(F.col("text")).cast("binary")).alias("digest"))


@query("e23_entity_summary", f"WITH {LN}, f AS (SELECT event_id, regexp_extract_all(message, '(?i)(?:user=|for user )([a-z0-9._@-]{{1,64}})', 1) AS u, regexp_extract_all(message, '(?:^|\\s)(/(?:[a-zA-Z0-9._-]+/)*[a-zA-Z0-9._-]+)', 1) AS f FROM ln) SELECT event_id, array_to_string(({distinct_list('u')})[1:5], ',') AS users, array_to_string(({distinct_list('f')})[1:5], ',') AS files FROM f")
def e23(spark, d):
    summary = text.entity_summary({"users": text.users(F.col("message")), "files": text.files(F.col("message"))})
    return lines(spark, d).withColumn("s", summary).select("event_id", *(F.coalesce(F.array_join(F.try_element_at("s", F.lit(k)), ","), F.lit("")).alias(k) for k in ("users", "files")))


@query("e24_alert_id", f"WITH {EV}, x AS (SELECT event_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('hst:' || template_id || ':' || source_type || ':' || timestamp_ns || ':' || entity)) AS h FROM ev) SELECT event_id, {UUID} AS alert_id FROM x")
def e24(spark, d):
    return events(spark, d).select("event_id", identity.alert_id("hst", F.col("template_id"), F.col("source_type"), F.col("timestamp_ns"), F.col("entity")).alias("alert_id"))


@query("g8_template_catalog", f"WITH {LN}, t AS (SELECT *, {TEMPLATE} AS template FROM ln) SELECT template, min(timestamp_ns) AS first_seen_ns, max(timestamp_ns) AS last_seen_ns, count(*) AS event_count, arg_min(message, timestamp_ns) AS example FROM t GROUP BY template")
def g8(spark, d):
    return aggregates.template_catalog(lines(spark, d).withColumn("template", text.template_of(F.col("message"))))


@query("g9_top_templates", f"WITH {LN}, t AS (SELECT {TEMPLATE} AS template, count(*) AS n FROM ln GROUP BY ALL) SELECT template, n FROM t WHERE n >= 3 ORDER BY n DESC, template LIMIT 10")
def g9(spark, d):
    counted = lines(spark, d).groupBy(text.template_of(F.col("message")).alias("template")).agg(F.count("*").alias("n"))
    return counted.where("n >= 3").orderBy(F.col("n").desc(), "template").limit(10)


