"""Parsing, identity and readers on small inputs with known answers."""

import uuid

from pyspark.sql import functions as F

from logsight.functions import attack, identity, text
from logsight.plans import batch
from logsight.sources import readers, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_entities_of_a_line(spark):
    line = "sshd[42]: Failed password for user Ann@corp from 10.0.0.7 host=web1.example.com path /var/log/app.log pid=42 process=cron"
    assert one(spark, line, text.ips) == ["10.0.0.7"]
    assert one(spark, line, text.users) == ["Ann@corp"]
    assert one(spark, line, text.hosts) == ["web1.example.com"]
    assert one(spark, line, text.files) == ["/var/log/app.log"]
    assert one(spark, line, text.domains) == ["web1.example.com"]
    assert one(spark, line, text.processes) == ["sshd:42", "cron", "42"]
    assert one(spark, None, text.ips) is None and one(spark, "", text.users) == []


def test_mask_template_and_params(spark):
    line = "  login   from 10.0.0.7 id 123E4567-e89b-12d3-a456-426614174000 took 15ms "
    assert one(spark, line, text.mask) == "login from <IP> id <UUID> took 15ms"
    assert one(spark, line, text.template_of) == "login from <IP> id <UUID> took <*>"
    assert one(spark, line, lambda c: text.template_params(c, F.lit("login from <*> id <*> took <*>"))) == ["10.0.0.7", "123E4567-e89b-12d3-a456-426614174000", "15ms"]
    assert one(spark, line, lambda c: text.template_params(c, F.lit("a b"))) == []


def test_syslog_header(spark):
    rows = spark.createDataFrame([("<34>1 x",), ("<999>y",), ("plain",), ("<0>",)], "value string")
    assert [tuple(r[1:]) for r in readers.syslog(rows).collect()] == [(4, 2, 5, "5424"), (1, 5, 2, "3164"), (1, 5, 2, "3164"), (0, 0, 6, "3164")]


def test_ids_are_uuid5(spark):
    spaces = {k: uuid.UUID(v) for k, v in identity.NAMESPACES.items()}
    for kind, raw, name in (("user", "CORP\\Ann", "corp:ann"), ("user", "ann", "ann"), ("ip", "10.0.0.7", "10.0.0.7"), ("host", "Web.Example.", "web.example"), ("file", " /a/b ", "/a/b")):
        assert one(spark, raw, lambda c, k=kind: identity.entity_id(k, c)) == str(uuid.uuid5(spaces[kind], name))
    assert one(spark, "300.1.1.1", lambda c: identity.entity_id("ip", c)) is None
    assert one(spark, "  ", lambda c: identity.entity_id("host", c)) is None


def test_processes_drop_covered_pids(spark):
    got = one(spark, "x", lambda c: identity.process_ids(F.array(F.lit("sshd:42"), F.lit("42"), F.lit("7"))))
    space = uuid.UUID(identity.NAMESPACES["process"])
    assert got == [str(uuid.uuid5(space, "sshd:42")), str(uuid.uuid5(space, "7"))]


def test_sql_functions(spark):
    identity.register(spark)
    assert spark.sql("SELECT uuid5('a1b2c3d4-0001-0000-0000-000000000001', 'ann') AS x").first().x == str(uuid.uuid5(uuid.UUID(identity.NAMESPACES["user"]), "ann"))
    assert spark.sql("SELECT parent_technique('t1053.005') AS x").first().x == "T1053"
    assert spark.sql("SELECT masked('a  10.0.0.1') AS x").first().x == "a <IP>"


def test_tactics(spark):
    assert [one(spark, v, attack.tactic) for v in ("TA0003", "command-and-control", "Nope", None)] == ["persistence", "command_and_control", None, None]
    assert [one(spark, v, attack.parent) for v in ("t1053.005", "T1053", "garbage")] == ["T1053", "T1053", "garbage"]


def test_shapes_and_hosts(spark):
    shapes = {"10.0.0.1": "ip", "::1": "ip", "ann@corp": "user", "a.example": "host", "123e4567-e89b-12d3-a456-426614174000": "uuid", "free words": None, "auth": None}
    assert {v: one(spark, v, text.entity_shape) for v in shapes} == shapes
    assert [one(spark, v, text.synthetic_ip) for v in ("C17693", "C0", "X1", "C16777216")] == ["10.0.69.29", None, None, None]


def test_line_reader(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  \ntwo\n")
    rows = readers.read_lines(spark, str(tmp_path))
    assert sorted(r.value for r in rows.collect()) == ["one", "two"]
    assert all(r.source_id.endswith("a.log") for r in rows.collect())


def test_security_csv(spark, tmp_path):
    (tmp_path / "flows.csv").write_text("1,9,C1,?,C2,80,6,3,100\n2,9,C1,55,C2,?,6,3,100\n")
    got = readers.read_security(spark, str(tmp_path / "flows.csv"), "flow").collect()
    assert [(r.src_port, r.dst_port) for r in got] == [(-1, 80), (55, -1)]


def test_event_table_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "event_id long, timestamp_ns long")
    sinks.write_events(rows, str(tmp_path / "t"))
    assert sorted((r.event_id, r.timestamp_ns) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 5), (2, 7)]


def test_normalise_is_one_projection_without_python(spark):
    rows = spark.createDataFrame([(1, 1, "s", "<34>1 sshd[1]: Failed password for user a from 10.0.0.1")], "event_id long, timestamp_ns long, source_type string, message string")
    plan = batch.normalised(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
