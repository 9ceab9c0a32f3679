"""Rule packs from tables, SQL functions against their column forms, text files with binary ones among them."""

import pytest
from pyspark.sql import functions as F

from logsight.functions import identity, text
from logsight.operators import correlate, rules
from logsight.sources import readers

SELECTIONS = "map<string, array<struct<field: string, modifiers: array<string>, values: array<string>>>>"


def test_rule_pack_from_a_table(spark):
    part = lambda *values: [("CommandLine", ["contains"], list(values))]
    rows = [
        ("r1", "One", "high", {"a1": part("x"), "a2": part("y"), "a3": part("z")}, "2 of a*", ["attack.t1110"], True),
        ("r2", "Two", "low", {"a": part("x"), "b": part("q")}, "a and not b", None, None),
        ("r3", "Off", "low", {"a": part("x")}, "a", None, False),
        ("r1", "Again", "low", {"a": part("nothing")}, "a", None, True),
    ]
    table = spark.createDataFrame(rows, f"rule_id string, title string, level string, selections {SELECTIONS}, condition string, tags array<string>, enabled boolean")
    pack = rules.rule_pack(table.collect())
    assert [(r.rule_id, r.title, r.enabled) for r in pack] == [("r1", "One", True), ("r2", "Two", True), ("r3", "Off", False)]
    events = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "x q z"), (4, "x y z q")], "event_id long, message string").withColumns({c: F.lit("") for c in ("category", "product", "service")})
    found = rules.rule_matches(events, pack).select("event_id", "rule_id").collect()
    assert sorted(map(tuple, found)) == [(1, "r1"), (1, "r2"), (2, "r2"), (3, "r1"), (4, "r1")]


def test_correlation_pack_from_a_table(spark):
    kind = "array<struct<source_type: string, min_count: int, patterns: map<string, string>>>"
    rows = [("brute", "user", 600, 2, 5, [("syslog", 2, {"message": "failed"}), ("syslog", None, {"message": "accepted"})], ["credential-access"])]
    pack = correlate.correlation_pack(spark.createDataFrame(rows, f"name string, entity_type string, window_seconds int, min_sources int, severity int, conditions {kind}, tactics array<string>").collect())
    assert pack == [correlate.CorrelationRule("brute", "user", 600, 2, 5, (correlate.Condition("syslog", 2, {"message": "failed"}), correlate.Condition("syslog", 1, {"message": "accepted"})), ("credential-access",))]
    second = 10**9
    events = spark.createDataFrame([(1, 0, "failed"), (2, second, "failed"), (3, 5 * second, "accepted"), (4, 700 * second, "accepted")], "event_id long, timestamp_ns long, message string")
    events = events.withColumns({"entity": F.lit("ann"), "entity_type": F.lit("user"), "source_type": F.lit("syslog")})
    assert [(r.event_id, r.n_events) for r in correlate.correlate(events, pack[0]).collect()] == [(3, 3)]


TEXTS = [
    "a  10.0.0.1\tb", "v11.2.3.45x stays", "id 123E4567-e89b-12d3-a456-426614174000.", " 256.1.1.1 1.2.3.4.5 \x0b x", "x" * 9000 + " 10.0.0.1", "", None, "  wide",
]


def test_sql_mask_equals_the_column_form(spark):
    identity.register(spark)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "s string").select(text.mask(F.col("s")).alias("own"), F.expr("masked(s)").alias("sql")).collect()
    assert [r.own for r in rows] == [r.sql for r in rows]


@pytest.mark.parametrize("address", ["::1", "2001:DB8::1", "fe80:0:0:0:1:2:3:4", "::ffff:10.1.2.3", "1::2::3", "12345::", "::", "1:2:3", "x", "", "1:2:3:4:5:6:7:8:9", " ::A ", "1:2:3:4:5:6:7::", None])
def test_sql_ipv6_equals_the_column_form(spark, address):
    identity.register(spark)
    row = spark.createDataFrame([(address,)], "s string").select(identity.exploded_ipv6(F.col("s")).alias("own"), F.expr("full_ipv6(s)").alias("sql")).first()
    assert row.own == row.sql


def test_binary_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    (tmp_path / "b.log").write_bytes(b"fine\nbad\x00line\nfine too\n")
    assert sorted(r.value for r in readers.read_lines(spark, str(tmp_path)).collect()) == ["one", "two"]
