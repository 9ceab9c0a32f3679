"""Contributing events by stretches of ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsight.operators import query as q


@pytest.mark.parametrize("ids", ["long", "string"])
def test_hydrate_against_plain(spark, ids):
    rng = np.random.default_rng(2)
    cast = int if ids == "long" else str
    events = [(i, int(rng.integers(0, 1000)), f"u{rng.integers(0, 3)}", "s") for i in [*range(-40, 700), 2**63 - 1, -(2**63)]]
    lists = [[], None, list(range(-30, 600)), [5, 4, 3, 4, 5, 6, 6, None, 7], [2**63 - 1, -(2**63), 9999], *([int(x) for x in rng.integers(0, 700, 40)] for _ in range(8))]
    alerts = [(f"a{i}", int(rng.integers(0, 1000)), f"u{i % 3}" if i != 6 else None, x) for i, x in enumerate(lists)]
    wanted = []
    for a, t, who, own in alerts:
        met = [e for x in own or [] for e in events if e[0] == x and e[2] == who and abs(e[1] - t) <= 300]
        wanted += [(a, cast(e[0])) for e in sorted(met, key=lambda e: (-e[1], e[0] if ids == "long" else str(e[0])), reverse=False)] if len(met) <= 16 else [(a, cast(e[0])) for e in sorted(met, key=lambda e: (e[1], cast(e[0])))[::-1][:16]]
    df = spark.createDataFrame(events, "event_id long, timestamp_ns long, entity string, source_type string").withColumn("event_id", F.col("event_id").cast(ids))
    al = spark.createDataFrame(alerts, "alert_id string, timestamp_ns long, entity_value string, contributing_events array<long>").withColumn("contributing_events", F.col("contributing_events").cast(f"array<{ids}>"))
    got = q.hydrate(al, df, span=300).select("alert_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_stretches_are_joined_whole(spark):
    """An alert of 400 following ids has at most three rows before the join."""
    ids = spark.range(1).select(F.sequence(F.lit(1000), F.lit(1400)).alias("c"))
    assert [tuple(r) for r in ids.select(F.inline(q._runs(F.col("c")))).collect()] == [(1000, 1400)]
