"""Registered queries on ids that have more digits than those of the given tables."""

import duckdb
import pytest

from logsight.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("shift", [0, 9_990])
def test_ipv6_of_large_users(spark, sf_dir, tmp_path, shift):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (user_id + {shift} AS user_id) FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = sorted(con.execute(ORACLE_SQL["e13_ipv6"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["e13_ipv6"](spark, str(tmp_path)).collect())
    assert got == wanted
    malformed = sum(r[1] is None for r in got)
    assert malformed > 0 if shift else malformed == 0
