"""T-19 where the assets' means cancel, against the query's own SQL."""

import duckdb
import pytest

from tapeline.plans import catalog

TIMES = [f"2024-01-0{d} 0{h}:00:00" for d in (1, 2) for h in range(5)]


def test_means_that_cancel(spark, tmp_path):
    rows = []
    for kind, shift in (("cancel", (25.0, -25.0)), ("gain", (25.0, 20.0))):
        for user, by in enumerate(shift):
            for i, ts in enumerate(TIMES):
                step = -0.9 * i if by < 0 else 0.9 * i
                rows.append((len(rows), ts, user, kind, 50.0 + by + step))
    c = duckdb.connect()
    c.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    c.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = {r[0]: r for r in c.sql(catalog.ORACLE_SQL["t19_robustness"]).fetchall()}
    got = {r[0]: tuple(r) for r in catalog.QUERIES["t19_robustness"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() == {"cancel", "gain"}
    assert got["cancel"][2] == 0.0
    for k in got:
        assert got[k][:2] == want[k][:2] and got[k][7] == want[k][7]
        assert got[k][2:7] == pytest.approx(want[k][2:7], abs=1e-9)
