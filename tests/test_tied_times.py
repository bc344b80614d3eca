"""Trades of one time against each query's own SQL: sums take them as peers, and where an order is needed it is that of their ids."""

import random

import duckdb
import pytest

from tapeline.plans import catalog

from .test_queries import text


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    where, rng = tmp_path_factory.mktemp("tied"), random.Random(3)
    rows = [(f"2024-01-0{rng.randint(1, 3)} 00:{rng.randint(0, 19):02}:00", rng.randint(0, 9), f"s{rng.randint(0, 1)}", round(rng.expovariate(1 / 50), 2)) for _ in range(600)]
    rows.sort(key=lambda r: r[0])  # SQL leaves the order of ties open; DuckDB keeps that of rows which come in order of time
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    c.sql(f"COPY events TO '{where}/events.parquet' (FORMAT parquet)")
    return c, str(where)


@pytest.mark.parametrize("name", ["w22_drawdown_episodes", "w13_loss_streaks", "w19_equity", "t1_significance", "w36_change_points"])
def test_tied_times(spark, tied, name):
    duck, where = tied
    got, want = catalog.QUERIES[name](spark, where).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert text(got, cols) == text(want, cols)
