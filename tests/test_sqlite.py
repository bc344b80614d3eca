"""SQLite tables through Spark: partitions, filters that reach the file, odd values."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from tapeline.sources import sqlite


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    name = str(tmp_path_factory.mktemp("db") / "trades.db")
    with sqlite3.connect(name) as db:
        db.execute('CREATE TABLE ml_training_data (trade_id TEXT, strategy_name TEXT, risk_reward_actual REAL, bars INTEGER, outcome TEXT, "odd ""name" BLOB)')
        rows = [(f"t{i}", f"s{i % 3}", i / 10, i, None if i % 5 == 0 else "win", b"x") for i in range(30_000)]
        rows += [(None, None, None, None, None, None), ("odd", "s", "text in a number", 7.5, "win", "text in a blob"), (5, 6, 3, 2, "loss", None)]
        db.executemany("INSERT INTO ml_training_data VALUES (?, ?, ?, ?, ?, ?)", rows)
        db.execute("DELETE FROM ml_training_data WHERE bars BETWEEN 100 AND 9999")  # holes in the rowids
        db.execute("CREATE TABLE empty (a INTEGER, b TEXT)")
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v REAL) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?, ?)", [("a", 1.0), ("b", None)])
    return name


def test_read_in_several_tasks(spark, path):
    df = sqlite.read_table(spark, path, "ml_training_data", partitions=6)
    assert dict(df.dtypes) == {"trade_id": "string", "strategy_name": "string", "risk_reward_actual": "double", "bars": "bigint", "outcome": "string", 'odd "name': "binary"}
    assert df.rdd.getNumPartitions() == 6 and df.count() == 30_003 - 9900
    assert df.agg(F.sum("bars")).first()[0] == sum(range(100)) + sum(range(10_000, 30_000)) + 2
    odd = {r.trade_id: r for r in df.where("trade_id IN ('odd', '5')").collect()}
    assert odd["odd"].risk_reward_actual is None and odd["odd"].bars is None and odd["odd"]['odd "name'] is None and odd["5"].risk_reward_actual == 3.0 and odd["5"].strategy_name == "6"


def test_filters_reach_the_file(spark, path):
    reader = sqlite.SqliteReader({"path": path, "table": "ml_training_data"}, sqlite.SqliteSource({"path": path, "table": "ml_training_data"}).schema())
    rest = list(reader.pushFilters([GreaterThan(("bars",), 29_990), In(("bars",), (29_991, 29_995, 1)), EqualTo(("trade_id",), "t29995"), IsNotNull(("outcome",))]))
    assert [type(f) for f in rest] == [EqualTo] and len(reader.where) == 3
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in got] == ["t29991"]  # t29995 has no outcome
    df = sqlite.read_table(spark, path, "ml_training_data", columns=["trade_id", "bars"]).where("bars >= 29998 AND trade_id <> 't29998'")
    assert [tuple(r) for r in df.collect()] == [("t29999", 29_999)] and df.columns == ["trade_id", "bars"]


def test_training_rows_empty_and_keyed_tables(spark, path):
    df = sqlite.read_training(spark, path)
    assert {"strategy", "r_multiple", "outcome"} <= set(df.columns) and df.where("outcome IS NULL").count() == 0 and df.count() == 80 + 16_000 + 2
    assert sqlite.read_table(spark, path, "empty").collect() == [] and sorted(map(tuple, sqlite.read_table(spark, path, "keyed").collect())) == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="no table"):
        sqlite.read_table(spark, path, "missing").collect()
