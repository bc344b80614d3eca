"""Readers, views and small writers on files made here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeline.sources import klines, sinks, tables
from tapeline.streaming import candles

T0 = dt.datetime(2024, 1, 1)


def test_read_bars(spark, tmp_path):
    rows = [(s, "15m", T0 + dt.timedelta(days=i), 1.0, 2.0, 0.5, float(i), 1.0) for s in ("BTC-USD", "BTC", "ETH") for i in range(4)]
    spark.createDataFrame(rows, tables.BAR_SCHEMA).withColumn("atr_14", F.lit(0.5)).write.partitionBy("symbol", "timeframe").parquet(f"{tmp_path}/bars")
    df = tables.read_bars(spark, f"{tmp_path}/bars", symbol="BTC-USD", timeframe="15m", start="2024-01-02", end="2024-01-03", indicators=True)
    assert sorted((r.symbol, r.close, r.atr_14) for r in df.collect()) == [("BTC", 1.0, 0.5)] * 2 + [("BTC", 2.0, 0.5)] * 2
    assert [(r.symbol, r.rows) for r in tables.coverage(tables.read_bars(spark, f"{tmp_path}/bars", symbol="ETH")).collect()] == [("ETH", 4)]
    with pytest.raises(ValueError, match="no bars"):
        tables.read_bars(spark, f"{tmp_path}/bars", symbol="XRP", required=True)
    with pytest.raises(ValueError, match="unknown timeframe"):
        tables.read_bars(spark, f"{tmp_path}/bars", timeframe="7m")


def test_results(spark, tmp_path):
    point = {"time": "t", "r": 0.5, "cumulative_r": 0.5, "outcome": "win_tp1"}
    for name, score in (("sfp_BTC_15m", 1.0), ("sfp_ETH_1h", 2.0), ("odd", 3.0)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"strategy": name[:3], "score": score, "oos_equity": [point, point]}, indent=1))
    schema = "strategy string, score double, oos_equity array<struct<time: string, r: double, cumulative_r: double, outcome: string>>"
    df = tables.read_results(spark, f"{tmp_path}/*.json", schema)
    assert tables.equity_rows(df).where("outcome = 'win_tp1'").count() == 6
    named = {r.file: (r.strategy, r.symbol, r.timeframe) for r in tables.named_results(df.drop("strategy")).collect()}
    assert named == {"sfp_BTC_15m.json": ("sfp", "BTC", "15m"), "sfp_ETH_1h.json": ("sfp", "ETH", "1h"), "odd.json": (None, None, None)}
    fixed = df.withColumn("changed", F.when(F.col("score") == 2, F.lit(T0)).otherwise(F.lit(T0 - dt.timedelta(days=1))))
    assert {(r.strategy, r.score) for r in tables.latest_result(fixed, "strategy").collect()} == {("sfp", 2.0), ("odd", 3.0)}


def test_dvol_and_result_documents(spark, tmp_path):
    from tapeline.operators import joins

    ms = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000)
    (tmp_path / "dvol.json").write_text(json.dumps([{"timestamp": ms, "dvol": 50.0}, {"timestamp": ms + 3_600_000, "dvol": 60.0}]))
    dvol = tables.read_dvol(spark, f"{tmp_path}/dvol.json").withColumn("k", F.lit(1))
    bars = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m)) for m in (-1, 0, 59, 60, 5000)], "k int, bar_ts timestamp_ntz")
    got = {r.bar_ts: r.dvol for r in joins.asof(bars, dvol, keys={"k": "k"}, left_time="bar_ts", right_time="ts", columns=["dvol"]).collect()}
    assert [got[T0 + dt.timedelta(minutes=m)] for m in (-1, 0, 59, 60, 5000)] == [None, 50.0, 50.0, 60.0, 60.0]
    rows = [("a", 1.0, [(1, 0.5), (2, 0.7)]), ("b", 2.0, [])]
    df = spark.createDataFrame(rows, "strategy string, score double, windows array<struct<n: int, r: double>>")
    sinks.write_results(df, f"{tmp_path}/out", "strategy")
    sinks.write_results(df.where("strategy = 'b'").withColumn("score", F.lit(9.0)), f"{tmp_path}/out", "strategy")
    back = spark.read.schema("strategy string, score double, windows array<struct<n: int, r: double>>").json(f"{tmp_path}/out").withColumn("file", F.col("strategy"))
    assert {(r.strategy, r.score) for r in back.collect()} == {("a", 1.0), ("b", 9.0)}
    assert [(r.file, r.window, r.n, r.r) for r in tables.result_windows(back).orderBy("n").collect()] == [("a", 0, 1, 0.5), ("a", 1, 2, 0.7)]


def test_klines_through_spark(spark):
    spark.dataSource.register(klines.KlineSource)
    df = spark.read.format("klines").options(provider="tests.klines_provider:fetch", symbols="A,B", start="0", end="10000", slice="5000", page="2", timeframe="1m").load()
    assert df.count() == 20 and df.select("symbol", "bar_ts").distinct().count() == 20 and {r.timeframe for r in df.collect()} == {"1m"}


def test_views_and_closing(spark):
    rows = [("a", "s", "BTC", "LONG", T0, T0 + dt.timedelta(hours=1), 100.0, 110.0, 1.0, 10.0, "win_tp1", 1.0, 0.1, 3, False), ("b", "s", "BTC", "short", T0, None, 100.0, None, None, None, None, None, None, None, True)]
    kind = "trade_id string, strategy string, symbol string, direction string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, r_multiple double, pnl_pct double, outcome string, mfe double, mae double, bars_held int, is_open boolean"
    df = spark.createDataFrame(rows, kind)
    sinks.create_views(df)
    assert [(r.strategy, r.total_trades) for r in spark.table("v_strategy_performance").collect()] == [("s", 1)]
    assert spark.table("v_session_performance").count() == 1 and spark.table("v_monthly_performance").first()["month"] == "2024-01"
    closed = {r.trade_id: r for r in sinks.close_trade(df, "b", 90.0, "2024-01-02 00:00:00").collect()}
    assert closed["b"].pnl_pct == 10.0 and not closed["b"].is_open and closed["a"].pnl_pct == 10.0 and closed["b"].exit_time == T0 + dt.timedelta(days=1)


def test_ticks_to_bars(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(minutes=m), p, 1.0) for m, p in ((0, 5.0), (3, 9.0), (14, 4.0), (15, 7.0), (29, 8.0), (200, 1.0))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double")
    df.write.parquet(f"{tmp_path}/ticks")
    out = candles.ticks_to_bars(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ticks"))
    out.writeStream.format("memory").queryName("bars_of_ticks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_of_ticks").orderBy("bar_ts").collect()]
    assert got == [(5.0, 9.0, 4.0, 4.0, 3.0), (7.0, 8.0, 7.0, 8.0, 2.0)]
