"""Readers, upserts and streams on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from tapeline.operators import joins, simulation
from tapeline.operators import series as se
from tapeline.sources import klines, sinks, tables
from tapeline.streaming import candles

T0 = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="S"):
    rows = [(symbol, "15m", T0 + dt.timedelta(minutes=15 * i), *x) if isinstance(x, tuple) else (symbol, "15m", T0 + dt.timedelta(minutes=15 * i), x, x + 1.0, x - 1.0, x, 1.0) for i, x in enumerate(closes)]
    return spark.createDataFrame(rows, tables.BAR_SCHEMA)


def test_upsert_and_retention(spark, tmp_path):
    path = f"{tmp_path}/bars"
    sinks.upsert(bars(spark, [1.0, 2.0, 3.0]), path)
    sinks.upsert(bars(spark, [9.0, 2.0]).union(bars(spark, [5.0], "T")), path)
    got = {(r.symbol, r.bar_ts): r.close for r in tables.read_bars(spark, path).collect()}
    assert got == {("S", T0): 9.0, ("S", T0 + dt.timedelta(minutes=15)): 2.0, ("S", T0 + dt.timedelta(minutes=30)): 3.0, ("T", T0): 5.0}
    assert [r.close for r in tables.latest(tables.read_bars(spark, path, symbol="S"), 2).collect()] == [2.0, 3.0]
    sinks.upsert(spark.createDataFrame([("S", "15m", T0 + dt.timedelta(days=40), 1.0, 1.0, 1.0, 1.0, 1.0)], tables.BAR_SCHEMA), path)
    sinks.delete_before(spark, path, 30)
    assert spark.read.parquet(path).count() == 1


def test_csv_is_unified(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,strat,r\n1,a,0.5\n2,b,-1\n")
    df = tables.read_csv_trades(spark, f"{tmp_path}/t.csv", "id string, strat string, r double", {"id": "trade_id", "strat": "strategy", "r": "r_multiple"})
    assert len(df.columns) == 20 and [r.r_multiple for r in df.orderBy("trade_id").collect()] == [0.5, -1.0]


def test_klines_page(spark):
    def fetch(symbol, timeframe, start, end, page):
        return [(t, 1.0, 2.0, 0.5, 1.5, 10.0) for t in range((start + 999) // 1000 * 1000, end, 1000)][:page]

    klines.PROVIDERS["memory"] = fetch
    reader = klines.KlineReader({"symbols": "A,B", "start": "0", "end": "10000", "slice": "5000", "page": "2"}, fetch)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 20 and len({(r[0], r[2]) for r in rows}) == 20


def test_stream_ingest_equals_batch(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    df = bars(spark, [1.0, 2.0, 3.0]).withColumn("bar_ts", F.col("bar_ts").cast("timestamp"))
    again = df.withColumn("seq", F.lit(1)).union(df.where("close = 2").withColumn("close", F.lit(9.0)).withColumn("seq", F.lit(2)))
    again.repartition(2).write.parquet(source)

    def run():
        candles.ingest(spark.readStream.schema(again.schema).parquet(source), path, f"{tmp_path}/check", arrival="seq", trigger={"availableNow": True}).awaitTermination(120)
        return sorted(r.close for r in spark.read.parquet(path).collect())

    assert run() == [1.0, 3.0, 9.0]  # the correction replaces the candle
    df.where("close = 3").withColumn("close", F.lit(7.0)).withColumn("seq", F.lit(1)).write.mode("append").parquet(source)
    assert run() == [1.0, 7.0, 9.0] and "seq" not in spark.read.parquet(path).columns


def test_replace_is_finished_after_a_stop(spark, tmp_path):
    import os

    path = f"{tmp_path}/bars"
    bars(spark, [1.0]).write.partitionBy("symbol", "timeframe").parquet(path)
    os.rename(path, f"{path}.old")
    assert sinks.exists(spark, path) and tables.read_bars(spark, path).count() == 1
    os.rename(path, f"{path}.old")
    bars(spark, [5.0, 6.0]).write.partitionBy("symbol", "timeframe").parquet(f"{path}.next")
    sinks.replace(bars(spark, [2.0, 3.0, 4.0]), path, "symbol", "timeframe")
    assert tables.read_bars(spark, path).count() == 3 and os.listdir(tmp_path) == ["bars"]


def guarded(spark, tmp_path, name, values, **options):
    rows = [("a", T0 + dt.timedelta(minutes=i), r) for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, "strategy string, ts timestamp, r_multiple double")
    df.write.parquet(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
    q = candles.drawdown_guard(stream, **options).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
    q.awaitTermination(120)
    return spark.table(name).orderBy("ts").collect()


def test_drawdown_guard(spark, tmp_path):
    got = guarded(spark, tmp_path, "guard", [1.0, -1.0, -1.0, -1.0, 2.0, 2.0], losses=3, cooldown=2)
    assert [r.streak for r in got] == [0, 1, 2, 3, 0, 0] and [r.paused for r in got] == [False, False, False, True, True, False] and got[3].overall_dd == 3.0


def test_guard_pauses_anew_and_breakeven_is_no_loss(spark, tmp_path):
    # the streak goes on through the pause: it is lifted at the second trade after it and renewed by the same trade
    got = guarded(spark, tmp_path, "renewed", [-1.0] * 7 + [1.0, 1.0, 0.0, 0.0, 0.0], losses=3, cooldown=2)
    assert [r.paused for r in got] == [False, False, True, True, True, True, True, True, False, False, False, False]
    assert [r.reason for r in got][2:8] == ["streak"] * 6 and [r.streak for r in got][-3:] == [0, 0, 0]
    # a fall within the window, counted from its own first trade
    got = guarded(spark, tmp_path, "window", [5.0, -1.0, -1.0, -2.0, 4.0], window=3, limit=3.0, losses=9, cooldown=1)
    assert [r.reason for r in got] == ["", "", "", "window", ""] and [r.window_dd for r in got] == [0.0, 1.0, 2.0, 3.0, 2.0]


def test_ewm_blocks_agree(spark):
    df = bars(spark, [float((i * 37) % 11) for i in range(50)])
    one, many = (se.ewm(df, {"y": ("close", 0.1)}, block=b).orderBy("bar_ts").collect() for b in (1000, 7))
    y = None
    for a, b in zip(one, many, strict=True):
        y = a.close if y is None else 0.9 * y + 0.1 * a.close
        assert abs(a.y - y) < 1e-9 and abs(b.y - y) < 1e-9


def test_causal_swings_do_not_change_with_later_bars(spark):
    closes = [float((i * 37) % 11) for i in range(40)]
    short, long = (se.swings(bars(spark, c)).orderBy("bar_ts").collect() for c in (closes[:30], closes))
    assert short == long[:30]


def test_walk_stop_and_ties(spark):
    path = [(10.0, 10.0, 10.0, 10.0, 1.0), (10.0, 12.5, 8.5, 10.0, 1.0), (10.0, 11.0, 9.5, 10.0, 1.0)]
    b = bars(spark, path)
    signal = spark.createDataFrame([("S", "15m", T0, "LONG", 10.0, 9.0, 11.0, 12.0, 1.0)], "symbol string, timeframe string, bar_ts timestamp_ntz, direction string, entry double, sl double, tp1 double, tp2 double, risk double")
    free = simulation.Costs(0, 0, 0)
    a = simulation.walk(b, signal, costs=free).collect()[0]
    assert (a.outcome, a.r_multiple, a.bars_held) == ("loss", -1.0, 1)
    c = simulation.walk(b, signal, costs=free, tie_rule="tp1_first").collect()[0]
    assert (c.outcome, c.r_multiple) == ("breakeven", 0.0)


SIGNAL = "symbol string, timeframe string, bar_ts timestamp_ntz, direction string, entry double, sl double, tp1 double, tp2 double, risk double"


def hourly(spark, rows):
    return spark.createDataFrame([("S", "1h", T0 + dt.timedelta(hours=i), *r, 1.0) for i, r in enumerate(rows)], tables.BAR_SCHEMA)


def test_walk_follows_a_trade_to_the_reference_limit(spark):
    flat, low = (10.0, 10.5, 9.5, 10.2), (10.0, 10.5, 8.0, 8.5)
    free = simulation.Costs(0, 0, 0)
    for start, after, want in ((0, 30, ("loss", 30)), (600, 671, ("loss", 671)), (600, 672, ("timeout", 671)), (1350, 40, ("timeout", 20))):
        n = 1371 if start == 1350 else start + 800
        b = hourly(spark, [low if i == start + after else flat for i in range(n)])
        signal = spark.createDataFrame([("S", "1h", T0 + dt.timedelta(hours=start), "LONG", 10.0, 9.0, 11.0, 12.0, 1.0)], SIGNAL)
        got = simulation.walk(b, signal, costs=free).collect()
        assert [(r.outcome, r.bars_held, r.exit_time) for r in got] == [(*want, T0 + dt.timedelta(hours=start + want[1]))]
        assert abs(got[0].r_multiple - (-1.0 if want[0] == "loss" else 0.2)) < 1e-9


def test_walk_forward_trains_on_whole_trades_and_not_on_the_test_range(spark):
    # every 40 bars a dip that closes back inside; the stop below it is hit 30 bars later only
    def path(n, end):
        rows = [(10.0, 10.1, 9.9, 10.0)] * n
        for i in range(30, n, 40):
            rows[i] = (10.0, 10.1, 9.5, 9.95)
            rows[i + 30 : i + 31] = [(10.0, 10.1, 9.0 if i < end else 9.9, 10.0)]
        return rows[:n]

    def run(rows, **more):
        return {r.window: r for r in simulation.walk_forward(hourly(spark, rows), [{"back": 20}], train=300, test=100, step=100, least=1, **more).collect()}

    rows = path(520, 520)
    a, changed = run(rows, embargo=20), run(rows[:320] + [(10.0, 30.0, 9.95, 10.0)] * 200, embargo=20)
    assert a[0].is_r == changed[0].is_r
    assert a[0].is_r < -0.9  # stops 30 bars on are in the score
    assert run(rows) == {}  # the reference's embargo leaves no window in so few bars
    assert set(run(path(1100, 1100))) == {0}


def test_correlations_and_dates_take_every_label(spark):
    rows = [(s, f"d{i}", r) for s, values in {"new": [1.0, 2.0, 3.0, 9.0], "click": [2.0, 4.0, 6.0], "x": [3.0, 1.0, -1.0], "y": [1.0, 5.0, 1.0]}.items() for i, r in enumerate(values)]
    daily = spark.createDataFrame(rows, "strategy string, day string, r double")
    got = {(r.a, r.b): (r.corr, r.flag) for r in joins.pair_correlations(joins.overlap_long(daily, outer=False)).collect()}
    assert got == {("click", "new"): (1.0, "high"), ("click", "x"): (-1.0, "high"), ("new", "x"): (-1.0, "high"), ("click", "y"): (0.0, "low"), ("new", "y"): (0.0, "low"), ("x", "y"): (0.0, "low")}
    filled = {(r.day, r.strategy): r.r for r in joins.overlap_long(daily, outer=True).collect()}
    assert len(filled) == 16 and filled[("d3", "new")] == 9.0 and filled[("d3", "click")] == 0.0


def test_matching_is_one_to_one(spark):
    kind = "k string, id string, bar long"
    live = spark.createDataFrame([("a", "l1", 10), ("a", "l2", 11), ("a", "l3", 50)], kind)
    shadow = spark.createDataFrame([("a", "s1", 11), ("a", "s2", 20), ("a", "s3", 80)], kind)
    got = {(r.live_id, r.shadow_id, r.kind) for r in joins.match_one_to_one(live, shadow, keys=["k"], most=9).collect()}
    assert got == {("l1", "s1", "matched"), ("l2", "s2", "matched"), ("l3", None, "missed"), (None, "s3", "phantom")}


def test_validation_repairs(spark):
    nan = float("nan")
    rows = [("S", "15m", T0 + dt.timedelta(minutes=15 * i), o, h, low, 1.5, v) for i, (o, h, low, v) in enumerate([(nan, 2.0, 1.0, 5.0), (1.2, 0.5, 1.0, -100.0), (nan, 2.0, 1.0, nan)])]
    rows.append(("S", "15m", T0 + dt.timedelta(days=1), 1.0, 2.0, 1.0, 1.5, 1.0))
    got = se.validated(spark.createDataFrame(rows, tables.BAR_SCHEMA)).orderBy("bar_ts").collect()
    assert [r.open for r in got] == [1.2, 1.2, 1.2, 1.0] and got[1].high == 1.5 and got[1].volume == 100.0 and got[2].volume == 0.0 and [r.gap for r in got] == [False, False, False, True]
