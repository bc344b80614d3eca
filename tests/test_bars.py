"""Small cases of the bar rules, from their formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.operators import series as s
from tapeline.operators import sequences, trades
from tapeline.sources import tables

T0 = dt.datetime(2024, 1, 1)


def bars(spark, rows):
    return spark.createDataFrame([("S", "15m", T0 + dt.timedelta(minutes=15 * i), *map(float, r)) for i, r in rows], tables.BAR_SCHEMA)


def test_regime_boundaries(spark):
    rows = [("S", "15m", T0 + dt.timedelta(minutes=15 * i), i + 1, 10.0, 0.1 if i < 58 else 0.5, 40.0, 10.0 if i < 55 else 9.0) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, bar_ts timestamp_ntz, bar_no int, close double, atr double, adx double, ema_50 double")
    got = [r.x for r in df.select("bar_ts", s.regime(df).alias("x")).orderBy("bar_ts").collect()]
    assert got[:50] == ["unknown"] * 50 and got[50:55] == ["trending_down"] * 5 and got[55:58] == ["trending_up"] * 3 and got[58:] == ["volatile"] * 2


def test_validation_fills_before_it_drops_repeats(spark):
    nan = float("nan")
    df = bars(spark, [(0, (9, 12, 8, 11, 1)), (1, (10, 12, 8, 11, 1)), (1, (nan, 12, 8, 11, 1)), (2, (9, 5, 8, 11, -100)), (3, (9, 12, 11, 10, nan))]).withColumn("seq", F.monotonically_increasing_id())
    got = {(r.bar_ts - T0).seconds // 900: r for r in s.validated(df, arrival="seq").collect()}
    assert got[1].open == 10.0  # the later row of its time, filled from the earlier one
    assert (got[2].high, got[2].volume, got[3].low, got[3].volume) == (11.0, 100.0, 9.0, 0.0)
    issues = s.bar_issues(df, arrival="seq").first()
    assert (issues.missing, issues.infinite, issues.missing_volume, issues.negative_volume, issues.low_highs, issues.high_lows, issues.repeated, issues.gaps) == (1, 0, 1, 1, 1, 1, 1, 0)
    with pytest.raises(ValueError, match="not clean"):
        s.validated(df, arrival="seq", strict=True)
    assert s.validated(df.limit(1), strict=True).count() == 1 and s.validated(df.limit(0)).count() == 0


def test_sweep_needs_a_clean_bar_before_and_depth(spark):
    flat = (100, 101, 99, 100, 1)
    sweep, shallow = (100, 101, 97, 100, 1), (100, 101, 98.79, 100, 1)  # true ranges are about 2, so a tenth of one is 0.2

    def sides(*last):
        rows = [flat] * 30 + list(last)
        return [(r.side, r.level) for r in s.sweeps(bars(spark, enumerate(rows))).collect()]

    assert sides(sweep) == [("low", 99.0)]
    assert sides((100, 101, 98, 99.5, 1), sweep) == [("low", 99.0)]  # the bar before is a sweep itself, and not clean for the next
    assert sides(shallow) == [("low", 99.0)] and sides((100, 101, 98.81, 100, 1)) == []


def test_flat_bar_closes_in_the_middle(spark):
    from tapeline.operators import market

    df = s.indicators(bars(spark, [(i, (5, 5, 5, 5, 1)) for i in range(3)]))
    got = market.market_features(df).collect()
    assert {r.close_vs_range for r in got} == {0.5} and {r.momentum_5 for r in got} == {None} and {r.candle_streak for r in got} == {0.0}


def test_recovery_and_rolling_drawdown(spark):
    rs = [1.0, -2.5, 0.5, 2.5, -1.0, -1.0]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), r, "loss" if r < 0 else "win") for i, r in enumerate(rs)], "strategy string, entry_time timestamp_ntz, r_multiple double, outcome string")
    got = {r.threshold: (r.n, r.recovered, r.mean_trades, r.max_trades) for r in sequences.recovery(df).collect()}
    assert got == {1.0: (2, 1, 2.0, 2), 2.0: (2, 1, 2.0, 2), 5.0: (0, 0, None, None), 10.0: (0, 0, None, None)}
    worst = trades.rolling_drawdown(df, "strategy", sizes=(2, 3)).collect()
    assert {r.window: r.max_dd for r in worst} == {2: 2.5, 3: 2.5}  # a window that begins with the loss does not count it
    limits = sequences.calibrated_limits(df).first()
    assert (limits.n, limits.raw_drawdown, limits.drawdown_limit, limits.streak_limit, limits.cooldown, limits.confidence) == (6, 2.5, 3.0, 3, 3, "low")


def test_change_points_and_half_life(spark):
    rs = [0.1, -0.1] * 40 + [3.0, 2.8] * 40
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), r) for i, r in enumerate(rs)], "strategy string, entry_time timestamp_ntz, r_multiple double")
    got = sequences.change_points(df).first()
    mu = sum(rs) / len(rs)
    sd = (sum((r - mu) ** 2 for r in rs) / (len(rs) - 1)) ** 0.5
    up = down = 0.0
    alarms = []
    for i, r in enumerate(rs[1:], 1):
        up, down = max(0.0, up + r - mu - 0.5 * sd), max(0.0, down - (r - mu + 0.5 * sd))
        if up > 5 * sd or down > 5 * sd:
            alarms.append(i)
            up = down = 0.0
    assert got.changes == ",".join(map(str, alarms)) and got.n_changes == len(alarms) > 0
    assert sequences.edge_half_life(df.limit(8)).first().half_life is None
