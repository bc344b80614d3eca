"""Resampled paths against exact laws: whole blocks, binomial walks, the gambler's ruin."""

import datetime as dt
import math
import random

import pytest

from tapeline.operators import resampling as rs

T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, parts=4):
    rows = [(k, T0 + dt.timedelta(minutes=i), x) for k, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "strategy string, entry_time timestamp_ntz, r_multiple double").repartition(parts)


def fall(xs):
    c, top, worst = 0.0, -math.inf, 0.0
    for x in xs:
        c += x
        top = max(top, c)
        worst = max(worst, top - c)
    return worst


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return {"coin": [1.0, -1.0] * 150, "noise": [round(rng.gauss(0.1, 1), 3) for _ in range(333)], "few": [1.0, 2.0], "none": [None] * 9}


def test_whole_block_is_the_series(spark, values):
    xs = values["noise"]
    df = frame(spark, {"noise": xs})
    got = rs.resampled_paths(df, rounds=20, size=len(xs)).collect()
    for r in got:
        assert r.final_r == pytest.approx(sum(xs)) and r.max_drawdown == pytest.approx(fall(xs)) and r.win_rate == pytest.approx(sum(x > 0 for x in xs) / len(xs))
        loss = -sum(x for x in xs if x < 0)
        assert r.profit_factor == pytest.approx((sum(xs) + loss) / loss) and r.expectancy == pytest.approx(r.mean_r)
    bands = rs.equity_fan(df, rounds=20, size=len(xs)).orderBy("trade").collect()
    assert [b.p5 for b in bands] == pytest.approx([sum(xs[: i + 1]) for i in range(len(xs))])


@pytest.mark.parametrize("size", [1, 7])
def test_paths_and_bands_agree_for_any_partitioning(spark, values, size):
    one, two = (frame(spark, values, p) for p in (1, 7))
    opts = dict(rounds=700, size=size, steps=64)
    paths = [sorted(map(tuple, rs.resampled_paths(d, tasks=t, **opts).collect())) for d, t in ((one, 1), (two, 5))]
    assert paths[0] == paths[1] and {p[0] for p in paths[0]} == {"coin", "noise"} and len(paths[0]) == 1400
    bands = [sorted(map(tuple, rs.equity_fan(d, tasks=t, **opts).collect())) for d, t in ((one, 1), (two, 5))]
    assert bands[0] == bands[1] and len(bands[0]) == 300 + 333
    # the last band is that of the paths' ends
    ends = sorted(p[2] for p in paths[0] if p[0] == "noise")
    last = next(b for b in bands[0] if b[0] == "noise" and b[1] == 333)
    assert last[4] == pytest.approx((ends[349] + ends[350]) / 2)


def test_coin_walk_follows_the_binomial_law(spark, values):
    df = frame(spark, {"coin": values["coin"]})
    bands = {b.trade: b for b in rs.equity_fan(df, rounds=10_000).collect()}
    for t in (1, 50, 300):
        law, upto = [], 0.0
        for k in range(t + 1):
            upto += math.comb(t, k) / 2**t
            law.append((upto, 2 * k - t))
        for share, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95")):
            near = [v for p, v in law if abs(p - share) < 0.012] + [next(v for p, v in law if p >= share)]
            assert min(near) - 2 <= bands[t][name] <= max(near) + 2
    r = rs.path_intervals(df).collect()[0]
    assert r.paths == 10_000 and abs(r.mean_r_low + 1.96 / 300**0.5) < 0.01 and r.win_rate_low < 0.5 < r.win_rate_high and 7 <= r.max_drawdown_low < r.max_drawdown_high
    s = rs.fan_summary(df).collect()[0]
    assert s.final_p5 == bands[300].p5 and s.final_p95 == bands[300].p95 and s.fall_median < s.fall_p95


def test_ruin_by_the_gamblers_formula(spark):
    """Steps of equal size in the log: ruin within the horizon against the reflection principle's sum by dynamic programming."""
    f, p = 0.2, 0.45
    up, down = math.exp(f) - 1, math.exp(-f) - 1
    df = frame(spark, {"g": [up] * 45 + [down] * 55, "safe": [1.0] * 20})
    got = {r.strategy: r for r in rs.ruin_chances(df, risk=1.0, ruin=math.exp(-f * 5.5), trades_ahead=300).collect()}
    law, ruined, at = {0: 1.0}, 0.0, {}
    for t in range(1, 301):
        new = {}
        for x, c in law.items():
            for y, q in ((x + 1, p), (x - 1, 1 - p)):
                if y < -5:
                    ruined += c * q
                else:
                    new[y] = new.get(y, 0.0) + c * q
        law, at[t] = new, ruined
    assert abs(got["g"].p_ruin - at[300]) < 0.015 and abs(got["g"].p_ruin_100 - at[100]) < 0.02 and got["safe"].p_ruin == 0.0 and got["safe"].median_trades_to_ruin is None
    assert abs(got["safe"].capital_median / (10_000 * 2.0**300) - 1) < 1e-9


def test_kelly(spark):
    df = frame(spark, {"k": [2.0] * 40 + [-1.0] * 60, "up": [1.0] * 30})
    got = {r.strategy: r for r in rs.kelly_bounds(df).collect()}
    assert got["k"].kelly == pytest.approx(0.4 - 0.6 / 2) and got["k"].low_95 < got["k"].low_80 < got["k"].kelly < got["k"].high_80 < got["k"].high_95
    sd = 1.5 * (0.4 * 0.6 / 100) ** 0.5  # the fraction is linear in the win rate here
    assert abs(got["k"].high_95 - got["k"].low_95 - 2 * 1.96 * sd) < 0.03 and got["up"].kelly == 0.0 and got["k"].half_kelly == pytest.approx(0.05)


def test_empty(spark, values):
    none = frame(spark, values).limit(0)
    for f in (rs.path_intervals, rs.equity_fan, rs.ruin_chances, rs.kelly_bounds):
        assert f(none).collect() == []
