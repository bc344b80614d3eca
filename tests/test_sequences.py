"""Order-dependent statistics against plain loops."""

import datetime as dt
import math

import pytest

from tapeline.operators import sequences as s


def trades_of(spark, values):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, str(i), start + dt.timedelta(minutes=i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "strategy string, trade_id string, entry_time timestamp_ntz, r_multiple double")


def test_kalman_edge_past_thousands_of_trades(spark):
    values = {"slow": [math.sin(i / 900) for i in range(6000)], "flat": [0.5] * 40, "rough": [(-1.0) ** i * (i % 7) for i in range(3000)], "one": [2.0]}
    got = {}
    for r in s.kalman_edge(trades_of(spark, values)).collect():
        got[r.strategy, r.no] = (r.edge, r.high)
    for key, xs in values.items():
        n = len(xs)
        mu, d = sum(xs) / n, [b - a for a, b in zip(xs, xs[1:])]
        v = sum((x - mu) ** 2 for x in xs) / n
        dv = sum((x - sum(d) / len(d)) ** 2 for x in d) / len(d) if d else 0.0
        q = max(1e-6, dv / 2)
        rr = max(0.1 * v, v - q) if v > 0 else 1e-6
        edge, p = xs[0], v if v > 0 else 1.0
        for i, x in enumerate(xs, 1):
            if i > 1:
                k = (p + q) / (p + q + rr)
                edge, p = edge + k * (x - edge), (1 - k) * (p + q)
            assert got[key, i] == pytest.approx((edge, edge + 2 * math.sqrt(p)), abs=1e-9)
