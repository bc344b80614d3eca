"""Long series of GARCH: stretches that bring what lies before them along, and one pass a round."""

import random

import pytest

from tapeline.operators import volatility as v


def test_long_series_are_one_pass_a_round(spark, monkeypatch):
    rng, h, rows = random.Random(5), 1.0, []
    for i in range(6000):
        x = rng.gauss(0, 1) * h**0.5
        h = 0.1 + 0.1 * x * x + 0.8 * h
        rows.append(("s", i, x))
    df = spark.createDataFrame(rows, "strategy string, entry_time long, r_multiple double").repartition(3)
    monkeypatch.setattr(v, "STRETCH", 1024, raising=False)
    short = v.garch_fit(df, most=6).collect()[0]

    def long(most):
        spark.sparkContext.setJobGroup(f"rounds-{most}", "")
        got = v.garch_fit(df, most=most, whole=100, block=128).collect()[0]
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{most}"))

    (few, a), (got, b) = long(2), long(6)
    for c in ("omega", "alpha", "beta", "log_likelihood"):
        assert got[c] == pytest.approx(short[c], rel=1e-9)
    assert (few.rounds, got.rounds) == (2, 6)
    assert b - a <= 3 * 4  # three jobs a round at most
