"""Profiles of an edge against plain loops, and correlations of constant series."""

import numpy as np
import pytest

from tapeline.functions.metrics import correlation
from tapeline.operators import joins, profiles, sequences
from tapeline.operators import trades as t
from pyspark.sql import functions as F

KIND = "trade_id string, strategy string, entry_time timestamp, exit_time timestamp, regime string, r_multiple double, mfe double, mae double, bars_held int, outcome string"


def made(n=700, keys=("A", "B"), seed=3):
    import datetime as dt

    rng, rows = np.random.default_rng(seed), []
    for k in keys:
        for i in range(n):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i)
            r = float(round(rng.normal(0.05, 1), 4))
            rows.append((f"{k}{i:05}", k, at, at, ("up", "down", "flat", None)[int(rng.integers(4))], r, abs(r), -float(rng.integers(1, 5)) / 10, int(rng.integers(1, 40)), "win" if r > 0 else "loss"))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), KIND).repartition(5)


def test_steps_and_law(rows):
    want = {}
    for k in "AB":
        names = [r[4] or "unknown" for r in made() if r[1] == k]
        for a, b in zip(names, names[1:]):
            want[k, a, b] = want.get((k, a, b), 0) + 1
    steps = profiles.regime_steps(rows)
    assert {(r.strategy, r.from_regime, r.to_regime): r.n for r in steps.collect()} == want
    law = {(r.strategy, r.regime): r.law for r in profiles.stationary(steps).collect()}
    for k in "AB":
        names = sorted({a for key, a, _ in want if key == k})
        m = np.array([[want.get((k, a, b), 0) for b in names] for a in names], float)
        at = np.ones(len(names)) / len(names)
        for _ in range(200):
            at = at @ (m / m.sum(1, keepdims=True))
        assert np.allclose(at, [law[k, a] for a in names], atol=1e-9)


def test_last_regime_keeps_to_itself(spark):
    law = {r.regime: r.law for r in profiles.stationary(spark.createDataFrame([("A", "x", "x", 3), ("A", "x", "y", 1)], "strategy string, from_regime string, to_regime string, n long")).collect()}
    assert abs(law["y"] - 1) < 1e-9 and abs(law["x"]) < 1e-9


@pytest.mark.parametrize("n", [1, 4, 45, 700])
def test_hold_profiles(spark, n):
    data = made(n, ("A",))
    got = {r.bin: r for r in profiles.hold_profiles(spark.createDataFrame(data, KIND)).collect()}
    bars, r, f, a = (np.array([row[i] for row in data], float) for i in (8, 5, 6, 7))
    m = min(8, max(3, n // 10))
    edges = np.unique(np.round(np.percentile(bars, np.linspace(0, 100, m + 1)), 6))
    if len(edges) < 3:
        edges = np.linspace(bars.min(), bars.max() + 1, m + 1)
    seen = 0
    for i in range(len(edges) - 1):
        inside = (bars >= edges[i]) & ((bars < edges[i + 1]) if i < len(edges) - 2 else (bars <= edges[i + 1]))
        if not inside.any():
            assert i + 1 not in got
            continue
        row, seen = got[i + 1], seen + 1
        assert row.n == inside.sum() and abs(row.mean_r - r[inside].mean()) < 1e-4 and abs(row.win_rate - (r[inside] > 0).mean()) < 1e-4
        assert abs(row.mfe_mae_ratio - f[inside].mean() / max(abs(a[inside]).mean(), 0.01)) < 1e-3
    assert seen == len(got) and sum(x.best_mean for x in got.values()) == 1 == sum(x.best_ratio for x in got.values())
    assert max(got.values(), key=lambda x: x.mean_r).best_mean


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], KIND)
    for of in (profiles.regime_edge, profiles.hold_profiles, profiles.skill_scores):
        assert of(empty).isEmpty()
    missing = spark.createDataFrame([("1", "A", None, None, None, None, None, None, None, None)], KIND)
    assert profiles.regime_edge(missing).isEmpty() and profiles.hold_profiles(missing).isEmpty()


def test_regime_scores(spark):
    import datetime as dt

    def score(*groups):
        data = [(f"{g}{i}", "A", dt.datetime(2024, 1, 1), None, g, r, 0.0, 0.0, 1, "") for g, n, r in groups for i in range(n)]
        return profiles.regime_score(spark.createDataFrame(data, KIND)).first().score

    assert score(("a", 2, 0.5), ("b", 3, 0.25)) == 87.5 and score(("a", 2, 0.05)) == 85.0
    assert score(("a", 6, 0.3), ("b", 4, -0.1)) == 75.0 and score(("a", 6, 0.1), ("b", 4, -0.5)) == 55.0
    assert score(("a", 4, 0.3), ("b", 6, -0.1)) == 40.0 and score(("a", 4, -0.01), ("b", 6, -0.1)) == 25.0 and score(("a", 4, -0.5)) == 10.0


def test_constant_series(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 1.0, 3.0), ("B", 1.0, 2.0), ("B", 2.0, 5.0), ("B", None, 1.0), ("C", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.c for r in df.groupBy("k").agg(correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["A"] is None and got["C"] is None and abs(got["B"] - 1) < 1e-12
    flat = spark.createDataFrame([(*row[:5], 0.5, *row[6:8], 3, "win") for row in made(30)], KIND)
    daily = joins.daily_r(flat.withColumn("r_multiple", F.lit(0.0)))
    assert joins.pair_correlations(daily).first().corr is None
    assert t.hold_durations(flat).first().pearson_r is None
    assert not sequences.convergence(flat).first().drifting
