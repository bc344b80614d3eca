"""GARCH fits against a grid and a plain recursion, in one task and by rounds; tails against sums by hand."""

import datetime as dt
import math
import random
from statistics import NormalDist, mean, median, pvariance, stdev

import pytest

from tapeline.operators import volatility as v


def garch_series(n, omega, alpha, beta, seed):
    rng, h, out = random.Random(seed), omega / (1 - alpha - beta), []
    for _ in range(n):
        e = math.sqrt(h) * rng.gauss(0, 1)
        out.append(0.1 + e)
        h = omega + alpha * e * e + beta * h
    return out


def likelihood(xs, omega, alpha, beta):
    mu, h, total = mean(xs), pvariance(xs), 0.0
    for x in xs:
        e2 = (x - mu) ** 2
        total -= 0.5 * (math.log(h) + e2 / h)
        h = omega + alpha * e2 + beta * h
    return total


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    return {"g": garch_series(3000, 0.05, 0.12, 0.80, 1), "h": garch_series(1500, 0.2, 0.3, 0.4, 2), "noise": [round(rng.random() - 0.4, 3) for _ in range(400)],
            "few": [1.0, 2.0, -1.0], "flat": [1.0] * 50}


@pytest.fixture(scope="module")
def trades(spark, data):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(hours=i), x) for k, xs in data.items() for i, x in enumerate(xs)] + [("g", start, None)]
    return spark.createDataFrame(rows, "strategy string, entry_time timestamp_ntz, r_multiple double").repartition(4).cache()


def test_fit_is_the_maximum(trades, data):
    found = {r.strategy: r for r in v.garch_fit(trades).collect()}
    assert set(found) == {"g", "h", "noise"}
    for key in ("g", "h"):
        r, xs = found[key], data[key]
        assert r.log_likelihood == pytest.approx(likelihood(xs, r.omega, r.alpha, r.beta), abs=1e-8)
        for k in range(3):  # no point 1e-4 away is better in any direction
            for step in (-1e-4, 1e-4):
                theta = [r.omega, r.alpha, r.beta]
                theta[k] += step
                assert likelihood(xs, *theta) < r.log_likelihood
        near = [(a, b) for a in (-3e-3, 0, 3e-3) for b in (-3e-3, 0, 3e-3)]
        assert max(likelihood(xs, r.omega + c, r.alpha + a, r.beta + b) for a, b in near for c in (-3e-3, 0, 3e-3)) == pytest.approx(r.log_likelihood, abs=1e-9)
    assert abs(found["g"].alpha - 0.12) < 0.05 and abs(found["g"].beta - 0.80) < 0.08
    low = v.LOW
    assert found["noise"].log_likelihood >= likelihood(data["noise"], *v.first_state(pvariance(data["noise"]))["theta"]) and found["noise"].alpha >= low[1]


def test_rounds_of_jobs_take_the_same_steps(trades):
    some = trades.where("strategy = 'h'")
    short, long = (v.garch_fit(some, most=8, **o).collect()[0] for o in ({}, {"whole": 100, "block": 128}))
    for c in ("omega", "alpha", "beta", "log_likelihood"):
        assert long[c] == pytest.approx(short[c], rel=1e-9)
    assert short.rounds == long.rounds == 8


def test_clustering_report(trades, data):
    got = {r.strategy: r for r in v.clustering(trades).collect()}
    assert got["g"].has_clustering and got["g"].converged and got["few"].omega is None and not got["few"].converged and got["flat"].ljung_box == 0.0
    for key in ("g", "noise"):
        xs = data[key]
        e2 = [(x - mean(xs)) ** 2 for x in xs]
        c = [x - mean(e2) for x in e2]
        n, den = len(c), sum(x * x for x in c)
        rho = [sum(c[i] * c[i + k] for i in range(n - k)) / den for k in range(1, 11)]
        q = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho, 1))
        assert got[key].ljung_box == pytest.approx(q, abs=1e-4) and got[key].sq_autocorr_lag1 == pytest.approx(rho[0], abs=1e-4)
        y = q / 2
        assert got[key].ljung_box_p == pytest.approx(sum(math.exp(-y) * y**k / math.factorial(k) for k in range(5)), abs=1e-6)


def test_tails(trades, data):
    hill = {r.strategy: r for r in v.tail_index(trades).collect()}
    xs = sorted((abs(x) for x in data["g"] if abs(x) > 1e-12), reverse=True)
    n = len(xs)
    hs = [mean(math.log(x / xs[k]) for x in xs[:k]) for k in range(max(5, int(0.05 * n)), int(0.3 * n) + 1)]
    assert hill["g"].tail_index == pytest.approx(median(hs), abs=1e-4) and hill["g"].points == len(hs) and "few" not in hill and "flat" not in hill
    assert hill["g"].finite_variance == (1 / median(hs) > 2)
    var = {r.strategy: r for r in v.value_at_risk(trades.where("r_multiple IS NOT NULL")).collect()}["g"]
    m, s, z = mean(data["g"]), stdev(data["g"]), NormalDist().inv_cdf(0.05)
    g = mean((x - m) ** 3 for x in data["g"]) / s**3
    k = mean((x - m) ** 4 for x in data["g"]) / s**4 - 3
    cf = z + (z * z - 1) * g / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * g * g / 36
    assert var.normal_var == pytest.approx(m + z * s, abs=1e-4) and var.cornish_fisher_var == pytest.approx(m + cf * s, abs=1e-4)
    pairs = [r for r in v.quantile_pairs(trades).where("strategy = 'noise'").orderBy("no").collect()]
    xs = sorted(data["noise"])
    assert [p.no for p in pairs] == list(range(1, 401))
    assert [p.empirical for p in pairs] == pytest.approx([(x - mean(xs)) / stdev(xs) for x in xs], abs=1e-4)
    assert [p.theoretical for p in pairs] == pytest.approx([NormalDist().inv_cdf((i - 0.5) / 400) for i in range(1, 401)], abs=1e-4)


def test_empty(trades):
    for f in (v.garch_fit, v.clustering, v.tail_index, v.value_at_risk, v.quantile_pairs):
        assert f(trades.limit(0)).collect() == []
