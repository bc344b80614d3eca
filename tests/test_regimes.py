"""Hidden Markov regimes against a plain sequential run, in one block and in many, in one task and by rounds of jobs."""

import math

import numpy as np
import pytest

from tapeline.operators import regimes

FEATURES = ["ret", "vol"]


def lse(v):
    top = np.max(v)
    return top + math.log(np.sum(np.exp(v - top)))


def emission(x, mu, sigma):
    return -0.5 * np.sum(np.log(2 * np.pi * sigma**2) + (x[:, None] - mu) ** 2 / sigma**2, -1)


def forward_backward(b, a, pi):
    n, k = b.shape
    f, g = np.zeros((n, k)), np.zeros((n, k))
    f[0] = np.log(pi) + b[0]
    for t in range(1, n):
        f[t] = [lse(f[t - 1] + np.log(a[:, j])) + b[t, j] for j in range(k)]
    for t in range(n - 2, -1, -1):
        g[t] = [lse(np.log(a[i]) + b[t + 1] + g[t + 1]) for i in range(k)]
    return f, g


def plain_fit(x, most, tol=1e-4):
    n, d = x.shape
    low = x[:, 0] <= np.median(x[:, 0])
    mu, sigma = np.array([x[low].mean(0), x[~low].mean(0)]), np.array([x[low].std(0), x[~low].std(0)])
    a, pi, before = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), -math.inf
    for rounds in range(1, most + 1):
        b = emission(x, mu, sigma)
        f, g = forward_backward(b, a, pi)
        ll = lse(f[-1])
        gamma = np.exp(f + g - np.array([lse(v) for v in f + g])[:, None])
        xi = np.array([np.exp((v := f[t][:, None] + np.log(a) + b[t + 1] + g[t + 1]) - lse(v.ravel())) for t in range(n - 1)])
        if abs(ll - before) < tol and rounds > 1:
            break
        before, pi = ll, np.clip(gamma[0], 1e-6, 1)
        pi = pi / pi.sum()
        a = np.clip(xi.sum(0) / gamma[:-1].sum(0)[:, None], 1e-6, 1)
        a /= a.sum(1, keepdims=True)
        mu = (gamma.T @ x) / gamma.sum(0)[:, None]
        sigma = np.maximum(np.sqrt([(gamma[:, k] @ (x - mu[k]) ** 2) / gamma[:, k].sum() for k in (0, 1)]), 1e-6)
    if mu[1, 1] < mu[0, 1]:
        mu, sigma, a, pi = mu[::-1], sigma[::-1], a[::-1, ::-1], pi[::-1]
    return mu, sigma, a, pi, ll, rounds


def viterbi(b, a, pi):
    score, back = np.log(pi) + b[0], []
    for t in range(1, len(b)):
        both = score[:, None] + np.log(a)
        back.append(both.argmax(0))
        score = both.max(0) + b[t]
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def series(n, seed):
    rng, state, out = np.random.default_rng(seed), 0, []
    for _ in range(n):
        state = state if rng.random() < 0.97 else 1 - state
        out.append((float(rng.normal(0.1 - 0.3 * state, 0.5 + state)), float(abs(rng.normal(1 + 2 * state, 0.4)))))
    return out


@pytest.fixture(scope="module")
def data():
    out = {"a": series(900, 1), "b": series(411, 2), "tiny": series(20, 3)}
    out["b"][5] = (None, 1.0)
    out["b"][77] = (float("nan"), 1.0)
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(k, i, *x, "clash") for k, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "key string, at int, ret double, vol double, mu string").repartition(4).cache()


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"block": 64, "whole": 500, "most": 6}])
def test_fit_and_paths(frame, data, options):
    by = dict(by=["key"], order="at", features=FEATURES)
    models = regimes.fit_regimes(frame, **by, **options)
    found = {r.key: r for r in models.collect()}
    assert set(found) == {"a", "b"}
    paths = {(r.key, r["at"]): r for r in regimes.regime_paths(frame, models, **by, block=options.get("block", 256)).collect()}
    assert len(paths) == sum(len(data[k]) for k in found)
    for key, r in found.items():
        x = np.array([v for v in data[key] if v[0] is not None and not math.isnan(v[0])])
        x = (x - x.mean(0)) / x.std(0)
        mu, sigma, a, pi, ll, rounds = plain_fit(x, options.get("most", 100))
        assert (r.n, r.rounds) == (len(x), rounds) and r.log_likelihood == pytest.approx(ll, abs=1e-6)
        for got, want in ((r.mu, mu), (r.sigma, sigma), (r.trans, a), (r.start, pi)):
            assert got == pytest.approx(np.asarray(want).ravel().tolist(), abs=1e-6)
        full = np.array([v if v[0] is not None and not math.isnan(v[0]) else r.mean for v in data[key]])
        full = (full - r.mean) / np.array(r.std)
        b = emission(full, mu, sigma)
        f, g = forward_backward(b, a, pi)
        path = viterbi(b, a, pi)
        for t in range(len(full)):
            p = paths[key, t]
            assert p.filtered == pytest.approx(np.exp(f[t] - lse(f[t])).tolist(), abs=1e-6)
            assert p.smoothed == pytest.approx(np.exp(f[t] + g[t] - lse(f[t] + g[t])).tolist(), abs=1e-6)
            assert p.state == path[t]


def test_one_long_series_is_spread(spark):
    """20,000 bars of one key: block tasks share them; posteriors equal a sequential run."""
    x = series(20_000, 7)
    df = spark.createDataFrame([("k", i, *v) for i, v in enumerate(x)], "key string, at int, ret double, vol double")
    by = dict(by=["key"], order="at", features=FEATURES)
    models = regimes.fit_regimes(df, **by, most=3, whole=1000)
    r = models.collect()[0]
    got = regimes.regime_paths(df, models, **by).orderBy("at").collect()
    z = (np.array(x) - r.mean) / np.array(r.std)
    b, a, pi = emission(z, np.array(r.mu).reshape(2, 2), np.array(r.sigma).reshape(2, 2)), np.array(r.trans).reshape(2, 2), np.array(r.start)
    f, g = forward_backward(b, a, pi)
    want = np.exp(f + g - np.array([lse(v) for v in f + g])[:, None])
    assert np.abs(np.array([p.smoothed for p in got]) - want).max() < 1e-8
    assert [p.state for p in got] == viterbi(b, a, pi)
    assert np.mean([p.state for p in got]) == pytest.approx(0.5, abs=0.15)


def test_sizes_and_empty(spark, frame):
    rows = [("k", [p, 1 - p]) for p in (0.9, 0.70, 0.6, 0.55, 0.5, 0.41, 0.40, 0.1)]
    got = regimes.sizing(spark.createDataFrame(rows, "key string, filtered array<double>"), ["key"]).collect()[0]
    assert (got.bars, got.full_pct, got.reduced_pct, got.uncertain_pct, got.defensive_pct) == (8, 25.0, 25.0, 25.0, 25.0)
    assert regimes.fit_regimes(frame.limit(0), by=["key"], order="at", features=FEATURES).collect() == []
