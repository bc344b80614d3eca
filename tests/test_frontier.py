"""Long-only portfolios: conditions of optimality and a grid over the simplex."""

import itertools
import random

import numpy as np
import pytest

from tapeline.operators import frontier as f


def problem(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 3))
    return a @ a.T / n, rng.normal(0.3, 1, n)


@pytest.mark.parametrize("seed", range(12))
def test_conditions_of_optimality(seed):
    n = 2 + seed
    cov, mu = problem(seed, n)
    x = f.quadratic_program(cov, mu, np.zeros((0, n)), np.zeros(n))
    g = cov @ x - mu
    assert (x >= 0).all() and np.abs(g[x > 0]).max(initial=0) < 1e-8 and g.min() > -1e-8
    target = mu.min() + 0.6 * (mu.max() - mu.min())
    start = np.zeros(n)
    share = (target - mu.min()) / (mu.max() - mu.min())
    start[mu.argmin()], start[mu.argmax()] = 1 - share, share
    a = np.stack([np.ones(n), mu])
    x = f.quadratic_program(cov, np.zeros(n), a, start)
    assert (x >= 0).all() and np.abs(a @ x - [1, target]).max() < 1e-9
    on = x > 1e-12
    dual = np.linalg.lstsq(a[:, on].T, (cov @ x)[on], rcond=None)[0]
    rest = cov @ x - a.T @ dual
    assert np.abs(rest[on]).max() < 1e-8 and (on.sum() < 2 or rest.min() > -1e-8)


def test_weights_beat_a_grid():
    cov, mu = problem(3, 4)
    w = f.weights_of(mu, cov, None)
    sharpe = lambda v: v @ mu / np.sqrt(v @ (cov + f.RIDGE * np.eye(4)) @ v)
    grid = [np.array(v) / 40 for v in itertools.product(range(41), repeat=4) if sum(v) == 40]
    assert sharpe(w) >= max(map(sharpe, grid)) - 1e-6 and w.sum() == pytest.approx(1)
    assert f.weights_of(-np.abs(mu), cov, None).tolist() == [0.25] * 4 == f.weights_of(mu, cov, 99.0).tolist()


def test_from_daily_rows(spark):
    rng = random.Random(2)
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    rows = [(k, d, rng.gauss(m, s)) for k, m, s in (("a", 0.3, 1), ("b", 0.1, 0.4), ("c", -0.2, 1), ("d", 0.2, 2)) for d in days if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "strategy string, day string, r double").repartition(5)
    x = np.zeros((28, 4))
    for k, d, r in rows:
        x[days.index(d), "abcd".index(k)] = r
    z = x - x.mean(0)
    cov, weight = f.shrunk(z.T @ z, ((z**2).sum(1) ** 2).sum(), 28)
    # Ledoit and Wolf's weight from its definition: the days' scatter about their mean outer product
    emp = z.T @ z / 28
    noise = np.mean([((np.outer(v, v) - emp) ** 2).sum() for v in z]) / 28
    assert weight == pytest.approx(min(1, noise / ((emp - np.trace(emp) / 4 * np.eye(4)) ** 2).sum()))
    for target in (None, 0.1):
        got = {r.strategy: r for r in f.mean_variance(df, target=target).collect()}
        want = f.weights_of(x.mean(0), cov, target)
        assert [got[k].weight for k in "abcd"] == pytest.approx(want.tolist(), abs=1e-9) and got["a"].shrinkage == pytest.approx(weight)
        assert target is None or sum(got[k].weight * got[k].mean for k in "abcd") == pytest.approx(0.1, abs=2e-3)
    assert f.mean_variance(df.limit(0)).collect() == []
