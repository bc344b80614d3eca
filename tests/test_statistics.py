"""Resampling statistics against exact laws and sums by hand."""

import random
from statistics import NormalDist, mean, stdev

import pytest

from tapeline.operators import statistics as st

ROUNDS = 10_000


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(1)
    rows = [("sure", f"a{i}", 1.0 + i / 100) for i in range(40)] + [("three", f"b{i}", 1.0) for i in range(3)] + [("many", f"c{i}", 0.5) for i in range(200)] + [("many", f"d{i}", -0.5) for i in range(180)]
    rows += [("noise", f"e{i}", round(rng.gauss(0.1, 1), 4)) for i in range(400)]
    return spark.createDataFrame(rows, "strategy string, trade_id string, r_multiple double").cache()


def test_sign_flip(trades):
    got = {r.strategy: r for r in st.sign_flip(trades).collect()}
    assert got["sure"].p_positive == got["sure"].p_value == 1 / (ROUNDS + 1) and got["sure"].p_negative == 1.0
    assert abs(got["three"].p_positive - 1 / 8) < 0.015 and abs(got["three"].p_value - 1 / 4) < 0.02 and got["three"].power == 1.0 and got["three"].n_for_80 == 1
    # 380 equal steps: at least 200 of them up
    assert abs(got["many"].p_positive - (1 - NormalDist(190, 95**0.5).cdf(199.5))) < 0.015
    r = [x.r_multiple for x in trades.where("strategy = 'noise'").collect()]
    d, z = abs(mean(r)) / stdev(r), NormalDist().inv_cdf
    assert abs(got["noise"].cohens_d - d) < 1e-6 and abs(got["noise"].power - NormalDist().cdf(d * len(r) ** 0.5 - z(0.975))) < 1e-6
    assert got["noise"].n_for_90 == -int(-(((z(0.975) + z(0.9)) / d) ** 2) // 1)
    p = sorted(x.p_positive for x in got.values())
    assert got["sure"].p_bonferroni == got["sure"].p_holm == 4 * p[0]
    for x in got.values():
        i = p.index(x.p_positive)
        assert abs(x.p_holm - min(1.0, max((4 - j) * p[j] for j in range(i + 1)))) < 1e-12
        assert abs(x.p_benjamini_hochberg - min(1.0, *(4 * p[j] / (j + 1) for j in range(i, 4)))) < 1e-12


def test_bootstrap(trades):
    got = {r.strategy: r for r in st.bootstrap(trades).collect()}
    r = [x.r_multiple for x in trades.where("strategy = 'noise'").collect()]
    g, w, se = got["noise"], mean(x > 0 for x in r), stdev(r) / len(r) ** 0.5
    assert abs(g.low - (mean(r) - 1.96 * se)) < 0.12 * se and abs(g.high - (mean(r) + 1.96 * se)) < 0.12 * se and (g.expectancy_low, g.expectancy_high) == (g.low, g.high)
    assert abs(g.win_rate_low - (w - 1.96 * (w * (1 - w) / 400) ** 0.5)) < 0.006 and abs(g.win_rate_middle - w) < 0.004
    assert abs(g.profit_factor_middle - sum(x for x in r if x > 0) / -sum(x for x in r if x < 0)) < 0.03
    assert abs(g.sharpe_middle - mean(r) / stdev(r)) < 0.01 and abs(g.p_profitable - NormalDist().cdf(mean(r) / se)) < 0.02
    assert (got["three"].low, got["three"].profit_factor_high, got["three"].p_profitable) == (1.0, 0.0, 1.0)


def test_partitions_do_not_change_draws(trades):
    for f in (st.sign_flip, st.bootstrap):
        assert sorted(f(trades.repartition(1)).collect()) == sorted(f(trades.repartition(7)).collect())


def test_minimum_length(spark):
    from pyspark.sql import functions as F

    def length(sr, trials, **more):
        return spark.createDataFrame([(sr,)], "sr double").select(st.minimum_length(F.col("sr"), trials, **more)).first()[0]

    assert length(0.0, 100) == 252 and length(2.0, 1) == 252 and length(2.0, 100) == 99_999
    best, z = st.expected_best(100), NormalDist().inv_cdf(0.95)
    assert length(3.0, 100) == max(30, -int(-(z * z * (1 + 0.5 * 9) / (3 - best) ** 2) // 1) + 1)
    assert length(9.0, 100) == 30 and length(3.0, 100, kurt=9.0) > length(3.0, 100)


def test_splits():
    from tapeline.operators.portfolio import splits

    assert len(splits(6, 2, 0)) == 15
    for train, test in splits(6, 2, 1):
        assert len(test) == 2 and not set(train) & {g + d for g in test for d in (-1, 0, 1)}
    assert all(train for train, _ in splits(4, 2, 1))  # splits that leave nothing to train on go
