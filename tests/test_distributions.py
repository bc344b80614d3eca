"""Distribution expressions against the standard library, sums and tables."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapeline.functions import distributions as d


def values(spark, rows, kind, column):
    return [r.p for r in spark.createDataFrame(rows, kind).select(column.alias("p")).collect()]


def test_normal(spark):
    xs = [-9.0, -3.5, -3.0, -1.0, 0.0, 0.5, 2.9, 3.1, 6.0]
    got = values(spark, [(x,) for x in xs], "x double", d.normal_cdf(F.col("x")))
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)
    assert got[0] == pytest.approx(1.12859e-19, rel=1e-5)


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.74, 0.93, 0.999, 1 - 1e-10]
    assert values(spark, [(p,) for p in ps], "p double", d.normal_quantile(F.col("p"))) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-15)


def test_binomial(spark):
    rows = [(3, 5), (0, 4), (60, 100), (5100, 10_000), (5, 5)]
    got = values(spark, rows, "k int, n int", d.binomial_at_least(F.col("k"), F.col("n")))
    assert got == pytest.approx([sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n for k, n in rows], rel=1e-9)


def test_t(spark):
    # 95 % quantiles of tables
    table = {4: 2.7764451, 9: 2.2621572, 30: 2.0422725, 200: 1.9718962}
    rows = [(t, v) for v, t in table.items()]
    assert values(spark, rows, "t double, v int", d.t_two_sided(F.col("t"), F.col("v"))) == pytest.approx([0.05] * 4, abs=1e-8)
    assert values(spark, rows, "t double, v int", d.t_quantile(F.lit(0.975), F.col("v"))) == pytest.approx(list(table.values()), abs=1e-6)


def test_chi_square_and_kolmogorov(spark):
    rows = [(10.0, 2), (3.8414588, 1), (31.4104328, 20), (0.0, 3)]
    assert values(spark, rows, "x double, k int", d.chi2_sf(F.col("x"), F.col("k"))) == pytest.approx([math.exp(-5), 0.05, 0.05, 1.0], abs=1e-7)
    # many degrees of freedom, both tails: sums of Poisson chances for even df
    rows = [(1300.0, 2000), (2000.0, 2000), (2300.0, 2000), (1900.0, 1000), (40.0, 4), (5000.0, 5200)]
    poisson = [math.fsum(math.exp(k * math.log(x / 2) - x / 2 - math.lgamma(k + 1)) for k in range(v // 2)) for x, v in rows]
    assert values(spark, rows, "x double, k int", d.chi2_sf(F.col("x"), F.col("k"))) == pytest.approx(poisson, rel=1e-8)
    assert values(spark, [(1.3580986,), (0.1,)], "x double", d.kolmogorov_sf(F.col("x"))) == pytest.approx([0.05, 1.0], abs=1e-6)
