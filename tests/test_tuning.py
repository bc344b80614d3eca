"""Scores of parameter sets, the best of each window, and where their parameters move."""

import math

import pytest
from pyspark.sql import functions as F

from tapeline.operators import tuning as t


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [-1.0, 0.5, 0.0, 2.0], [0.5, 0.5], [], [-1.0, -2.0]])
def test_scores(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "r_multiple double")
    got = df.agg(*[t.score(m).alias(m) for m in t.METRICS]).first()
    if len(values) < 2:
        assert all(got[m] == -math.inf for m in t.METRICS)
        return
    wins, losses = [v for v in values if v > 0], [v for v in values if v <= 0]
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    lost = abs(sum(v for v in values if v < 0))
    want = {"expectancy": mean, "profit_factor": sum(wins) / lost if lost else 0, "sharpe": mean / sd if sd else 0, "total_r": sum(values)}
    assert all(abs(got[m] - want[m]) < 1e-12 for m in t.METRICS) and len(wins) + len(losses) == len(values)
    with pytest.raises(ValueError):
        t.score("other")


def test_sets_and_views(spark):
    rows = [("A", "w1", 5, 1.0), ("A", "w1", 5, 1.0), ("A", "w1", 30, -3.0), ("A", "w2", 30, 4.0), ("A", "w2", 30, 2.0), ("A", "w2", 5, 1.0), ("A", "w2", 5, 1.0),
            ("B", "w1", 5, 2.0), ("B", "w1", 6, 2.0), ("B", "w2", 30, 9.0), ("C", "w1", 5, None)]
    df = spark.createDataFrame(rows, "strategy string, window string, held int, r_multiple double")
    sets = [{"top": 10}, {"top": 40}, {"low": 20}]
    passes = lambda p: F.coalesce(F.col("held") <= p["top"], F.lit(True)) & F.coalesce(F.col("held") >= p["low"], F.lit(True))
    best = t.best_sets(t.by_sets(df, sets, passes), ["strategy", "window"])
    assert {(r.strategy, r.window): (r.set_no, r.n, r.score) for r in best.collect()} == {("A", "w1"): (0, 2, 1.0), ("A", "w2"): (2, 2, 3.0), ("B", "w1"): (0, 2, 2.0)}  # equal: the first set
    got = {(r.strategy, r.parameter, r.window): (r.value, r.place) for r in t.parameter_matrix(best).collect()}
    assert got == {("A", "top", "w1"): (10.0, 0.5), ("A", "top", "w2"): (None, None), ("A", "low", "w1"): (None, None), ("A", "low", "w2"): (20.0, 0.5), ("B", "top", "w1"): (10.0, 0.5)}
    assert {(r.strategy, r.parameter): r.value for r in t.latest_parameters(best).collect()} == {("A", "low"): 20.0, ("A", "top"): 0.0, ("B", "top"): 10.0, ("B", "low"): 0.0}
    assert t.latest_parameters(best.where("strategy = 'A'")).isEmpty() and t.parameter_matrix(best.where("false")).isEmpty()
    three = spark.createDataFrame([("A", f"w{i}", {"x": v}) for i, v in enumerate([2.0, 4.0, 3.0])], "strategy string, window string, params map<string,double>")
    assert [r.place for r in t.parameter_matrix(three).orderBy("window").collect()] == [0.0, 1.0, 0.5]


def test_sampled(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    one, two = ([r.k for r in t.sampled(d, 50, "k").collect()] for d in (df, df.repartition(7)))
    assert one == two and len(set(one)) == 50 and t.sampled(df, 50, "k", seed=1).collect() != t.sampled(df, 50, "k").collect()
    assert t.sampled(df, 5000, "k").count() == 1000
