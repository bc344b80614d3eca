"""Q9 on many past trades: the forest is given cells of equal trades with their numbers, and draws them as it would draw the trades."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tapeline.operators import selector as c

SMALL = dict(least=1_000, trees=12, depth=4)


def made(spark, n):
    """Wins are 80 of 100 where a is 2 or more or missing, 20 of 100 elsewhere; b says nothing. The last third is scored."""
    u = F.pmod(F.xxhash64("id"), F.lit(100))
    a = F.when(F.col("id") % 5 < 4, F.col("id") % 5)
    return spark.range(n).select(F.col("id").cast("string").alias("trade_id"), F.col("id").alias("entry_time"), (F.col("id") + 5).alias("exit_time"),
        F.when(F.col("id") % 50 != 3, u < F.when(F.coalesce(a, F.lit(9)) >= 2, 80).otherwise(20)).alias("is_win"), a.alias("a"), (F.col("id") % 7).alias("b"))


def scored(df, until, **forest):
    return {r.trade_id: r.confidence for r in c.win_confidence(df, ["a", "b"], until=until, **forest).collect()}


def test_forest_is_given_cells(spark, monkeypatch):
    given = []

    class Spy(RandomForestClassifier):
        def fit(self, rows):
            given.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(c, "RandomForestClassifier", Spy)
    got = scored(made(spark, 180_000), 120_000, trees=3, depth=3)
    assert len(got) == 60_000 and max(given) <= 5 * 7 * 2  # values of a and b, labels


def test_chances(spark):
    df, until = made(spark, 6_000), 4_000
    cells, rows = scored(df, until, **SMALL), scored(df, until, **SMALL | {"least": 10**9})
    assert set(cells) == set(rows) == {str(i) for i in range(until, 6_000)}
    high = {k for k in cells if int(k) % 5 >= 2}
    share = {False: [], True: []}  # with the same weight of both classes
    past = [(r.trade_id, r.is_win) for r in df.where(f"exit_time < {until} AND is_win IS NOT NULL").collect()]
    wins = sum(w for _, w in past)
    for k, w in past:
        share[int(k) % 5 >= 2].append((w / wins, (not w) / (len(past) - wins)))
    want = {k: np.sum(v, 0)[0] / np.sum(v) for k, v in share.items()}
    for k, v in cells.items():
        assert abs(v - want[k in high]) < 0.15 and abs(v - rows[k]) < 0.1
    assert abs(np.mean(list(cells.values())) - np.mean(list(rows.values()))) < 0.02


def test_not_learned_from_later_trades(spark):
    df, until = made(spark, 6_000), 4_000
    changed = df.withColumn("is_win", F.when(F.col("exit_time") >= until, ~F.col("is_win")).otherwise(F.col("is_win")))
    assert scored(changed, until, **SMALL) == scored(df, until, **SMALL)
    for x in (True, False):
        assert set(scored(df.withColumn("is_win", F.lit(x)), until, **SMALL).values()) == {float(x)}


def test_partitions_do_not_matter(spark):
    df, before = made(spark, 6_000), spark.conf.get("spark.sql.shuffle.partitions")
    first = scored(df, 4_000, **SMALL)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert scored(df.repartition(5), 4_000, **SMALL) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_have_the_spread_of_rows(spark, monkeypatch):
    """A cell of n rows is drawn as n rows are, each a Poisson(1) number of times: n times on average, with a variance of n (one draw for the whole cell would have n squared)."""
    drawn, n = [], 400

    class Spy(RandomForestClassifier):
        def fit(self, rows):
            drawn.extend(r._w for r in rows.collect())
            return super().fit(rows)

    monkeypatch.setattr(c, "RandomForestClassifier", Spy)
    cells = spark.createDataFrame([([0.0], "loss", n), ([0.0], "win", n)], "x array<double>, label string, n long")
    assert abs(c.cell_chances(cells, cells.select("x").distinct(), "win", trees=40, depth=0).first()["chance"] - 0.5) < 0.02
    assert len(set(drawn)) > 30 and len(drawn) == 80 and abs(np.mean(drawn) - n) < 10 and 0.6 < np.var(drawn) / n < 1.5


@pytest.mark.parametrize("values, n_bins", [([1.0] * 50, 1), ([float(i % 32) for i in range(640)], 32), ([float(i % 50) for i in range(5_000)], 32), ([1.0, float("nan"), 2.0, -1.0], 4)])
def test_bins(spark, values, n_bins):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r._bin_v for r in c.in_bins(df, ["v"]).transform(df).distinct().collect()}
    assert len(set(got.values())) == n_bins
    up = [got[v] for v in sorted(v for v in got if v == v)]
    assert up == sorted(up)
