"""The choice between strategies: rows by hand, walks that see no later day, contributions that add up."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import selector as c

COLUMNS = ["a", "b", "noise"]
KIND = "symbol string, day string, a double, b double, noise double, forward map<string,double>, label string"


def made(days=40, markets=3, turn=10**9):
    """Rows whose label follows from a and b; from day `turn` on labels are the other way round."""
    rng, rows = np.random.default_rng(5), []
    for t in range(days):
        for m in range(markets):
            a, b, noise = rng.normal(size=3).tolist()
            label = "x" if (a > 0) != (t >= turn) else "y" if b > 0 else "none"
            forward = {"x": 1.0 if label == "x" else -1.0, "y": 2.0 if label == "y" else -0.5}
            rows.append((f"M{m}", f"2024-{1 + t // 28:02}-{1 + t % 28:02}", a, b, noise, forward, label))
    return rows


@pytest.fixture(scope="module")
def forest(spark):
    df, classes = c.prepared(spark.createDataFrame(made(), KIND), COLUMNS)
    return df, classes, c.fitted(df, classes, trees=12, depth=5)


def test_rows_by_hand(spark):
    bars = [("M", "2024-01-01 10:00:00", 1.0, 5.0), ("M", "2024-01-01 23:00:00", 2.0, None), ("M", "2024-01-02 09:00:00", None, None), ("N", "2024-01-03 01:00:00", 3.0, 1.0), ("M", "2024-01-04 01:00:00", 4.0, 1.0)]
    features = spark.createDataFrame(bars, "symbol string, bar_ts string, a double, b double").withColumn("bar_ts", F.to_timestamp("bar_ts"))
    regimes = features.select("symbol", "bar_ts", F.when(F.hour("bar_ts") == 23, "volatile").otherwise("unknown").alias("regime"))
    daily = [("p", "2024-01-01", 1.0), ("q", "2024-01-02", -1.0), ("q", "2024-01-03", 2.0), ("p", "2024-01-04", 2.0), ("p", "2024-01-05", -9.0), ("q", "2024-01-05", -3.0)]
    curve = spark.createDataFrame(daily, "strategy string, day string, r double")
    got = {(r.symbol, r.day): r for r in c.selector_rows(features, regimes, curve, columns=("a", "b"), days=2).collect()}
    first = got["M", "2024-01-01"]  # the day's last bar; a missing feature is 0; q: -1 + 2, p: 0
    assert (first.a, first.b, first.regime_volatile, first.forward, first.label) == (2.0, 0.0, 1.0, {"p": 0.0, "q": 1.0}, "q")
    assert got["N", "2024-01-03"].label == "none" and got["N", "2024-01-03"].forward == {"p": -7.0, "q": -3.0}
    assert ("M", "2024-01-04") not in got  # one day after it only
    assert got["M", "2024-01-02"].label == "p"  # p and q both 2: the first by name; two of six features missing
    assert c.selector_rows(features.where("false"), regimes, curve, columns=("a", "b"), days=2).isEmpty()
    assert c.selector_rows(features, regimes, curve, columns=("a", "b"), days=9).isEmpty()


def test_walk_sees_no_later_day(spark):
    same = dict(least=20, every=8, embargo=3, trees=10, depth=4)
    walk = c.walk_forward(spark.createDataFrame(made(), KIND), COLUMNS, **same).orderBy("day", "symbol").toPandas()
    assert len(walk) == 20 * 3 and (walk["trained_to"] + 3 < walk["day_no"]).all()
    assert (walk["label"] == walk["predicted"]).mean() > 0.8
    turned = c.walk_forward(spark.createDataFrame(made(turn=20), KIND), COLUMNS, **same).orderBy("day", "symbol").toPandas()
    until = walk["day_no"] <= 28  # the first forest: days up to 17, which both tables share
    assert (walk["predicted"][until] == turned["predicted"][until]).all()
    assert (walk["predicted"] != turned["predicted"]).any()
    for r in walk.itertuples():
        chances, forward = dict(r.chances), {"x": 1.0 if r.label == "x" else -1.0, "y": 2.0 if r.label == "y" else -0.5}
        assert abs(sum(chances.values()) - 1) < 1e-9
        assert abs(r.soft - sum(chances[k] * v for k, v in forward.items())) < 1e-9
        assert r.hard == forward.get(r.predicted, 0.0) and r.best == max(forward.values()) and abs(r.equal - sum(forward.values()) / 2) < 1e-12
    assert c.walk_forward(spark.createDataFrame(made(days=25), KIND), COLUMNS, **same).isEmpty()


def test_metrics(spark):
    rows = [("M", f"2024-01-0{i + 1}", "x", "x" if i else "y", r, 0.0, 1.0, 2.0) for i, r in enumerate([1.0, -2.0, 0.5, -1.0])]
    got = {r.way: r for r in c.walk_metrics(spark.createDataFrame(rows, "symbol string, day string, label string, predicted string, hard double, soft double, equal double, best double")).collect()}
    x = np.array([1.0, -2.0, 0.5, -1.0])
    assert (got["hard"].total_r, got["hard"].max_drawdown, got["hard"].win_rate, got["hard"].accuracy) == (-1.5, -2.5, 0.5, 0.75)
    assert math.isclose(got["hard"].sharpe, x.mean() / x.std(ddof=1) * 365**0.5, abs_tol=1e-4)
    assert got["soft"].sharpe == 0.0 and got["best"].total_r == 8.0


def test_folds():
    assert c.folds(100, embargo=7) == [("fold 1", 21, 29, 54), ("fold 2", 47, 55, 80), ("held out", 73, 81, 100)]
    for n in (3, 10, 31, 400):
        cuts = c.folds(n, embargo=7)
        assert all(until + 7 < first <= last <= n for _, until, first, last in cuts)
        assert all(a[3] + 1 == b[2] for a, b in zip(cuts, cuts[1:]))
        assert len(cuts) == min(5, max(2, int(n * 0.8) // 30)) + 1 or n < 10


def test_training(spark):
    got = c.training(spark.createDataFrame(made(), KIND), COLUMNS, embargo=2, trees=10, depth=4).toPandas()
    assert set(got["part"]) == {"fold 1", "fold 2", "held out"}
    held = got[got["part"] == "held out"]
    assert held["n"].sum() == 8 * 3 and held["n_train"].iloc[0] == 30 * 3 and held["accuracy"].iloc[0] > 0.8
    assert abs(held["accuracy"].iloc[0] - held["n"][held["label"] == held["predicted"]].sum() / 24) < 1e-4
    assert c.training(spark.createDataFrame([], KIND), COLUMNS).isEmpty()


def test_contributions_add_up(spark, forest):
    df, classes, model = forest
    from pyspark.ml.functions import vector_to_array

    want = {(r.symbol, r.day): r.p for r in model.transform(df).select("symbol", "day", vector_to_array("probability").alias("p")).collect()}
    table = {}
    for r in c.nodes(model, spark).collect():
        table.setdefault(r.tree, {})[r.node] = r
    got = c.contributions(df, model).collect()
    assert len(got) == len(want)
    for r in got:
        parts = np.array(r.parts)
        assert np.allclose(np.array(r.base) + parts.sum(0), want[r.symbol, r.day], atol=1e-12) and np.allclose(r.chances, want[r.symbol, r.day], atol=1e-12)
    for r in got[:15]:  # a walk node by node
        parts = np.zeros((3, len(classes)))
        for tree in table.values():
            at = tree[0]
            while at.left >= 0:
                then = tree[at.left] if r.x[at.feature] <= at.threshold else tree[at.right]
                parts[at.feature] += (np.array(then.shares) - np.array(at.shares)) / len(table)
                at = then
        assert np.allclose(parts, r.parts, atol=1e-12)


def test_importance(spark, forest):
    df, classes, model = forest
    loss = {r.feature: r.loss for r in c.permuted_accuracy(df, model, COLUMNS, classes).collect()}
    rows = {(r.symbol, r.day): (list(r.f), r.label) for r in df.select("symbol", "day", "label", F.col("features").alias("f")).collect()}
    order = [(r.symbol, r.day) for r in df.select("symbol", "day", F.xxhash64(F.lit(42), "symbol", "day").alias("h")).orderBy("h", "symbol", "day").collect()]
    score = lambda f: np.mean([classes[int(model.predict(_mixed(rows, order, i, f)))] == rows[k][1] for i, k in enumerate(order)])
    assert abs(loss["a"] - (score(-1) - score(0))) < 1e-9 and loss["a"] > 0.2 and abs(loss["noise"]) < 0.1
    got = c.importance(spark.createDataFrame(made(), KIND), COLUMNS, trees=12, depth=5).orderBy("rank").toPandas()
    assert got["feature"].tolist()[2] == "noise" and abs(got["gain"].sum() - 1) < 1e-5
    assert c.importance(spark.createDataFrame([], KIND), COLUMNS).isEmpty()


def _mixed(rows, order, i, f):
    from pyspark.ml.linalg import Vectors

    x = list(rows[order[i]][0])
    if f >= 0:
        x[f] = rows[order[(i + 1) % len(order)]][0][f]
    return Vectors.dense(x)


def test_one_class(spark):
    rows = [(*row[:6], "none") for row in made(12, 1)]
    df, classes = c.prepared(spark.createDataFrame(rows, KIND), COLUMNS)
    got = c.predicted(df, c.fitted(df, classes, trees=3, depth=2), classes).collect()
    assert classes == ["none"] and {(r.predicted, tuple(r.chances)) for r in got} == {("none", (1.0,))}


def test_win_confidence(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(300):
        a = None if i % 7 == 0 else float(rng.normal())
        rows.append((f"t{i}", i, i + 5, None if i % 50 == 3 else (a is None or a > 0), a))
    df = spark.createDataFrame(rows, "trade_id string, entry_time int, exit_time int, is_win boolean, a double")
    got = {r.trade_id: r for r in c.win_confidence(df, ["a"], until=200, trees=8, depth=4).collect()}
    assert set(got) == {f"t{i}" for i in range(200, 300)}
    right = [(r.confidence > 0.5) == r.is_win for r in got.values() if r.is_win is not None]
    assert np.mean(right) > 0.8
    changed = df.withColumn("is_win", F.when(F.col("exit_time") >= 200, ~F.col("is_win")).otherwise(F.col("is_win")))  # not closed by then: not learned from
    assert {r.trade_id: r.confidence for r in c.win_confidence(changed, ["a"], until=200, trees=8, depth=4).collect()} == {k: r.confidence for k, r in got.items()}
    wins, losses = (df.withColumn("is_win", F.lit(x)) for x in (True, False))
    assert {r.confidence for r in c.win_confidence(wins, ["a"], until=200, trees=2).collect()} == {1.0}
    assert {r.confidence for r in c.win_confidence(losses, ["a"], until=200, trees=2).collect()} == {0.0}
    assert {r.confidence for r in c.win_confidence(df, ["a"], until=0, trees=2).collect()} == {None}
