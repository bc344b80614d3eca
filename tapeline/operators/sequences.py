"""Statistics that depend on the order of trades: recovery, calibrated limits, filters and change points. r stands for r_multiple, in order of `time`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import kolmogorov_sf, t_two_sided
from ..functions.metrics import correlation, ratio, rounded
from .ordering import positions

UP = Window.unboundedPreceding


def _ties(trades: DataFrame, other: str) -> list[Column | str]:
    """What orders trades of one time: their ids (as whole numbers are, where they are written so), else `other`."""
    return [F.length("trade_id"), F.col("trade_id")] if "trade_id" in trades.columns else [other]


def _numbered(trades: DataFrame, by: str, time: str) -> DataFrame:
    ids = ["trade_id"] if "trade_id" in trades.columns else []
    return positions(trades.select(by, time, F.col("r_multiple").alias("r"), *ids), [by], time, tuple(_ties(trades, "r"))).drop(*ids)


def recovery(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", thresholds: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """How often the drawdown crosses each threshold and how many trades it takes until the peak before it is reached again.

    Between two trades at a peak lies one drawdown; it crosses a threshold at most once, so the reference's scan that skips to the recovery is one row per drawdown."""
    w = Window.partitionBy(by).orderBy("no").rowsBetween(UP, 0)
    df = _numbered(trades, by, time).withColumn("cum", F.sum("r").over(w))
    df = df.withColumn("dd", F.max("cum").over(w) - F.col("cum")).withColumn("fall", F.sum((F.col("dd") <= 0).cast("long")).over(w))
    falls = df.groupBy(by, "fall").agg(F.min("no").alias("first"), *[F.min(F.when(F.col("dd") >= t, F.col("no"))).alias(f"_{i}") for i, t in enumerate(thresholds)])
    falls = falls.withColumn("next", F.lead("first").over(Window.partitionBy(by).orderBy("fall")))
    rows = falls.select(by, "next", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("crossed")) for i,
        t in enumerate(thresholds)])).alias("x")).select(by, "next", "x.*")
    took = F.col("next") - F.col("crossed")
    return rows.groupBy(by, "threshold").agg(F.count("crossed").alias("n"), F.count(took).alias("recovered"), rounded(ratio(F.count(took),
        F.count("crossed"))).alias("recovery_rate"), F.avg(took).alias("mean_trades"), F.max(took).cast("long").alias("max_trades"))


def loss_streaks(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time") -> DataFrame:
    """T-9: runs of losing outcomes (a missing outcome counts by its R), with their length and the R lost."""
    w = Window.partitionBy(by).orderBy(time)
    lost = F.when(F.coalesce("outcome", F.lit("")) == "", F.col("r_multiple") < 0).otherwise(F.col("outcome").contains("loss"))
    df = trades.withColumn("_l", lost).withColumn("_run", F.sum((~F.col("_l")).cast("long")).over(w.rowsBetween(UP, 0)))
    return df.where("_l").groupBy(by, "_run").agg(F.count("*").alias("length"), F.sum(F.abs("r_multiple")).alias("r_lost")).drop("_run")


def calibrated_limits(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time") -> DataFrame:
    """T-9: limits for a live pause: drawdown of 20 trades, length of a losing streak, trades to wait; with the confidence that the number of trades allows."""
    from .trades import rolling_drawdown

    w = Window.partitionBy(by).orderBy("no").rowsBetween(UP, 0)
    base = _numbered(trades, by, time).withColumn("cum", F.sum("r").over(w)).withColumn("dd", F.max("cum").over(w) - F.col("cum"))
    base = base.groupBy(by).agg(F.count("*").alias("n"), F.max("dd").alias("max_dd"))
    rolling = rolling_drawdown(trades, by, time=time, sizes=(20,), digits=12).select(by, "p95")
    runs = loss_streaks(trades, by=by, time=time).groupBy(by).agg(F.count("*").alias("runs"), F.percentile("length", F.lit(0.95)).alias("q"), F.max("length").alias("longest"))
    back = recovery(trades, by=by, time=time, thresholds=(2.0,)).select(by, "mean_trades")
    df = base.join(rolling, by, "left").join(runs, by, "left").join(back, by, "left")
    raw = F.when(F.col("n") >= 20, F.col("p95")).otherwise(F.col("max_dd"))
    streak = F.when(F.col("runs") >= 20, F.col("q")).otherwise(F.col("longest"))
    return df.select(
        by, "n", rounded(raw, 2).alias("raw_drawdown"), rounded(raw * F.when(F.col("n") >= 20, 1.1).otherwise(1.2), 1).alias("drawdown_limit"),
        F.coalesce(F.ceil(streak) + 1, F.lit(5)).cast("long").alias("streak_limit"), F.coalesce(F.greatest(F.lit(3), F.ceil(F.col("mean_trades") * 0.5)),
            F.lit(5)).cast("long").alias("cooldown"),
        F.when(F.col("n") >= 200, "high").when(F.col("n") >= 50, "medium").otherwise("low").alias("confidence"),
    )


def affine_scan(df: DataFrame, by: str, order: str, slope: str, value: str, name: str, *, block: int = 512) -> DataFrame:
    """Adds `name`: y = slope * y_before + value along `order` (whole numbers from 1) within `by`; the first row's slope must be 0.

    Blocks of rows are folded on their own with the products of their slopes, then composed by one row each, so a long key is no single fold."""
    rest = [c for c in df.columns if c not in (by, order)]
    parts = df.withColumn("_b", F.floor((F.col(order) - 1) / block)).groupBy(by, "_b").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    start = F.struct(F.lit(0.0).alias("y"), F.lit(1.0).alias("m"), F.array().cast("array<struct<y: double, m: double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y, m = s["y"] * x[slope] + x[value], s["m"] * x[slope]
        return F.struct(y.alias("y"), m.alias("m"), F.array_append(s["out"], F.struct(y.alias("y"), m.alias("m"))).alias("out"))

    parts = parts.withColumn("_own", F.aggregate("_rows", start, step, lambda s: s["out"]))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(UP, -1)
    parts = parts.withColumn("_in", F.aggregate(F.collect_list(F.element_at("_own", -1)).over(before), F.lit(0.0), lambda s, x: s * x["m"] + x["y"]))
    rows = parts.select(by, F.posexplode(F.arrays_zip("_rows", "_own")).alias("_i", "_x"), "_in")
    return rows.select(by, *[F.col("_x")["_rows"][c].alias(c) for c in (order, *rest)], (F.col("_x")["_own"]["y"] + F.col("_x")["_own"]["m"] * F.col("_in")).alias(name))


def kalman_edge(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time") -> DataFrame:
    """Mean R after each trade by a local-level Kalman filter, with two standard deviations around it.

    The variance after n trades, p -> r (p + q) / (p + q + r), is a linear fractional map with fixed points a > 0 > b, so (p - a) / (p - b) shrinks by the same
    factor at each step: gain and variance have a closed form in n, and with them the filter is an affine scan."""
    df = _numbered(trades, by, time).withColumn("_d", F.col("r") - F.lag("r").over(Window.partitionBy(by).orderBy("no")))
    noise = df.groupBy(by).agg(F.var_pop("r").alias("v"), F.var_pop("_d").alias("dv"))
    noise = noise.withColumn("q", F.greatest(F.lit(1e-6), F.coalesce(F.col("dv") / 2, F.lit(0.0)))).withColumn("rr", F.when(F.col("v") > 0,
        F.greatest(0.1 * F.col("v"), F.col("v") - F.col("q"))).otherwise(1e-6))
    q, rr, first = F.col("q"), F.col("rr"), F.when(F.col("v") > 0, F.col("v")).otherwise(1.0)
    noise = noise.withColumn("_s", F.sqrt(q * q + 4 * q * rr)).withColumn("_a", 2 * q * rr / (q + F.col("_s"))).withColumn("_b", -(q + F.col("_s")) / 2)
    noise = noise.select(by, "q", "rr", "_s", "_a", F.log1p(-F.col("_s") / (rr - F.col("_b"))).alias("_step"), F.log1p(-F.col("_s") / (first - F.col("_b"))).alias("_from"))

    def variance(n: Column) -> Column:
        left = F.col("_from") + (n - 1) * F.col("_step")
        return F.col("_a") + F.col("_s") * F.exp(left) / -F.expm1(left)

    ahead = variance(F.greatest(F.col("no") - 1, F.lit(1))) + q
    df = df.select(by, time, "no", "r").join(noise, by).withColumn("_k", F.when(F.col("no") == 1, 1.0).otherwise(ahead / (ahead + rr)))
    df = df.select(by, time, "no", variance(F.col("no")).alias("_p"), (1 - F.col("_k")).alias("_m"), (F.col("_k") * F.col("r")).alias("_v"))
    out = affine_scan(df, by, "no", "_m", "_v", "edge")
    return out.select(by, time, "no", "edge", (F.col("edge") - 2 * F.sqrt("_p")).alias("low"), (F.col("edge") + 2 * F.sqrt("_p")).alias("high"))


def edge_trend(filtered: DataFrame, *, by: str = "strategy") -> DataFrame:
    """The filtered edge's first and last value, its drift, the share of time above 0, and its trend (last quarter against first, by a tenth of its deviation)."""
    n = F.count("*").over(Window.partitionBy(by))
    quarter = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    df = filtered.withColumn("n", n).withColumn("_q", quarter)
    agg = df.groupBy(by).agg(F.min_by("edge", "no").alias("a"), F.max_by("edge", "no").alias("b"), F.avg((F.col("edge") > 0).cast("double")).alias("up"),
        F.avg(F.when(F.col("no") <= F.col("_q"), F.col("edge"))).alias("early"), F.avg(F.when(F.col("no") > F.col("n") - F.col("_q"),
        F.col("edge"))).alias("late"), F.stddev_pop("edge").alias("sd"))
    least = F.when(F.col("sd") > 0, 0.1 * F.col("sd")).otherwise(1e-6)
    trend = F.when(F.col("late") - F.col("early") > least, "improving").when(F.col("early") - F.col("late") > least, "deteriorating").otherwise("stable")
    return agg.select(by, rounded(F.col("a"), 6).alias("initial_edge"), rounded(F.col("b"), 6).alias("final_edge"), rounded(F.col("b") - F.col("a"),
        6).alias("total_drift"), rounded(F.col("up")).alias("share_positive"), trend.alias("edge_trend"))


def _alarms(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Of values in order within keys (by, r, mu, s): a row per key (by, n_changes, changes, current_start, current_mean); a few numbers and the alarms are held."""
    key, known = None, False
    names = [by, "n_changes", "changes", "current_start", "current_mean"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array([len(at)], pa.int32()), pa.array([",".join(map(str, at))]), pa.array([begin], pa.int32()), pa.array([total / n])], names)

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for k, (own, r, mu, s) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
            if not known or own != now:
                if known:
                    yield row()
                key, now, known = batch.column(0).slice(k, 1), own, True
                i, up, down, at, begin, total, n = 0, 0.0, 0.0, [], 0, 0.0, 0
            if i:
                up, down = max(0.0, up + r - mu - 0.5 * s), max(0.0, down - (r - mu + 0.5 * s))
                if up > 5 * s or down > 5 * s:
                    up, down, begin, total, n = 0.0, 0.0, i, 0.0, 0
                    at.append(i)
            i, total, n = i + 1, total + r, n + 1
    if known:
        yield row()


def change_points(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time") -> DataFrame:
    """Alarms of a two-sided CUSUM (allowance half a standard deviation, limit five) that starts anew after each, and the mean since the last one.

    The restart makes it a walk over the key's values, which a task reads in order and does not hold."""
    ids = ["trade_id"] if "trade_id" in trades.columns else []
    rows = trades.where(F.col("r_multiple").isNotNull()).select(by, time, F.col("r_multiple").cast("double").alias("r"), *ids)
    law = rows.groupBy(by).agg(F.avg("r").alias("mu"), F.coalesce(F.stddev_samp("r"), F.lit(1.0)).alias("s")).withColumn("s", F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s")))
    df = rows.join(law, by).repartition(by).sortWithinPartitions(by, time, *_ties(trades, "r")).select(by, "r", "mu", "s")
    kind = dict(df.dtypes)[by]
    out = df.mapInArrow(lambda b: _alarms(b, by), f"`{by}` {kind}, n_changes int, changes string, current_start int, current_mean double")
    return out.withColumn("current_mean", rounded(F.col("current_mean"), 6))


def convergence(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time") -> DataFrame:
    """Spread of the running mean in the second half over the first, and the line through it with its p-value."""
    w = Window.partitionBy(by).orderBy("no").rowsBetween(UP, 0)
    df = _numbered(trades, by, time).withColumn("m", F.avg("r").over(w)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    first = F.col("no") <= F.floor(F.col("n") / 2)
    x = (F.col("no") - 1).cast("double")
    agg = df.groupBy(by).agg(F.max("n").alias("n"), F.stddev_pop(F.when(first, F.col("m"))).alias("a"), F.stddev_pop(F.when(~first, F.col("m"))).alias("b"),
        F.regr_slope("m", x).alias("slope"), F.coalesce(correlation(F.col("m"), x), F.when(F.count("*") > 2, 0.0)).alias("c"))
    spread = F.when((F.col("n") >= 4) & (F.col("a") > 1e-12), F.col("b") / F.when(F.col("a") > 1e-12, F.col("a"))).otherwise(1.0)
    t = F.col("c") * F.sqrt((F.col("n") - 2) / F.when(1 - F.col("c") * F.col("c") > 1e-300, 1 - F.col("c") * F.col("c")))
    p = F.coalesce(t_two_sided(t, F.col("n") - 2), F.lit(0.0))
    return agg.select(by, "n", rounded(spread, 6).alias("convergence_ratio"), (spread < 1).alias("converging"), rounded(F.col("slope"), 8).alias("drift_slope"),
        rounded(t, 3).alias("drift_t"), p.alias("drift_p"), (p < 0.05).alias("drifting"))


def edge_half_life(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", window: int = 50) -> DataFrame:
    """Half-life of the rolling mean R by regressing its changes on its value; the window is at most half of a key's trades, and five at least."""
    w = Window.partitionBy(by).orderBy("no")
    df = _numbered(trades, by, time).withColumn("n", F.count("*").over(Window.partitionBy(by))).withColumn("_w", F.greatest(F.lit(5), F.least(F.lit(window),
        F.floor(F.col("n") / 2))).cast("int"))
    full = F.avg("r").over(w.rowsBetween(-(window - 1), 0))
    few = F.slice(F.collect_list("r").over(w.rowsBetween(-(window - 1), 0)), -F.least(F.col("no"), F.col("_w")), F.least(F.col("no"), F.col("_w")))
    df = df.withColumn("e", F.when(F.col("_w") == window, full).otherwise(F.aggregate(few, F.lit(0.0), lambda s, v: s + v) / F.size(few)))
    df = df.withColumn("prev", F.lag("e").over(w)).withColumn("d", F.col("e") - F.col("prev"))
    agg = df.groupBy(by).agg(F.max("n").alias("n"), F.regr_slope("d", "prev").alias("b"), F.regr_r2("d", "prev").alias("r2"))
    back = (F.col("n") >= 10) & (F.col("b") < 0)
    return agg.select(by, "n", rounded(F.when(back, math.log(2) / -F.when(F.col("b") < -1e-12, F.col("b"))), 1).alias("half_life"), rounded(F.when(F.col("n") >= 10,
        F.greatest(F.lit(0.0), -F.col("b"))), 6).alias("decay_rate"), rounded(F.when(F.col("n") >= 10, F.coalesce("r2",
        F.lit(0.0)))).alias("r2"), F.coalesce(back, F.lit(False)).alias("mean_reverting"))


def rolling_ks(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", window: int = 50) -> DataFrame:
    """Kolmogorov-Smirnov distance of each full window of trades from all of them, its p-value in the limit of large samples,
 and whether it is unstable after Bonferroni's correction."""
    df = _numbered(trades, by, time).withColumn("n", F.count("*").over(Window.partitionBy(by))).withColumn("win", F.floor((F.col("no") - 1) / window).cast("int"))
    all_, own = Window.partitionBy(by).orderBy("r"), Window.partitionBy(by, "win").orderBy("r")
    df = df.withColumn("_fa", F.cume_dist().over(all_)).withColumn("_ga", (F.rank().over(all_) - 1) / F.col("n"))
    df = df.withColumn("_fw", F.cume_dist().over(own)).withColumn("_gw", (F.rank().over(own) - 1) / window)
    df = df.where(F.col("win") < F.floor(F.col("n") / window))
    ks = df.groupBy(by, "win").agg(F.max("n").alias("n"), F.max(F.greatest(F.abs(F.col("_fw") - F.col("_fa")), F.abs(F.col("_gw") - F.col("_ga")))).alias("d"))
    p = kolmogorov_sf(F.col("d") * F.sqrt(F.col("n") * window / (F.col("n") + window)))
    return ks.select(by, "win", rounded(F.col("d"), 6).alias("distance"), rounded(p, 6).alias("p_value"), (p < 0.05 / F.floor(F.col("n") / window)).alias("unstable"))
