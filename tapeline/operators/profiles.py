"""T-16, T-17 and their scores of T-18: where an edge lies, by regime and by the time that trades are held, and how long it lasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio, rounded
from .ordering import in_blocks, positions
from .sequences import edge_half_life
from .statistics import autocorrelation

BINS = range(3, 9)  # how many bins there can be
GRADES = ((80, "A"), (60, "B"), (40, "C"), (20, "D"))


def _steps(x: Column, steps: tuple[tuple[float, float], ...], rest: float) -> Column:
    """The value of the first bound that x is above, else `rest`."""
    out = F.lit(rest)
    for bound, value in reversed(steps):
        out = F.when(x > bound, F.lit(value)).otherwise(out)
    return out


def regime_edge(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-16: per regime (null: 'unknown') count, share of trades, mean and spread of R (0 for one trade), win rate by R and expectancy. Trades without R are left out."""
    r = F.col("r_multiple")
    df = trades.where(r.isNotNull()).groupBy(by, F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count("*").alias("n"), F.avg(r).alias("mean_r"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_r"), F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("_gain"),
        F.coalesce(-F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("_loss"))
    expectancy = F.col("win_rate") * F.col("_gain") - (1 - F.col("win_rate")) * F.col("_loss")
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by))  # a row a regime
    return df.select(by, "regime", "n", rounded(share).alias("share"), *[rounded(F.col(c)).alias(c) for c in ("mean_r", "std_r", "win_rate")], rounded(expectancy).alias("expectancy"))


def regime_steps(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-16: from_regime, to_regime, n: steps from trade to trade within a key, in blocks of its trades."""
    df = trades.select(by, "entry_time", "trade_id", F.coalesce("regime", F.lit("unknown")).alias("regime"))
    df = in_blocks(positions(df, [by], "entry_time", ("trade_id",)), [by], 1)
    before = F.lag("regime").over(Window.partitionBy(by, "_block").orderBy("no"))
    df = df.withColumn("from_regime", before).where("NOT _halo AND from_regime IS NOT NULL")
    return df.groupBy(by, "from_regime", F.col("regime").alias("to_regime")).agg(F.count("*").alias("n"))


def stationary(steps: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-16: the long-run share of each regime under the chain of `regime_steps`: the shares that a step leaves as they are (of several such laws the one with the least
    sum of squares; a regime that nothing follows keeps to itself).

    A task gets one key's chain, regimes squared rows."""

    def solve(key, df):
        import numpy as np
        import pandas as pd

        names = sorted(set(df["from_regime"]) | set(df["to_regime"]))
        at = {x: i for i, x in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        a[df["from_regime"].map(at), df["to_regime"].map(at)] = df["n"]
        a[a.sum(1) == 0] += np.eye(len(names))[a.sum(1) == 0]
        a /= a.sum(1, keepdims=True)
        law = np.linalg.lstsq(np.vstack([a.T - np.eye(len(names)), np.ones(len(names))]), np.append(np.zeros(len(names)), 1.0), rcond=None)[0]
        return pd.DataFrame({by: [key[0]] * len(names), "regime": names, "law": law.clip(0, 1)})

    kind = dict(steps.dtypes)[by]
    return steps.groupBy(by).applyInPandas(solve, f"`{by}` {kind}, regime string, law double")


def hold_edges(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-17: by, edges: the ends of three to eight bins (one for ten trades) of bars held, by quantiles without repeats; where fewer than two bins are left, of equal width."""
    b = F.col("bars_held")
    cuts = [F.percentile(b, F.array(*[F.lit(k / m) for k in range(m + 1)])).alias(f"q{m}") for m in BINS]
    df = trades.groupBy(by).agg(F.count("*").alias("_n"), F.min(b).cast("double").alias("_a"), F.max(b).cast("double").alias("_b"), *cuts)
    m = F.least(F.lit(BINS[-1]), F.greatest(F.lit(BINS[0]), F.floor(F.col("_n") / 10))).cast("int")
    own = F.element_at(F.array(*[F.col(f"q{k}") for k in BINS]), m - BINS[0] + 1)
    own = F.array_sort(F.array_distinct(F.transform(own, lambda x: F.round(x, 6))))  # interpolation may differ in the last bit
    even = F.transform(F.sequence(F.lit(0), m), lambda k: F.col("_a") + (F.col("_b") + 1 - F.col("_a")) * k / m)
    return df.select(by, F.when(F.size(own) < 3, even).otherwise(own).alias("edges"))


def hold_profiles(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-17: per bin of bars held (from `low` to below `high`, the last one closed) count, mean favourable and adverse excursion, their ratio (the adverse one 0.01 at least),
    mean R and win rate, and which bin has the best ratio and which the best mean R (ties: the earlier). Trades without bars or R are left out."""
    df = trades.where("bars_held IS NOT NULL AND r_multiple IS NOT NULL")
    df = df.join(hold_edges(df, by=by), by)
    edges, r = F.col("edges"), F.col("r_multiple")
    no = F.least(F.size(F.filter(edges, lambda x: x <= F.col("bars_held"))), F.size(edges) - 1)
    df = df.groupBy(by, no.alias("bin")).agg(F.count("*").alias("n"), F.first(F.element_at(edges, no)).alias("low"), F.first(F.element_at(edges, no + 1)).alias("high"),
        F.coalesce(F.avg("mfe"), F.lit(0.0)).alias("_f"), F.coalesce(F.avg(F.abs("mae")), F.lit(0.0)).alias("_a"), F.avg(r).alias("_r"), F.avg((r > 0).cast("double")).alias("_w"))
    df = df.withColumn("_q", F.col("_f") / F.greatest("_a", F.lit(0.01)))
    key = Window.partitionBy(by)  # eight bins at most
    best = lambda x: F.col("bin") == F.min_by("bin", F.struct(-rounded(F.col(x), 9), F.col("bin"))).over(key)
    return df.select(by, "bin", rounded(F.col("low"), 1).alias("low"), rounded(F.col("high"), 1).alias("high"), "n", rounded(F.col("_f")).alias("mean_mfe"), rounded(F.col("_a")).alias("mean_mae"),
        rounded(F.col("_q")).alias("mfe_mae_ratio"), rounded(F.col("_r")).alias("mean_r"), rounded(F.col("_w")).alias("win_rate"), best("_q").alias("best_ratio"), best("_r").alias("best_mean"))


def decay_score(trades: DataFrame, *, by: str = "strategy", lags: int = 20) -> DataFrame:
    """T-18, signal decay: 50 and points for the best holding time, most bins above 0, the best ratio of excursions, independent trades and a slow loss of the edge."""
    bins = hold_profiles(trades, by=by).groupBy(by).agg(F.max("mean_r").alias("best"), F.avg((F.col("mean_r") > 0).cast("double")).alias("above"), F.max("mfe_mae_ratio").alias("ratio"))
    n = trades.groupBy(by).agg(F.count("*").alias("_n")).withColumn("_lags", F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(F.col("_n") / 3))))
    acf = autocorrelation(trades, by=by, lags=lags).join(n, by).where(F.col("lag") <= F.col("_lags"))
    acf = acf.groupBy(by).agg(F.max_by("ljung_box_p", "lag").alias("p"), F.count_if("significant").alias("hits"))
    best, half = F.col("best"), F.when(F.col("mean_reverting"), F.col("half_life"))
    points = _steps(best, ((0.3, 25.0), (0.1, 15.0), (0.0, 10.0), (-0.05, -10.0), (-0.2, -20.0)), -30.0) + F.when((best > 0) & (F.col("above") > 0.5), 5.0).otherwise(0.0)
    points += F.when(F.col("ratio") > 2, 5.0).when(F.col("ratio") < 0.8, -5.0).otherwise(0.0)
    points += F.when(F.coalesce("p", F.lit(1.0)) > 0.05, 5.0).when(F.col("hits") > 3, -10.0).otherwise(-5.0) + F.when(half < 20, -10.0).when(half < 50, -5.0).otherwise(0.0)
    df = bins.join(acf, by, "left").join(edge_half_life(trades, by=by).select(by, "half_life", "mean_reverting"), by, "left")
    return df.select(by, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + points)).alias("score"))


def regime_score(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-18, regime edge: high where all regimes pay, fair where the one that holds most trades (ties: the first by name) has over half and pays, low where none does."""
    df = regime_edge(trades, by=by).groupBy(by).agg(F.min("mean_r").alias("worst"), F.max("mean_r").alias("best"), F.sum("n").alias("_n"), F.max("n").alias("top"),
        F.min_by("mean_r", F.struct(-F.col("n"), F.col("regime"))).alias("main"))
    worst, best, main = F.col("worst"), F.col("best"), F.col("main")
    every = F.when(worst > 0.1, F.least(F.lit(95.0), 85 + worst * 10)).otherwise(85.0)
    most = F.least(F.lit(80.0), 65 + F.when(main > 0.2, 10.0).otherwise(0.0) - F.when(worst < -0.3, 10.0).otherwise(0.0))
    none = F.when(best > -0.05, 25.0).otherwise(F.greatest(F.lit(5.0), 15 + best * 10))
    return df.select(by, F.when(worst > 0, every).when((main > 0) & (ratio(F.col("top"), F.col("_n")) > 0.5), most).when(best > 0, 40.0).otherwise(none).alias("score"))


def skill_scores(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-18: by, skill, score from 0 to 100 and its grade."""
    df = decay_score(trades, by=by).withColumn("skill", F.lit("signal_decay")).unionByName(regime_score(trades, by=by).withColumn("skill", F.lit("regime_edge")))
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return df.select(by, "skill", rounded(F.col("score")).alias("score"), grade.alias("grade"))
