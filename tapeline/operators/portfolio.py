"""Daily curves, labels and allocations across strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio, rounded


def calendar(daily: DataFrame, by: str = "strategy") -> DataFrame:
    """Every day of each curve, R 0 where there was no trade, with the running sum."""
    span = daily.groupBy(by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(by, F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day")).withColumn("day", F.col("day").cast("string"))
    w = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.join(daily, [by, "day"], "left").withColumn("r", F.coalesce("r", F.lit(0.0))).withColumn("cumulative_r", F.sum("r").over(w))


def forward_sums(curve: DataFrame, days: int, by: str = "strategy") -> DataFrame:
    """R of the next `days` days, of those that there are; null on the last day."""
    w = Window.partitionBy(by).orderBy("day").rowsBetween(1, days)
    return curve.withColumn("forward_r", F.sum("r").over(w))


def best_label(forward: DataFrame, by: str = "strategy") -> DataFrame:
    """Per day the label with the largest forward R (ties: the first by name), 'none' if no one is above 0, null if all are null."""
    out = forward.groupBy("day").agg(F.max("forward_r").alias("top"), F.min_by(by, F.struct(-F.col("forward_r"), F.col(by))).alias("label"))
    return out.select("day", F.when(F.col("top").isNull(), None).when(F.col("top") <= 0, "none").otherwise(F.col("label")).alias("label"), rounded(F.col("top")).alias("top"))


def allocation(daily: DataFrame, by: str = "strategy", risk: float = 0.01) -> DataFrame:
    """T-7: equal, inverse-volatility and Kelly weights (no negative ones), each summing to 1."""
    x = F.col("r") * risk
    s = daily.groupBy(by).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    s = s.withColumn("iv", F.coalesce(F.try_divide(F.lit(1.0), "sd"), F.lit(0.0))).withColumn("k", F.greatest(F.coalesce(F.try_divide("m",
        F.col("sd") * F.col("sd")), F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy(F.lit(1))  # one row per strategy
    return s.select(by, rounded(1 / F.count("*").over(w)).alias("equal"), rounded(F.coalesce(ratio(F.col("iv"), F.sum("iv").over(w)),
        1 / F.count("*").over(w))).alias("inverse_vol"), rounded(F.coalesce(ratio(F.col("k"), F.sum("k").over(w)), 1 / F.count("*").over(w))).alias("kelly"))


def combined(daily: DataFrame, weights: dict[str, float] | None = None, by: str = "strategy") -> DataFrame:
    """T-8: the weighted curve over the days that any of its labels has, with its peak and drawdown; without weights all labels of the data alike. One row per day,
 so one window."""
    if weights is None:
        n = daily.agg(F.countDistinct(by).alias("_n"))  # one row
        day = daily.join(F.broadcast(n)).groupBy("day").agg(F.sum(F.col("r") / F.col("_n")).alias("r"))
    else:
        weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
        day = daily.where(F.col(by).isin(list(weights))).groupBy("day").agg(F.sum(F.col("r") * weight[F.col(by)]).alias("r"))
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = day.withColumn("equity", F.sum("r").over(w))
    return df.withColumn("drawdown", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))


def equity_line(trades: DataFrame, by: str = "strategy", *, start: float = 10_000.0) -> DataFrame:
    """Of the account after each trade (start + PnL so far): worst drawdown with its day and share of the peak, Sharpe ratio at the key's own trade frequency, gain a
    year and in all over the worst drawdown, fit of a line through the account, and slope of the wins."""
    from .ordering import positions
    from .trades import drawdown

    df = positions(drawdown(trades, by, value="pnl_usd", least=None), [by], "entry_time").withColumn("no", F.col("no") - 1)
    worst = F.max(F.struct("drawdown", (-F.col("no")).alias("no"), "peak", "entry_time"))
    won = (F.col("pnl_usd") > 0).cast("double")
    df = df.groupBy(by).agg(F.count("*").alias("trades"), F.count("r_multiple").alias("k"), worst.alias("w"), F.sum("pnl_usd").alias("pnl"), F.avg("r_multiple").alias("mean"),
        F.stddev_samp("r_multiple").alias("sd"), F.min("entry_time").alias("a"), F.max("entry_time").alias("b"), F.regr_r2("equity", "no").alias("r2"), F.regr_slope(won, "no").alias("slope"))
    seconds = F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))
    df = df.withColumn("days", F.greatest(F.lit(1), F.floor(seconds / 86_400))).withColumn("dd", F.col("w.drawdown"))
    peak = F.col("w.peak") + start
    sharpe = F.when(F.col("k") >= 2, ratio(F.col("mean"), F.col("sd")) * F.sqrt(F.col("k") / (F.col("days") / 365.25))).otherwise(0.0)
    falls = F.col("dd") > 0
    return df.select(by, "trades", rounded(F.col("dd"), 2).alias("max_dd"), rounded(F.when(peak > 0, 100 * F.col("dd") / F.when(peak > 0, peak)).otherwise(0.0)).alias("max_dd_pct"),
        F.to_date("w.entry_time").cast("string").alias("max_dd_date"), rounded(sharpe).alias("sharpe"), rounded(F.when(falls, ratio(F.col("pnl") * 365.25 / F.col("days"), F.col("dd"))).otherwise(0.0)).alias("calmar"),
        rounded(F.when(falls, ratio(F.col("pnl"), F.col("dd"))).otherwise(0.0)).alias("recovery_factor"), rounded(F.when(F.col("trades") >= 5, F.coalesce("r2", F.lit(0.0))).otherwise(0.0)).alias("equity_r2"),
        rounded(F.when(F.col("k") >= 5, F.col("slope")).otherwise(0.0), 8).alias("win_rate_slope"))


def growth_curve(trades: DataFrame, by: str = "strategy", fractions: int = 50, most: float = 0.5) -> DataFrame:
    """T-14: mean log growth for each risked fraction (most / fractions, ..., most); null where one trade would lose everything."""
    f = F.explode(F.transform(F.sequence(F.lit(1), F.lit(fractions)), lambda i: i * most / fractions)).alias("f")
    left = 1 + F.col("f") * F.col("r_multiple")
    return trades.select(by, "r_multiple", f).groupBy(by, "f").agg(F.when(F.min(left) > 0, F.avg(F.when(left > 0, F.ln(left)))).alias("growth"))


def growth_limits(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """T-14: the fraction of best growth, that growth, whether it is above 0, the first fraction after it at which growth is not,
 and the plain Kelly share (0 without a win or a loss)."""
    curve = growth_curve(trades, by)
    w = Window.partitionBy(by).orderBy("f")
    curve = curve.withColumn("_up", F.coalesce(F.col("growth") > 0, F.lit(False))).withColumn("_falls", ~F.col("_up") & F.coalesce(F.lag("_up").over(w), F.lit(False)))
    best = curve.groupBy(by).agg(F.max(F.struct("growth", (-F.col("f")).alias("m"))).alias("t"), F.min(F.when(F.col("_falls"), F.col("f"))).alias("critical"))
    r = F.col("r_multiple")
    kelly = trades.groupBy(by).agg(F.avg(F.when(r > 0, r)).alias("gain"), F.avg(F.when(r < 0, -r)).alias("loss"), F.avg((r > 0).cast("double")).alias("wr"))
    share = F.when(F.col("gain").isNotNull() & F.col("loss").isNotNull(), F.col("wr") - (1 - F.col("wr")) / (F.col("gain") / F.col("loss"))).otherwise(0.0)
    return best.join(kelly, by).select(by, rounded(-F.col("t.m")).alias("optimal_f"), rounded(F.col("t.growth"), 8).alias("max_growth"),
        (F.col("t.growth") > 0).alias("ergodic"), rounded(F.col("critical")).alias("critical_f"), rounded(share, 6).alias("kelly"))


def robustness(trades: DataFrame, by: str = "strategy", asset: str = "symbol") -> DataFrame:
    """T-19: score of a strategy over its assets: 0.30 consistency of mean R (variation 0.15 is 100, 1 is 0), 0.25 share of assets that gain, 0.20 share that gain
    significantly, 0.15 share that agree on the best regime, 0.10 overfit (50, as trades carry no in-sample score); with its grade."""
    from .trades import significance

    per = significance(trades, by, asset)
    regimes = trades.groupBy(by, asset, "regime").agg(F.avg("r_multiple").alias("m")).groupBy(by, asset).agg(F.max(F.struct("m", "regime"))["regime"].alias("best"))
    agree = regimes.groupBy(by, "best").count().groupBy(by).agg((F.max("count") / F.sum("count") * 100).alias("regime_score"))
    spread, middle = F.stddev_pop("mean_r"), F.abs(F.avg("mean_r"))
    cv = F.when(middle > 0, F.try_divide(spread, middle)).when(spread > 0, float("inf")).otherwise(0.0)  # means that cancel are no error: their variation has no bound
    out = per.groupBy(by).agg(F.count("*").alias("assets"), cv.alias("cv"), (F.avg((F.col("mean_r") > 0).cast("double")) * 100).alias("profit_score"),
        (F.avg(F.col("mean_r_significant").cast("double")) * 100).alias("significance_score")).join(agree, by)
    consistency = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("cv")) / 0.85 * 100))
    total = 0.30 * consistency + 0.25 * F.col("profit_score") + 0.20 * F.col("significance_score") + 0.15 * F.col("regime_score") + 5.0
    grade = F.when(total >= 80, "A").when(total >= 65, "B").when(total >= 50, "C").when(total >= 35, "D").otherwise("F")
    return out.select(by, "assets", rounded(consistency, 2).alias("consistency"), rounded(F.col("profit_score"), 2).alias("profitability"),
        rounded(F.col("significance_score"), 2).alias("significance"), rounded(F.col("regime_score"), 2).alias("regime_stability"), rounded(total,
        2).alias("score"), grade.alias("grade"))


def account_ratios(values: DataFrame, *, start: float, by: str = "strategy", periods: int = 252) -> DataFrame:
    """Calmar ratio, maximum drawdown and annual return in percent, and alpha, tracking error and information ratio against holding the asset. values: by, day, value, bench (its price)."""
    w = Window.partitionBy(by).orderBy("day")
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.max("value").over(up), F.lit(float(start)))
    diff = F.col("value") / F.lag("value").over(w) - F.col("bench") / F.lag("bench").over(w)
    df = values.withColumn("_dd", (peak - F.col("value")) / peak).withColumn("_diff", diff)
    agg = df.groupBy(by).agg(
        F.count("*").alias("days"), (F.max_by("value", "day") / start - 1).alias("total"), (F.max_by("bench", "day") / F.min_by("bench", "day") - 1).alias("held"),
        F.max("_dd").alias("dd"), F.avg("_diff").alias("m"), F.stddev_pop("_diff").alias("sd"),
    )
    annual, te = F.pow(1 + F.col("total"), periods / F.col("days")) - 1, F.col("sd") * periods**0.5
    calmar = F.when(F.col("dd") > 1e-10, annual / F.when(F.col("dd") > 1e-10, F.col("dd"))).otherwise(0.0)
    ratio_ = F.when(te > 1e-10, F.col("m") * periods / F.when(te > 1e-10, te)).otherwise(0.0)
    return agg.select(
        by, "days", rounded(calmar).alias("calmar"), rounded(F.col("dd") * 100, 2).alias("max_drawdown_pct"), rounded(annual * 100, 2).alias("annual_return_pct"),
        rounded((F.col("total") - F.col("held")) * 100, 2).alias("alpha_pct"), rounded(te).alias("tracking_error"), rounded(ratio_).alias("information_ratio"),
    )


def spaced(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each key at even distances along `order`, the first and the last among them; all of a key with fewer."""
    no, n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(*by))
    df = df.withColumn("_r", no.cast("long")).withColumn("_n", n)
    i = F.expr(f"CASE WHEN _n > 1 THEN (_r * {most - 1}L + _n - 2) div (_n - 1) ELSE 0L END")
    hit = (F.col("_n") <= most) | (F.expr(f"({{i}} * (_n - 1)) div {most - 1}L".replace("{i}", "_i")) == F.col("_r"))
    return df.withColumn("_i", i).where(hit).drop("_r", "_n", "_i")


def derived_r(trades: DataFrame) -> DataFrame:
    """R by the distance of the stop `sl` from the entry, and percent gained, both by direction."""
    move = F.col("exit_price") - F.col("entry_price")
    signed = F.when(F.col("direction") == "LONG", move).otherwise(-move)
    return trades.withColumns({"r": F.try_divide(signed, F.abs(F.col("entry_price") - F.col("sl"))), "pnl_pct": signed / F.col("entry_price") * 100})


def long_short(trades: DataFrame, held: str) -> DataFrame:
    """By strategy and direction the mean R, trades held over five times the median of all, the longest losing streak, and mean win over mean loss."""
    pnl = F.col("pnl_usd")
    median = trades.agg(F.percentile(held, F.lit(0.5)).alias("_median"))  # one row
    w = Window.partitionBy("strategy", "direction").orderBy("entry_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = trades.join(F.broadcast(median)).withColumn("_run", F.sum((pnl > 0).cast("long")).over(w))
    df = df.withColumn("_streak", F.when(pnl > 0, 0).otherwise(F.count(F.when(pnl <= 0, 1)).over(Window.partitionBy("strategy", "direction", "_run"))))
    return df.groupBy("strategy", "direction").agg(F.count("*").alias("n"), rounded(F.avg("r_multiple")).alias("mean_r"),
        F.sum((F.col(held) > 5 * F.col("_median")).cast("long")).alias("long_holds"), F.max("_streak").cast("long").alias("losing_streak"), rounded(F.abs(F.try_divide(F.avg(F.when(pnl > 0, pnl)), F.avg(F.when(pnl < 0, pnl))))).alias("asymmetry"))


def splits(groups: int, tests: int, purge: int) -> list[tuple[list[int], list[int]]]:
    """T-6: train and test groups of combinatorial purged cross-validation; groups within `purge` of a test group train in none. A small list."""
    from itertools import combinations

    out = []
    for test in combinations(range(groups), tests):
        near = {g + d for g in test for d in range(-purge, purge + 1)}
        train = [g for g in range(groups) if g not in near]
        if train and test:
            out.append((train, list(test)))
    return out


def purged_scores(trades: DataFrame, by: str = "strategy", *, groups: int = 6, tests: int = 2, purge: int = 1) -> DataFrame:
    """T-6: mean R of the training and the test trades of each split; a key's trades in order of time are cut into equal groups (the last takes what is left over).

    Groups are added up first, so splits cost a row per group of a key."""
    from .ordering import positions

    df = positions(trades.where(F.col("r_multiple").isNotNull()).select(by, "entry_time", "r_multiple"), [by], "entry_time", ("r_multiple",))
    n = df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= groups)
    group = F.least(F.floor((F.col("no") - 1) / F.floor(F.col("_n") / groups)), F.lit(groups - 1)).cast("int")
    sums = df.join(n, by).groupBy(by, group.alias("group")).agg(F.count("*").alias("k"), F.sum("r_multiple").alias("s"))
    roles = [(i, g, role) for i, parts in enumerate(splits(groups, tests, purge), 1) for role, part in zip(("train", "test"), parts, strict=True) for g in part]
    rows = sums.join(trades.sparkSession.createDataFrame(roles, "split int, group int, role string"), "group")  # a small list
    of = lambda role, c: F.sum(F.when(F.col("role") == role, F.col(c)))
    return rows.groupBy(by, "split").agg(of("train", "k").alias("n_train"), of("test", "k").alias("n_test"), rounded(of("train", "s") / of("train", "k")).alias("train_r"), rounded(of("test", "s") / of("test", "k")).alias("test_r"))


def overfit_probability(scores: DataFrame) -> DataFrame:
    """T-6: share of rows (row, combo, is_score, oos_score) whose in-sample best ranks in the lower half out of sample; average ranks for ties."""
    w = Window.partitionBy("row")
    df = scores.withColumn("_best", F.row_number().over(w.orderBy(F.desc("is_score"), "combo")))
    rank = F.rank().over(w.orderBy("oos_score")) + (F.count("*").over(Window.partitionBy("row", "oos_score")) - 1) / 2
    df = df.withColumn("_share", rank / F.count("*").over(w)).where("_best = 1")
    return df.agg(F.count("*").alias("rows"), rounded(F.avg((F.col("_share") <= 0.5).cast("double"))).alias("pbo"))
