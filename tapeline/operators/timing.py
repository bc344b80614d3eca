"""When trades do well: execution by hour, tested buckets, periods against each other (A7, A11, A15, A16, A19, A23, A25, T-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_two_sided
from ..functions.metrics import profit_factor, ratio, rounded, share, won
from .trades import session_of

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def execution_by_hour(trades: DataFrame) -> DataFrame:
    """Mean and median of favourable over adverse excursion for each of the 24 hours, of trades that have both."""
    each = F.col("mfe") / (F.col("mae") + 1e-10)
    per = trades.where("mfe IS NOT NULL AND mae > 0").groupBy(F.hour("entry_time").alias("hour")).agg(F.count("*").alias("n"), rounded(F.avg("mfe"),
        6).alias("mean_mfe"), rounded(F.avg("mae"), 6).alias("mean_mae"), rounded(F.avg(each)).alias("mfe_mae_ratio"), rounded(F.percentile(each,
        F.lit(0.5))).alias("median_ratio"))
    return trades.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(per, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def timing_recommendations(trades: DataFrame, *, least: int = 30, alpha: float = 0.05) -> DataFrame:
    """Hours, sessions and weekdays with at least `least` trades against the mean of the eligible hours: p-value, Bonferroni verdict over all buckets,
 best or worst and the place among these.

    Hours must also lie beyond the baseline; `avoid` marks the three worst hours and the worst session, as the reference suggests them."""
    r = F.col("r_multiple")
    kinds = {"hour": F.format_string("%02d", F.hour("entry_time")), "session": session_of(F.col("entry_time"), "utc"), "day": F.element_at(F.array(*map(F.lit,
        DAYS)), F.weekday("entry_time") + 1)}
    rows = trades.select("r_multiple", "outcome", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("bucket")) for k,
        v in kinds.items()])).alias("b")).select("r_multiple", "outcome", "b.*")
    per = rows.groupBy("kind", "bucket").agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), share(won()).alias("wr"),
        F.sum(r).alias("total")).where(F.col("n") >= least)
    every = Window.partitionBy(F.lit(1))  # at most 24 + 7 + sessions rows
    hours = F.col("kind") == "hour"
    base = F.coalesce(ratio(F.sum(F.when(hours, F.col("m") * F.col("n"))).over(every), F.sum(F.when(hours, F.col("n"))).over(every)), F.lit(0.0))
    df = per.withColumn("base", base).withColumn("tests", F.count("*").over(every))
    z = (F.col("m") - F.col("base")) / (F.col("s") / F.sqrt("n"))
    p = F.when(F.col("s") > 0, normal_two_sided(z)).otherwise(1.0)
    best, worst = (F.col("m") > 0) & (~hours | (F.col("m") > F.col("base"))), (F.col("m") < 0) & (~hours | (F.col("m") < F.col("base")))
    df = df.withColumn("p", p).withColumn("verdict", F.when(best, "best").when(worst, "worst"))
    df = df.withColumn("place", F.when(F.col("verdict").isNotNull(), F.row_number().over(Window.partitionBy("kind",
        "verdict").orderBy(F.when(F.col("verdict") == "best", -F.col("m")).otherwise(F.col("m")), "bucket"))))
    significant = F.col("p") < alpha / F.col("tests")
    return df.select("kind", "bucket", "n", rounded(F.col("m")).alias("mean_r"), rounded(F.col("wr")).alias("win_rate"), rounded(F.col("total")).alias("total_r"),
        rounded(F.col("p"), 6).alias("p_value"), significant.alias("significant"), "verdict", F.col("place").cast("int").alias("place"), F.coalesce((F.col("verdict") == "worst") & (F.col("kind") != "day") & (F.col("place") <= F.when(hours, 3).otherwise(1)), F.lit(False)).alias("avoid"))


def closed_stats(trades: DataFrame) -> DataFrame:
    """One row over closed trades."""
    pnl = F.col("pnl_usd")
    return trades.where("exit_time IS NOT NULL").agg(F.count("*").alias("total"), F.sum((pnl > 0).cast("long")).alias("wins"), rounded(F.sum(pnl),
        2).alias("total_pnl"), rounded(F.sum("fees_usd"), 2).alias("total_fees"), F.max(pnl).alias("best_trade"), F.min(pnl).alias("worst_trade"), rounded(F.coalesce(100 * share(pnl > 0), F.lit(0.0)), 1).alias("win_rate"))


def session_summary(trades: DataFrame) -> DataFrame:
    """By strategy and session."""
    r = F.col("r_multiple")
    return trades.withColumn("session", session_of(F.col("entry_time"))).groupBy("strategy", "session").agg(F.count("*").alias("trades"), rounded(F.sum(r),
        3).alias("total_r"), rounded(F.avg(r), 3).alias("avg_r"), F.sum((r > 0).cast("long")).alias("wins"), rounded(100 * share(r > 0), 1).alias("win_rate"))


def training_stats(trades: DataFrame, *by: str | Column) -> DataFrame:
    """Trades, wins, money, profit factor (infinite without a loss) and mean excursions by strategy, hour or other keys."""
    pnl = F.col("pnl_usd")
    return trades.groupBy(*by).agg(F.count("*").alias("trades"), F.sum(won().cast("long")).alias("wins"), rounded(share(won())).alias("win_rate"),
        rounded(F.sum(pnl), 2).alias("pnl"), rounded(F.coalesce(profit_factor(pnl),
        F.lit(float("inf")))).alias("profit_factor"), rounded(F.avg("r_multiple")).alias("avg_r"), rounded(F.avg("mfe")).alias("avg_mfe"), rounded(F.avg("mae")).alias("avg_mae"))


def training_readiness(trades: DataFrame, least: int = 50) -> DataFrame:
    """Per strategy how many trades can train a model (closed, with outcome and excursions), and whether that is enough."""
    usable = F.col("exit_time").isNotNull() & F.col("outcome").isNotNull() & F.col("mfe").isNotNull() & F.col("mae").isNotNull()
    n = F.sum(usable.cast("long"))
    return trades.groupBy("strategy").agg(F.count("*").alias("trades"), n.alias("usable"), (n >= least).alias("ready"))


def period_review(trades: DataFrame, period: Column, *, by: str = "strategy") -> DataFrame:
    """Best and worst period, the longest run of losing ones, the share that gained, and the last two against the earlier ones by profit factor and win rate."""
    r, w = F.col("r_multiple"), Window.partitionBy(by).orderBy("period")
    per = trades.groupBy(by, period.alias("period")).agg(F.sum(r).alias("total"), share(r > 0).alias("wr"), profit_factor(F.col("pnl_usd")).alias("pf"), F.count("*").alias("k"))
    per = per.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("period")))).withColumn("_run",
        F.sum((F.col("total") >= 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("streak", F.when(F.col("total") < 0, F.count(F.when(F.col("total") < 0, 1)).over(Window.partitionBy(by, "_run"))).otherwise(0))
    late = F.col("back") <= 2
    mean = lambda c, late_: F.avg(F.when(late_, F.col(c)))
    return per.groupBy(by).agg(
        F.count("*").alias("periods"), F.max(F.struct("total", F.col("period").alias("p")))["p"].alias("best"), F.min(F.struct("total",
            F.col("period").alias("p")))["p"].alias("worst"), F.max("streak").cast("long").alias("losing_streak"),
        rounded(share(F.col("total") > 0)).alias("share_profitable"), rounded(mean("pf", late)).alias("recent_pf"), rounded(mean("pf",
            ~late)).alias("earlier_pf"), rounded(mean("wr", late)).alias("recent_wr"), rounded(mean("wr", ~late)).alias("earlier_wr"), rounded(F.avg("k")).alias("mean_trades"),
    )


def shadow_aggregates(matched: DataFrame) -> DataFrame:
    """Mean gaps of entry, exit and R between live and shadow trades, the R lost in all, and how often the outcomes agree. matched: pairs with live_ and shadow_ columns."""
    pct = lambda c: (F.col(f"live_{c}") - F.col(f"shadow_{c}")) / F.col(f"shadow_{c}") * 100
    gap = F.col("live_r") - F.col("shadow_r")
    return matched.agg(F.count("*").alias("n"), rounded(F.avg(pct("entry")), 6).alias("mean_entry_gap_pct"), rounded(F.avg(pct("exit")),
        6).alias("mean_exit_gap_pct"), rounded(F.avg(gap)).alias("mean_r_gap"), rounded(F.sum(gap)).alias("total_drag_r"), rounded(share(F.col("live_outcome") == F.col("shadow_outcome"))).alias("outcome_agreement"))


def calendar_pivot(trades: DataFrame, by: str = "strategy", time: str = "exit_time") -> DataFrame:
    """A10: total R by key and year, a column for each month (null without a trade) and one for the year."""
    month, r = F.month(time), F.col("r_multiple")
    return trades.groupBy(by, F.year(time).alias("year")).agg(*[rounded(F.sum(F.when(month == m, r))).alias(f"m{m:02d}") for m in range(1, 13)], rounded(F.sum(r)).alias("total"))


def label_shares(trades: DataFrame, labels: DataFrame, time: str = "exit_time") -> DataFrame:
    """How a day's label is spread over the regimes of its trades: share of each label within a regime. labels: day, label."""
    per = trades.select("regime", F.to_date(time).cast("string").alias("day")).join(labels.where("label IS NOT NULL"), "day").groupBy("regime",
        "label").agg(F.count("*").alias("n"))
    return per.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("regime"))))
