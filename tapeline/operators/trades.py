"""Aggregations, filters and set operations over trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import binomial_at_least, normal_two_sided, t_quantile, t_two_sided
from ..functions.metrics import correlation, profit_factor, ratio, rounded, share, wilson, won

R, PNL = F.col, F.col

#: Session calendars as (calendar, session, zone, first hour, hour after the last). Fixed values; a dimension table, never code.
SESSIONS = [
    ("core", "Asia", "America/New_York", 19, 24),
    ("core", "Asia", "America/New_York", 0, 3),
    ("core", "London", "America/New_York", 3, 8),
    ("core", "New York", "America/New_York", 8, 16),
    ("utc", "Asia", "UTC", 0, 8),
    ("utc", "London", "UTC", 8, 13),
    ("utc", "New York", "UTC", 13, 21),
]


def session_of(ts: Column, calendar: str = "core") -> Column:
    """Session name of a UTC time by a calendar, else 'Off-Hours'."""
    out = F.lit("Off-Hours")
    for name, session, zone, begin, end in reversed(SESSIONS):
        if name == calendar:
            hour = F.hour(F.from_utc_timestamp(ts, zone))
            out = F.when((hour >= begin) & (hour < end), session).otherwise(out)
    return out


def performance(trades: DataFrame, *by: str) -> DataFrame:
    """A1-A3: counts, win rate, R and profit factor of closed trades by any keys."""
    r = F.col("r_multiple")
    return (
        trades.where("exit_time IS NOT NULL")
        .groupBy(*by)
        .agg(
            F.count("*").alias("total_trades"),
            F.sum((r > 0).cast("long")).alias("wins"),
            F.sum((r <= 0).cast("long")).alias("losses"),
            rounded(100 * share(r > 0), 2).alias("win_rate"),
            rounded(F.sum(r), 3).alias("total_r"),
            rounded(F.avg(r)).alias("avg_r"),
            rounded(F.avg(F.when(r > 0, r))).alias("avg_winner"),
            rounded(F.avg(F.when(r <= 0, r))).alias("avg_loser"),
            rounded(profit_factor(r)).alias("profit_factor"),
            rounded(F.avg("mfe")).alias("avg_mfe"),
            rounded(F.avg("mae")).alias("avg_mae"),
            rounded(F.avg("bars_held"), 2).alias("avg_bars"),
        )
    )


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of value up to each row along `order` within `by`; rows of one place in that order are peers, as in SQL, and have their sum in common. Sums run inside a day of order's first column and start from one carried row per day, so a hot key is spread over its days."""
    day = [*by, "_rday"]
    df = df.withColumn("_rday", F.to_date(order[0])).withColumn("_rv", value)
    before = Window.partitionBy(*by).orderBy("_rday").rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(*day).agg(F.sum("_rv").alias("_rt")).select(*day, F.coalesce(F.sum("_rt").over(before), F.lit(0)).alias("_rb"))
    inside = Window.partitionBy(*day).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(days, day).withColumn(name, F.col("_rb") + F.sum("_rv").over(inside)).drop("_rday", "_rv", "_rb")


def drawdown(trades: DataFrame, *by: str, value: str = "r_multiple", time: str = "entry_time", least: float | None = 0.0) -> DataFrame:
    """Equity, peak (never below `least`; None: the first equity is the first peak) and drawdown after each trade; trades of one time are peers (see `running`).

    Running sums go over the trades of one key and day; what the days before leave (sum and peak) comes from one row per day, so a hot key is spread over its days."""
    day = [*by, "_day"]
    df = trades.withColumn("_day", F.to_date(time))
    inside = Window.partitionBy(*day).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_own", F.sum(value).over(inside))
    days = df.groupBy(*day).agg(F.sum(value).alias("_total"), F.max("_own").alias("_top"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.max(F.col("_before") + F.col("_top")).over(before), F.lit(least).cast("double"))).select(*day, "_before", "_peak")
    df = df.join(days, day).withColumn("equity", F.col("_before") + F.col("_own"))
    df = df.withColumn("peak", F.greatest(F.max("equity").over(inside), F.col("_peak")))
    return df.withColumn("drawdown", F.col("peak") - F.col("equity")).select(*trades.columns, "equity", "peak", "drawdown")


def summary(trades: DataFrame) -> DataFrame:
    """A5: by strategy, symbol and source, with the maximum drawdown in PnL over time (its peak begins at the first trade). Without a loss the profit factor is infinite, or 0 without a gain."""
    by = ("strategy", "symbol", "source")
    w = Window.partitionBy(*by).orderBy("entry_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = trades.withColumn("_equity", F.sum("pnl_usd").over(w))
    return (
        df.withColumn("_own_drawdown", F.max("_equity").over(w) - F.col("_equity"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("trades"),
            rounded(100 * share(F.col("pnl_usd") > 0), 2).alias("win_rate"),
            rounded(F.sum("pnl_usd"), 2).alias("pnl"),
            rounded(F.sum("r_multiple")).alias("total_r"),
            rounded(F.avg("r_multiple")).alias("avg_r"),
            rounded(F.coalesce(profit_factor(F.col("pnl_usd")), F.when(F.max("pnl_usd") > 0, float("inf")).otherwise(0.0))).alias("profit_factor"),
            rounded(F.max("_own_drawdown"), 2).alias("max_dd"),
        )
    )


def bucket_metrics(trades: DataFrame, bucket: Column, buckets: list | None = None) -> DataFrame:
    """N, win rate, mean, total and spread of R, excursions; dense over `buckets` where given."""
    r = F.col("r_multiple")
    out = (
        trades.groupBy(bucket.alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            rounded(share(won())).alias("win_rate"),
            rounded(F.avg(r)).alias("mean_r"),
            rounded(F.sum(r), 3).alias("total_r"),
            rounded(F.stddev_samp(r)).alias("std_r"),
            rounded(F.avg("mfe")).alias("avg_mfe"),
            rounded(F.avg("mae")).alias("avg_mae"),
            rounded(ratio(F.avg("mfe"), F.avg("mae"))).alias("mfe_mae"),
        )
    )
    if buckets is None:
        return out
    dense = trades.sparkSession.createDataFrame([(b,) for b in buckets], f"bucket {dict(out.dtypes)['bucket']}")
    return F.broadcast(dense).join(out, "bucket", "left").fillna(0, ["n"])


def hold_durations(trades: DataFrame) -> DataFrame:
    """The bars held of all trades, and their correlation with R (from six trades on) with its p-value by the normal law."""
    df = trades.where(F.col("bars_held").isNotNull())
    b = F.col("bars_held")
    q = F.percentile(b, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
    df = df.agg(F.count("*").alias("n"), F.avg(b).alias("mean"), F.stddev_samp(b).alias("sd"), F.min(b).alias("low"), F.max(b).alias("high"), q.alias("q"), correlation(b, F.col("r_multiple")).alias("c"))
    c = F.when(F.col("n") > 5, F.col("c"))
    t = F.abs(c) * F.sqrt(F.try_divide(F.col("n") - 2, 1 - c * c))
    p = F.when(F.abs(c) < 1, normal_two_sided(t)).when(c.isNotNull(), 0.0)
    return df.where("n > 0").select("n", rounded(F.col("mean")).alias("mean_bars"), rounded(F.coalesce("sd", F.lit(0.0))).alias("std_bars"), F.col("low").alias("min_bars"),
        F.col("high").alias("max_bars"), *[rounded(F.col("q")[i]).alias(f"p{k}") for i, k in enumerate((25, 50, 75, 90))], rounded(c).alias("pearson_r"),
        rounded(p, 6).alias("p_value"), (p < 0.05).alias("significant"))


def hold_by_outcome(trades: DataFrame) -> DataFrame:
    """Count, mean and median of the bars held by outcome."""
    df = trades.where(F.col("bars_held").isNotNull()).groupBy("outcome").agg(F.count("*").alias("n"), F.avg("bars_held").alias("mean"), F.percentile("bars_held", F.lit(0.5)).alias("q"))
    return df.select("outcome", "n", rounded(F.col("mean")).alias("mean_bars"), rounded(F.col("q")).alias("median_bars"))


def exit_reasons(trades: DataFrame) -> DataFrame:
    """Count and share of outcomes in each strategy, with their rank."""
    w = Window.partitionBy("strategy")
    df = trades.groupBy("strategy", "outcome").agg(F.count("*").alias("n"))
    return df.withColumn("share", rounded(F.col("n") / F.sum("n").over(w))).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "outcome")))


def monthly(trades: DataFrame) -> DataFrame:
    """A3/A10: by strategy and calendar month of exit."""
    return performance(trades.withColumn("month", F.date_format("exit_time", "yyyy-MM")), "strategy", "month")


def confidence_buckets(trades: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Right-closed buckets, the lowest edge included."""
    x, b = F.col(value), F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low = (x >= edges[0]) if i == 1 else (x > edges[i - 1])
        b = F.when(low & (x <= edges[i]), i - 1).otherwise(b)
    return trades.withColumn("bucket", b).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), rounded(share(won())).alias("win_rate"),
        rounded(F.avg("r_multiple")).alias("mean_r"))


def edge_ratios(trades: DataFrame) -> DataFrame:
    """Edge ratio, entry efficiency (R kept of the best excursion) and stop efficiency."""
    m, a, r = F.col("mfe"), F.col("mae"), F.col("r_multiple")
    return trades.groupBy("strategy").agg(
        rounded(ratio(F.avg(m), F.avg(a))).alias("edge_ratio"),
        rounded(F.avg(F.when((m > 0) & (r > 0), F.try_divide(r, m)))).alias("entry_efficiency"),
        rounded(share((a < 1) & (r > 0))).alias("stop_efficiency"),
    )


def regime_direction(trades: DataFrame) -> DataFrame:
    """By regime, by direction and overall in one pass."""
    r = F.col("r_multiple")
    return (
        trades.groupingSets([[F.col("regime"), F.col("direction")], [F.col("regime")], [F.col("direction")], []], F.col("regime"), F.col("direction"))
        .agg(F.count("*").alias("n"), rounded(share(won())).alias("win_rate"), rounded(F.sum(r), 3).alias("total_r"), rounded(F.avg(r)).alias("mean_r"))
        .select(F.coalesce("regime", F.lit("all")).alias("regime"), F.coalesce("direction", F.lit("all")).alias("direction"), "n", "win_rate", "total_r", "mean_r")
    )


def completeness(df: DataFrame) -> DataFrame:
    """Nulls and null share of every column, in one pass."""
    n = F.count("*")
    wide = df.agg(*[F.struct(n.alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("nulls")).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["n"].alias("n"),
        F.col(c)["nulls"].alias("nulls")) for c in df.columns])).alias("x")).select("x.*").withColumn("missing_share", rounded(ratio(F.col("nulls"), F.col("n"))))


def filtered(trades: DataFrame, *, strategies: list[str] | None = None, symbols: list[str] | None = None, sources: list[str] | None = None, start: str | None = None,
    end: str | None = None, pnl: tuple[float, float] | None = None) -> DataFrame:
    """Any of the optional filters; dates are inclusive."""
    for column, values in (("strategy", strategies), ("symbol", symbols), ("source", sources)):
        if values is not None:
            trades = trades.where(F.col(column).isin(values))
    if start:
        trades = trades.where(F.to_date("entry_time") >= F.to_date(F.lit(start)))
    if end:
        trades = trades.where(F.to_date("entry_time") <= F.to_date(F.lit(end)))
    return trades.where(F.col("pnl_usd").between(*pnl)) if pnl else trades


def first_by_priority(trades: DataFrame, keys: list[str], ranks: dict[str, int]) -> DataFrame:
    """One row per key, by source priority, then the earliest trade_id."""
    rank = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in ranks.items()], F.lit(len(ranks) + 1))
    w = Window.partitionBy(*keys).orderBy(rank, "entry_time", "trade_id")
    return trades.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def position_size(trades: DataFrame, nav: float, risk: float, cap: float) -> DataFrame:
    """Units so that a stop at `mae` percent loses risk * nav, at most cap * nav in value."""
    stop = F.abs(F.col("mae") / 100 * F.col("entry_price"))
    return trades.withColumn("units", F.when(stop > 0, F.least(nav * risk / stop, nav * cap / F.col("entry_price"))).otherwise(0.0))


def significance(trades: DataFrame, *by: str) -> DataFrame:
    """T-1: Wilson interval, binomial and t tests, interval of mean R, Sharpe, profit factor, drawdown, expectancy, smallest sample,
 and lag-1 correlation of gains (from 11 trades on); from 5 trades on."""
    ties = [F.length("trade_id"), "trade_id"] if "trade_id" in trades.columns else ["r_multiple"]
    w = Window.partitionBy(*by).orderBy("entry_time", *ties)  # the lag needs an order of trades of one time, for the equity they are peers
    r, up = F.col("r_multiple"), Window.partitionBy(*by).orderBy("entry_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = trades.withColumn("_w", won().cast("double")).withColumn("_g", (r > 0).cast("double")).withColumn("_lag", F.lag("_g").over(w)).withColumn("_e", F.sum(r).over(up))
    df = df.withColumn("_dd", F.max("_e").over(up) - F.col("_e"))
    gain, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_w").alias("wr"), F.sum("_w").alias("wins"), F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("sd"), correlation(F.col("_g"), F.col("_lag")).alias("autocorr"),
        profit_factor(r).alias("pf"), F.max("_dd").alias("max_dd"), gain.alias("gain"), loss.alias("loss"),
    ).where("n >= 5")
    low, high = wilson(F.col("wr"), F.col("n").cast("double"))
    sr = F.try_divide(F.col("mean_r"), F.col("sd"))
    out = out.withColumns({"_t": sr * F.sqrt("n"), "_v": F.col("n") - 1})
    t, df_ = F.col("_t"), F.col("_v")
    p = t_two_sided(t, df_) / 2
    margin = t_quantile(F.lit(0.975), df_) * F.col("sd") / F.sqrt("n")
    need = F.when((F.col("sd") > 0) & (F.col("mean_r") != 0), F.ceil(F.pow(F.try_divide(F.lit(2.8), F.abs(sr)), 2))).otherwise(999).cast("long")
    binomial = binomial_at_least(F.col("wins"), F.col("n"))
    return out.select(
        *by, "n", rounded(F.col("wr")).alias("win_rate"), rounded(low).alias("wilson_low"), rounded(high).alias("wilson_high"), rounded(binomial,
            6).alias("binomial_p"), (binomial < 0.05).alias("win_rate_significant"),
        rounded(F.col("mean_r")).alias("mean_r"), rounded(F.col("mean_r") - margin).alias("mean_r_low"), rounded(F.col("mean_r") + margin).alias("mean_r_high"), rounded(sr).alias("sharpe"), rounded(t).alias("t_stat"), rounded(p, 6).alias("t_p"),
        ((p < 0.05) & (F.col("mean_r") > 0)).alias("mean_r_significant"), rounded(F.coalesce("pf",
            F.lit(float("inf")))).alias("profit_factor"), rounded(F.col("max_dd")).alias("max_drawdown"),
        rounded(F.col("wr") * F.col("gain") + (1 - F.col("wr")) * F.col("loss")).alias("expectancy"), need.alias("min_n"), rounded(F.when(F.col("n") > 10,
            F.col("autocorr"))).alias("gain_autocorr"), F.when(F.col("n") > 10, F.abs("autocorr") < 0.2).alias("independent"),
    )


def streaks(trades: DataFrame, *by: str) -> DataFrame:
    """Runs of losses (r <= 0) with their length and R, the open one included."""
    df = trades.withColumn("_loss", F.col("r_multiple") <= 0)
    df = running(df, list(by), ["entry_time"], F.when(F.col("_loss"), 0).otherwise(1), "run")
    return df.where("_loss").groupBy(*by, "run").agg(F.min("entry_time").alias("begins"), F.count("*").alias("length"), rounded(F.sum("r_multiple")).alias("lost_r")).drop("run")


def episodes(trades: DataFrame, *by: str, depth: float = 0.5) -> DataFrame:
    """Drawdown episodes from a peak to its recovery, at least `depth` deep; an open one has no end."""
    df = running(drawdown(trades, *by), list(by), ["entry_time"], (F.col("drawdown") <= 1e-9).cast("long"), "_at")
    df = df.withColumn("_under", F.col("drawdown") > 1e-9)
    ends = Window.partitionBy(*by).orderBy("_at")
    out = df.groupBy(*by, "_at").agg(F.max("drawdown").alias("depth"), F.min(F.when(F.col("_under"), F.col("entry_time"))).alias("begins"), F.max_by("entry_time",
        "drawdown").alias("trough"), F.sum(F.col("_under").cast("long")).alias("trades"), F.min("entry_time").alias("_t"))
    out = out.withColumn("recovers", F.lead("_t").over(ends))
    return out.where((F.col("depth") >= depth) & (F.col("trades") > 0)).select(*by, rounded(F.col("depth")).alias("depth"), "begins", "trough", "recovers", "trades")


def rolling_drawdown(trades: DataFrame, *by: str, time: str = "entry_time", sizes: tuple[int, ...] = (10, 20, 50), digits: int = 4) -> DataFrame:
    """Quantiles of the largest drop of the equity within each full window of the last `size` trades; its peak begins at the first of them."""
    w = Window.partitionBy(*by).orderBy(time)
    df = trades
    for n in sizes:
        frame = w.rowsBetween(-(n - 1), 0)
        fold = F.aggregate(F.collect_list("r_multiple").over(frame), F.struct(F.lit(0.0).alias("e"), F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("d")),
            lambda a, x: F.struct((a.e + x).alias("e"), F.greatest(a.p, a.e + x).alias("p"), F.greatest(a.d, F.greatest(a.p, a.e + x) - a.e - x).alias("d")), lambda a: a.d)
        df = df.withColumn(f"_d{n}", F.when(F.count("*").over(frame) >= n, fold))
    out = None
    for n in sizes:
        one = df.groupBy(*by).agg(F.percentile(f"_d{n}", F.array(F.lit(0.75), F.lit(0.9), F.lit(0.95))).alias("q"), F.max(f"_d{n}").alias("m")).select(*by,
            F.lit(n).alias("window"), *[rounded(F.col("q")[i], digits).alias(f"p{p}") for i, p in enumerate((75, 90, 95))], rounded(F.col("m"), digits).alias("max_dd"))
        out = one if out is None else out.unionByName(one)
    return out


def plain_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, without blanks at the ends."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def without_bogus(trades: DataFrame, prefix: str = "FIXED") -> DataFrame:
    """Trades whose id begins with the prefix of hand-made ones go; those without an id stay."""
    return trades.where(~F.coalesce(F.col("trade_id").startswith(prefix), F.lit(False)))


def open_fields_cleared(trades: DataFrame, columns: tuple[str, ...] = ("exit_price", "exit_time", "pnl_usd", "pnl_pct", "r_multiple")) -> DataFrame:
    """What only a closed trade can have is null where is_open."""
    return trades.withColumns({c: F.when(~F.col("is_open"), F.col(c)) for c in columns if c in trades.columns})


def lot_rounded(orders: DataFrame, *, step: str = "step", tick: str = "tick") -> DataFrame:
    """Quantity down to a whole number of steps, price to the nearest tick; a step or tick of 0 changes nothing."""
    down = F.when(F.col(step) > 0, F.floor(F.col("quantity") / F.col(step) + 1e-9) * F.col(step)).otherwise(F.col("quantity"))
    near = F.when(F.col(tick) > 0, F.round(F.col("price") / F.col(tick)) * F.col(tick)).otherwise(F.col("price"))
    return orders.withColumn("quantity", down).withColumn("price", near)


def value_histogram(trades: DataFrame, column: str, bins: int, *by: str) -> DataFrame:
    """V4: counts in `bins` equal bins from the smallest to the largest value of each key, with the bin's ends."""
    x = F.col(column)
    span = trades.groupBy(*by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    df = trades.join(span, list(by)) if by else trades.join(F.broadcast(span))
    at = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((x - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    width = (F.col("_b") - F.col("_a")) / bins
    out = df.where(x.isNotNull()).groupBy(*by, at.alias("bin"), "_a", width.alias("_w")).agg(F.count("*").alias("n"))
    return out.select(*by, "bin", rounded(F.col("_a") + F.col("bin") * F.col("_w")).alias("low"), rounded(F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")
