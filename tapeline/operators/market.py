"""Features of the market at a bar (W28-W30), all windows over the bars with indicators; null before a feature has its bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import correlation
from . import series

FEATURES = (
    "atr_percentile_20", "atr_percentile_100", "realized_vol_20", "vol_of_vol", "atr_ratio", "adx_slope_5", "rsi_divergence", "candle_streak", "close_vs_range",
    "momentum_5", "relative_volume", "volume_trend_5", "volume_price_confirm", "dist_from_high_20", "dist_from_low_20", "ema_alignment", "price_vs_ema200", "range_position",
)


def _share_below(column: str, n: int):
    """Share of the last n values that are at most the present one; missing ones are not."""
    window = F.collect_list(column).over(series.ordered().rowsBetween(-(n - 1), 0))
    return F.coalesce(F.size(F.filter(window, lambda v: v <= F.col(column))), F.lit(0)) / n


def market_features(indicators: DataFrame) -> DataFrame:
    """symbol, timeframe, bar_ts and FEATURES, from `series.indicators`."""
    w = series.ordered()
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    c, atr, bar = F.col("close"), F.col("atr"), F.col("bar_no") - 1
    df = series.candle_streaks(indicators)
    df = df.withColumn("_r", F.when((c > 0) & (F.lag("close").over(w) > 0), F.ln(c / F.lag("close").over(w))))
    df = df.withColumn("_v5", F.when(F.count("_r").over(last(5)) == 5, F.stddev_samp("_r").over(last(5))))
    prior = w.rowsBetween(-19, -1)
    sma = F.when(F.col("bar_no") >= 20, F.avg("volume").over(last(20)))
    mean5 = F.avg("volume").over(last(5))
    slope = sum(((2 - k) * F.lag("volume", k).over(w) for k in range(5)), F.lit(0.0)) / 10
    at_high, at_low = c >= F.max("close").over(prior), c <= F.min("close").over(prior)
    known = F.count("rsi").over(prior) == 19
    rsi_high = F.coalesce(known & (F.col("rsi") >= F.max("rsi").over(prior)), F.lit(False))
    rsi_low = F.coalesce(known & (F.col("rsi") <= F.min("rsi").over(prior)), F.lit(False))
    bull = F.col("ema_50") > F.col("ema_200")
    up = c > F.lag("close").over(w)
    old = F.lag("close", 5).over(w)
    sign = lambda x: F.when(x, 1).otherwise(-1)
    span50 = F.max("high").over(last(50)) - F.min("low").over(last(50))
    mean_atr = F.when(F.count("atr").over(last(20)) == 20, F.avg("atr").over(last(20)))
    out = {
        "atr_percentile_20": F.when(bar >= 20, _share_below("atr", 20)),
        "atr_percentile_100": F.when(bar >= 100, _share_below("atr", 100)),
        "realized_vol_20": F.when((bar >= 21) & (F.count("_r").over(last(20)) == 20), F.stddev_samp("_r").over(last(20))),
        "vol_of_vol": F.when((bar >= 30) & (F.count("_v5").over(last(20)) == 20), F.stddev_samp("_v5").over(last(20))),
        "atr_ratio": F.when(bar >= 20, F.when(mean_atr > 0, atr / mean_atr).otherwise(1.0)),
        "adx_slope_5": F.col("adx") - F.lag("adx", 5).over(w),
        "rsi_divergence": F.when(bar >= 20, F.when(at_high & ~rsi_high, -1.0).when(at_low & ~rsi_low, 1.0).otherwise(0.0)),
        "candle_streak": F.greatest(F.lit(-20), F.least(F.lit(20), F.col("streak"))).cast("double"),
        "close_vs_range": F.coalesce(F.try_divide(c - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)),
        "momentum_5": F.when(old > 0, c / old - 1),
        "relative_volume": F.when(sma > 0, F.col("volume") / sma).when(bar >= 20, 1.0),
        "volume_trend_5": F.when(bar >= 5, F.when(mean5 > 0, slope / mean5).otherwise(0.0)),
        "volume_price_confirm": F.when(bar >= 1, (F.coalesce(F.col("volume") > 1.2 * sma, F.lit(False)) & (up == bull)).cast("double")),
        "dist_from_high_20": F.when((bar >= 20) & (atr > 0), (F.max("high").over(last(20)) - c) / atr),
        "dist_from_low_20": F.when((bar >= 20) & (atr > 0), (c - F.min("low").over(last(20))) / atr),
        "ema_alignment": (sign(c > F.col("ema_20")) + sign(F.col("ema_20") > F.col("ema_50")) + sign(bull)).cast("double"),
        "price_vs_ema200": F.when(atr > 0, (c - F.col("ema_200")) / atr),
        "range_position": F.when(bar >= 50, F.coalesce(F.try_divide(c - F.min("low").over(last(50)), span50), F.lit(0.5))),
    }
    return df.select(*series.KEYS, "bar_ts", *[v.alias(k) for k, v in out.items()])


def cross_asset(bars: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    """Rolling correlation of the log returns of two symbols over the last n common bars, and the difference of their 5-bar changes."""
    w = Window.partitionBy("timeframe").orderBy("bar_ts")
    one, two = (bars.where(F.col("symbol") == x).select("timeframe", "bar_ts", F.col("close").alias(n_)) for x, n_ in ((a, "_a"), (b, "_b")))
    df = one.join(two, ["timeframe", "bar_ts"])
    for c in ("_a", "_b"):
        before, old = F.lag(c).over(w), F.lag(c, 5).over(w)
        df = df.withColumn(f"{c}r", F.when((F.col(c) > 0) & (before > 0), F.ln(F.col(c) / before))).withColumn(f"{c}m", F.when(old > 0, F.col(c) / old - 1))
    frame = w.rowsBetween(-(n - 1), 0)
    both = F.count(F.when(F.col("_ar").isNotNull() & F.col("_br").isNotNull(), 1)).over(frame)
    return df.select("timeframe", "bar_ts", F.when(both == n, correlation(F.col("_ar"), F.col("_br"), frame)).alias("rolling_corr"), (F.col("_am") - F.col("_bm")).alias("divergence"))
