"""Sweeps of the 0.618 retracement between the last swing extremes, rejected within their bar.

All conditions are windows over numbered bars, in blocks with the bars that they look back to; signals that come too soon after the one before are left out by a scan over blocks.

Defined results: bars whose range (atr) is null, NaN or 0 give no signal; ties of a window's extreme count at its first bar; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cooled, in_blocks

#: Retracement levels, weights of the score and bars between two signals. Fixed values of the strategy.
DEEP, SHALLOW = 0.618, 0.236
DEPTH, TREND, MOMENTUM, VOLUME, STRUCTURE = 0.30, 0.20, 0.15, 0.15, 0.20
COOLDOWN = 4


def retracement_signals(bars: DataFrame, *, by: list[str], back: int = 20, tolerance: float = 0.002, least: float = 0.02, confidence: float = 0.48, buffer: float = 0.3) -> DataFrame:
    """bars: by, no, bar_ts, OHLCV, atr, and where there are such columns rsi, ema_50 with ema_200, structure. A signal a row with stop, targets, score and bias."""
    have = set(bars.columns)
    df = in_blocks(bars, by, max(back, 20))
    w = Window.partitionBy(*by, "_block").orderBy("no")
    past, now = w.rowsBetween(-back, -1), w.rowsBetween(-19, 0)
    top, low = F.max(F.struct("high", (-F.col("no")).alias("n"))).over(past), F.min(F.struct("low", F.col("no").alias("n"))).over(past)
    mean = F.when(F.count("volume").over(now) >= 10, F.avg("volume").over(now))
    df = df.withColumns({"_top": top, "_low": low, "_mean": mean}).where(~F.col("_halo") & (F.col("no") > back + 5) & (F.col("atr") > 0) & ~F.isnan("atr"))
    high, bottom = F.col("_top.high"), F.col("_low.low")
    df = df.withColumns({"_range": high - bottom, "long": F.when(F.col("_low.n") > -F.col("_top.n"), True).when(F.col("_low.n") < -F.col("_top.n"), False)})
    df = df.where(F.col("long").isNotNull() & (high + bottom > 0) & (F.col("_range") / ((high + bottom) / 2) >= least))
    long = F.col("long")
    either = lambda a, b: F.when(long, a).otherwise(b)
    level = lambda share: either(high - share * F.col("_range"), bottom + share * F.col("_range"))
    df = df.withColumn("_deep", level(DEEP))
    deep, body = F.col("_deep"), F.abs(F.col("close") - F.col("open"))
    swept = either(F.col("low") < deep * (1 - tolerance), F.col("high") > deep * (1 + tolerance)) & either(F.col("close") > deep, F.col("close") < deep)
    wick = either(F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close"))
    df = df.where(swept & (either(F.col("close") > F.col("open"), F.col("close") < F.col("open")) | (body > 0) & (wick > 0.5 * body)))
    sided = lambda up, down: F.coalesce(either(up, down), F.lit(False))
    add = lambda hit, value: F.when(hit, value).otherwise(0.0)
    trend: Column = sided(F.col("ema_50") > F.col("ema_200"), F.col("ema_50") < F.col("ema_200")) if {"ema_50", "ema_200"} <= have else F.lit(False)
    shape: Column = sided(F.col("structure") > 0, F.col("structure") < 0) if "structure" in have else F.lit(False)
    score = F.least(either(deep - F.col("low"), F.col("high") - deep) / F.col("atr") / 0.5, F.lit(1.0)) * DEPTH + add(trend, TREND)
    if "rsi" in have:
        score = score + add(sided(F.col("rsi").between(30, 50), F.col("rsi").between(50, 70)), MOMENTUM)
    score = score + add(F.coalesce((F.col("_mean") > 0) & (F.col("volume") > 1.2 * F.col("_mean")), F.lit(False)), VOLUME) + add(shape, STRUCTURE)
    sl = either(bottom - buffer * F.col("atr"), high + buffer * F.col("atr"))
    df = df.withColumns({"confidence": score, "sl": sl, "risk": either(F.col("close") - sl, sl - F.col("close")), "bias": F.when(trend & shape, "ALIGNED").otherwise("PARTIAL")})
    df = df.where((F.col("confidence") >= confidence) & (F.col("risk") > 0))
    df = df.select(*by, "no", "bar_ts", either(F.lit("LONG"), F.lit("SHORT")).alias("direction"), F.col("close").alias("entry"), "sl", level(SHALLOW).alias("tp1"), either(high, bottom).alias("tp2"), "risk", "confidence", "bias")
    return cooled(df, by, COOLDOWN)
