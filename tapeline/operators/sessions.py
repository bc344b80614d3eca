"""Highs and lows of trading sessions and bars that sweep them (W17, W18, P11, P12). Sessions are hours of New York time; a series is one symbol and timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series
from .trades import session_of

UP = Window.unboundedPreceding
#: Session, first hour and hour after the last, of the levels that sweeps are tried against, in their order.
LEVELS = (("asia", 19, 24), ("london", 2, 8), ("new_york", 8, 16))


def _hour(zone: str = "America/New_York") -> Column:
    return F.hour(F.from_utc_timestamp("bar_ts", zone))


def session_blocks(bars: DataFrame) -> DataFrame:
    """High and low of each unbroken run of bars in one session, without the off-hours."""
    w = series.ordered()
    df = bars.withColumn("session", session_of(F.col("bar_ts")))
    df = df.withColumn("_run", F.sum((~F.col("session").eqNullSafe(F.lag("session").over(w))).cast("int")).over(w.rowsBetween(UP, 0)))
    out = df.groupBy(*series.KEYS, "_run", "session").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min("bar_ts").alias("begins"), F.max("bar_ts").alias("ends"))
    return out.where("session <> 'Off-Hours'").drop("_run")


def session_levels(bars: DataFrame, first: int, last: int, *, sessions: int = 1, name: str = "session") -> DataFrame:
    """Bars with the high and low of the last `sessions` whole sessions of the hours [first, last),
 from a session's end until the next begins; null inside one and before the first."""
    w, high, low = series.ordered(), f"{name}_high", f"{name}_low"
    inside = (_hour() >= first) & (_hour() < last)
    df = bars.withColumn("_in", inside)
    df = df.withColumn("_s", F.sum((F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(UP, 0)))
    per = df.where("_in").groupBy(*series.KEYS, "_s").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    recent = Window.partitionBy(*series.KEYS).orderBy("_s").rowsBetween(-(sessions - 1), 0)
    per = per.select(*series.KEYS, "_s", F.max("_h").over(recent).alias("_h"), F.min("_l").over(recent).alias("_l"))
    out = df.join(per, [*series.KEYS, "_s"], "left")
    return out.select(*bars.columns, F.when(~F.col("_in"), F.col("_h")).alias(high), F.when(~F.col("_in"), F.col("_l")).alias(low))


def session_sweeps(bars: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """Bars that go beyond a session's low or high and close back inside, where the bar before had not; of several levels the first in the order of LEVELS, lows first."""
    df = bars
    for name, first, last in LEVELS:
        df = session_levels(df, first, last, name=name)
    w = series.ordered()
    df = df.withColumn("_pl", F.coalesce(F.lag("low").over(w), F.col("low"))).withColumn("_ph", F.coalesce(F.lag("high").over(w), F.col("high")))
    kind = price = None
    for name, _, _ in LEVELS:
        for side in ("low", "high"):
            x = F.col(f"{name}_{side}")
            hit = (F.col("low") < x - x * tolerance) & (F.col("close") > x) & (F.col("_pl") >= x * (1 - tolerance)) if side == "low" else (F.col("high") > x + x * tolerance) & (F.col("close") < x) & (F.col("_ph") <= x * (1 + tolerance))
            hit = hit & (x > 0)
            label = F.lit(f"{name}_{side}")
            kind, price = (F.when(hit, label), F.when(hit, x)) if kind is None else (kind.when(hit, label), price.when(hit, x))
    return df.withColumn("level", kind).withColumn("swept_price", price).where("level IS NOT NULL").select(*bars.columns, "level", "swept_price")


def first_sweeps(bars: DataFrame, days: int = 5) -> DataFrame:
    """The first bar in the `days` after each session block that trades beyond its high, and the first beyond its low; null where none does. A level is taken once.

    Blocks and bars meet by day, so a block's join is with the bars of `days` + 1 days, not with the whole series."""
    blocks = session_blocks(bars).withColumnsRenamed({"high": "level_high", "low": "level_low"})
    blocks = blocks.withColumn("_d", F.explode(F.sequence(F.to_date("ends"), F.date_add(F.to_date("ends"), days))))
    later = bars.select(*series.KEYS, F.to_date("bar_ts").alias("_d"), F.col("bar_ts").alias("_t"), "high", "low")
    both = blocks.join(later, [*series.KEYS, "_d"], "left").where(F.col("_t").isNull() | (F.col("_t") > F.col("ends")) | (F.col("_d") == F.to_date("ends")))
    after = F.col("_t") > F.col("ends")
    return both.groupBy(*series.KEYS, "session", "begins", "ends", "level_high", "level_low").agg(F.min(F.when(after & (F.col("high") > F.col("level_high")),
        F.col("_t"))).alias("high_swept"), F.min(F.when(after & (F.col("low") < F.col("level_low")), F.col("_t"))).alias("low_swept"))
