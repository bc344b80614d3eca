"""Window operators over bars, one series per symbol and timeframe.

All but the exponential means are plain window functions.  Those are recurrences, so each series is cut into blocks of rows: a block's effect on
what comes in is affine, blocks are composed by their few summaries, and a second pass finishes each block; no series has to
fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions

KEYS = ("symbol", "timeframe")


def ordered() -> Window:
    return Window.partitionBy(*KEYS).orderBy("bar_ts")


def guarded(agg, column: Column, n: int, least: int | None = None) -> Column:
    """An aggregate of the last n rows, null until there are `least` (n) values."""
    w = ordered().rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) >= (least or n), agg(column).over(w))


def true_range() -> Column:
    """W1; the first bar has high - low only."""
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _fold(column: str, a: float, first: int) -> Column:
    """All partial sums of a block that starts from 0; the value of bar `first` counts whole, those before it not."""

    def after(y: Column, x: Column) -> Column:
        return F.when(x["bar_no"] > first, y * (1 - a) + a * x[column]).when(x["bar_no"] == first, x[column]).otherwise(0.0)

    start = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("ys"))
    return F.aggregate("_rows", start, lambda s, x: F.struct(after(s["y"], x).alias("y"), F.array_append(s["ys"], after(s["y"], x)).alias("ys")), lambda s: s["ys"])


def numbered(df: DataFrame) -> DataFrame:
    """df with `bar_no`, from 1 in each series."""
    return df if "bar_no" in df.columns else positions(df, list(KEYS), "bar_ts", name="bar_no")


def ewm(df: DataFrame, columns: dict[str, tuple], *, block: int = 512) -> DataFrame:
    """y0 = x0, y = (1 - a) y + a x for each new column: (input, a[, the bar number of x0]); before that bar y is 0. Adds `bar_no` (from 1).

    The bars of a series are numbered by one window; the recurrences themselves run in blocks of `block` rows that carry all their columns, so nothing
    is joined back. Columns must be of types that sort."""
    spec = {name: (c[0], c[1], c[2] if len(c) > 2 else 1) for name, c in columns.items()}
    df = numbered(df).withColumn("_b", F.floor((F.col("bar_no") - 1) / block))
    rest = [c for c in df.columns if c not in (*KEYS, "_b", "bar_no")]
    # within a block y = (1-a)^k * carry + own part: the own parts by a fold over the block's rows
    parts = df.groupBy(*KEYS, "_b").agg(F.sort_array(F.collect_list(F.struct("bar_no", *rest))).alias("_rows"), F.count("*").alias("_n"))
    for name, (c, a, first) in spec.items():
        parts = parts.withColumn(f"_own_{name}", _fold(c, a, first))
    # compose the blocks: few rows per series
    blocks = Window.partitionBy(*KEYS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for name, (_, a, _) in spec.items():
        step = F.struct(F.pow(F.lit(1 - a), F.col("_n")).alias("m"), F.element_at(f"_own_{name}", -1).alias("v"))
        parts = parts.withColumn(f"_in_{name}", F.aggregate(F.collect_list(step).over(blocks), F.lit(0.0), lambda s, x: s * x["m"] + x["v"]))
    rows = parts.select(*KEYS, F.posexplode("_rows").alias("_i", "_r"), *[F.col(f"{p}_{n}") for n in spec for p in ("_own", "_in")])
    made = [(F.col(f"_own_{n}")[F.col("_i")] + F.pow(F.lit(1 - a), F.col("_i") + 1) * F.col(f"_in_{n}")).alias(n) for n, (_, a, _) in spec.items()]
    return rows.select(*KEYS, *[F.col("_r").getField(c).alias(c) for c in ("bar_no", *rest)], *made)


def ewm_adjusted(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Means whose weights (1 - a) ** age add up to their own sum from the first bar on: (input, a) for each new column."""
    out = ewm(df, {name: (c, a, 0) for name, (c, a) in columns.items()})
    return out.withColumns({name: F.col(name) / (1 - F.pow(F.lit(1 - a), F.col("bar_no"))) for name, (_, a) in columns.items()})


def indicators(bars: DataFrame) -> DataFrame:
    """True range, ATR, EMAs, RSI and ADX (Wilder smoothing with 1/14, null before 14 bars)."""
    w, wilder = ordered(), 1 / 14
    diff = F.col("close") - F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = bars.withColumn("tr", true_range()).withColumn("_gain", F.when(diff > 0, diff).otherwise(0.0)).withColumn("_loss", F.when(diff < 0, -diff).otherwise(0.0))
    df = df.withColumn("_pdm", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_up", up).withColumn("_down", down)
    df = df.withColumn("_mdm", F.when((F.col("_down") > F.col("_pdm")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0))
    spans = {f"ema_{n}": ("close", 2 / (n + 1)) for n in (20, 50, 100, 200)}
    df = ewm(df, {**spans, "atr": ("tr", wilder), "_g": ("_gain", wilder), "_l": ("_loss", wilder), "_p": ("_pdm", wilder), "_m": ("_mdm", wilder)})
    plus, minus = 100 * F.col("_p") / (F.col("atr") + 1e-10), 100 * F.col("_m") / (F.col("atr") + 1e-10)
    df = df.withColumn("_dx", 100 * F.abs(plus - minus) / (plus + minus + 1e-10)).withColumn("rsi", 100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-10)))
    dx = ewm(df, {"adx": ("_dx", wilder)})
    ready = F.col("bar_no") >= 14
    return dx.select(*bars.columns, "bar_no", "tr", *spans, *[F.when(ready, F.col(c)).alias(c) for c in ("atr", "rsi", "adx")])


def average_rank(column: str, n: int, least: int = 50) -> Column:
    """Place of a value among the last n, ties at their average, as a share of those there are; null before `least`."""
    w = ordered().rowsBetween(-(n - 1), 0)
    held = F.collect_list(column).over(w)
    below, equal = F.size(F.filter(held, lambda v: v < F.col(column))), F.size(F.filter(held, lambda v: v == F.col(column)))
    return F.when(F.col(column).isNotNull() & (F.size(held) >= least), (below + (equal + 1) / 2) / F.size(held))


def resample(bars: DataFrame, unit: str, hours: int = 1) -> DataFrame:
    """Bars of `hours` hours (or a day), left labelled; empty ones are not made."""
    start = F.date_trunc("day", "bar_ts") if unit == "day" else F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("bar_ts").cast("timestamp")) / (3600 * hours)) * 3600 * hours).cast("timestamp_ntz")
    return bars.groupBy("symbol", start.alias("bar_ts")).agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"))


def candle_streaks(bars: DataFrame) -> DataFrame:
    """Signed length of the run of rising or falling closes; an equal close sets it to 0."""
    w = ordered()
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).cast("int")
    df = bars.withColumn("_s", sign)
    new = (F.col("_s") != F.lag("_s").over(w)) | F.lag("_s").over(w).isNull()
    df = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.row_number().over(Window.partitionBy(*KEYS, "_run").orderBy("bar_ts"))
    return df.withColumn("streak", F.col("_s") * n).drop("_s", "_run")


def islands(df: DataFrame, state: Column) -> DataFrame:
    """Contiguous runs of a state in each series: first and last bar and length."""
    w = ordered()
    df = df.withColumn("state", state)
    df = df.withColumn("_run", F.sum((~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.groupBy(*KEYS, "_run", "state").agg(F.min("bar_ts").alias("begins"), F.max("bar_ts").alias("ends"), F.count("*").alias("bars")).drop("_run")


def regime(df: DataFrame) -> Column:
    """W31 over bars with indicators: unknown for the first 50 bars, then volatile, trending_up, trending_down (also at the average itself) or ranging."""
    pct = F.when(F.col("close") != 0, F.col("atr") / F.col("close")).otherwise(F.col("atr") * float("inf"))
    own = F.when(F.col("close") > 0, F.col("atr") / F.col("close")).otherwise(0.0)
    mean = F.avg(pct).over(ordered().rowsBetween(-50, 0))
    return F.when(F.col("bar_no") <= 50, "unknown").when(own > 1.8 * mean, "volatile").when(F.col("adx") > 30, F.when(F.col("close") > F.col("ema_50"),
        "trending_up").otherwise("trending_down")).otherwise("ranging")


def simple_regime(df: DataFrame) -> Column:
    """The three-way regime of the bars with indicators."""
    return F.when(F.col("adx").isNull() | (F.col("adx") < 20), "Ranging").when(F.col("ema_50") > F.col("ema_200"), "Trending Up").otherwise("Trending Down")


def swings(bars: DataFrame, side: int = 3, *, causal: bool = True) -> DataFrame:
    """Swing highs and lows of a centred window. Causal: stamped when known, `side` bars later; else at the swing bar."""
    w = ordered()
    frame = w.rowsBetween(-side, side)
    full = F.count("*").over(frame) == 2 * side + 1
    df = bars.withColumn("_h", full & (F.col("high") == F.max("high").over(frame))).withColumn("_l", full & (F.col("low") == F.min("low").over(frame)))
    if causal:
        return df.withColumn("swing_high", F.when(F.lag("_h", side).over(w), F.lag("high", side).over(w))).withColumn("swing_low", F.when(F.lag("_l", side).over(w),
            F.lag("low", side).over(w))).drop("_h", "_l")
    return df.withColumn("swing_high", F.when(F.col("_h"), F.col("high"))).withColumn("swing_low", F.when(F.col("_l"), F.col("low"))).drop("_h", "_l")


def gaps(bars: DataFrame, least: float = 0.001) -> DataFrame:
    """P5: three-bar imbalances; a bullish one comes first."""
    w = ordered()
    high2, low2, mid = F.lag("high", 2).over(w), F.lag("low", 2).over(w), F.lag("close", 1).over(w)
    bull, bear = (F.col("low") - high2) / mid, (low2 - F.col("high")) / mid
    kind = F.when((F.col("low") > high2) & (bull >= least), "bullish").when((F.col("high") < low2) & (bear >= least), "bearish")
    df = bars.withColumn("kind", kind).withColumn("bottom", F.when(kind == "bullish", high2).when(kind == "bearish", F.col("high"))).withColumn("top",
        F.when(kind == "bullish", F.col("low")).when(kind == "bearish", low2))
    return df.where("kind IS NOT NULL")


def _later(shift: int) -> Window:
    """The rows at least `shift` bars later, as a growing frame of the series read backwards: linear in its length, where a frame from a row to the end of
    the series would be added up anew for every row."""
    return Window.partitionBy(*KEYS).orderBy(F.desc("bar_ts")).rowsBetween(Window.unboundedPreceding, -shift)


def open_gaps(bars: DataFrame) -> DataFrame:
    """Imbalances that no later bar has touched by the end of the series."""
    df = bars.withColumn("_low", F.min("low").over(_later(1))).withColumn("_high", F.max("high").over(_later(1)))
    df = gaps(df)
    bull = (F.col("kind") == "bullish") & (F.col("_low").isNull() | (F.col("_low") > F.col("bottom")))
    bear = (F.col("kind") == "bearish") & (F.col("_high").isNull() | (F.col("_high") < F.col("top")))
    return df.where(bull | bear).drop("_low", "_high")


def gap_fills(bars: DataFrame) -> DataFrame:
    """Each imbalance with the share of it that later bars have filled, whether that is all of it, and the zone from 0.3 to 0.7 of its height in which an entry may lie."""
    df = gaps(bars.withColumn("_low", F.min("low").over(_later(1))).withColumn("_high", F.max("high").over(_later(1))))
    height = F.col("top") - F.col("bottom")
    reached = F.when(F.col("kind") == "bullish", F.col("top") - F.col("_low")).otherwise(F.col("_high") - F.col("bottom"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(reached, height), F.lit(0.0))))
    return df.withColumn("fill_share", share).withColumn("filled", share >= 1.0).withColumn("zone_low", F.col("bottom") + 0.3 * height).withColumn("zone_high",
        F.col("bottom") + 0.7 * height).drop("_low", "_high")


def gaps_by_timeframe(bars: DataFrame, hours: tuple[int, ...] = (4, 24)) -> DataFrame:
    """The imbalances of the bars resampled to longer timeframes, tagged `htf`; is_open: no later bar of it has filled one."""
    out = None
    for n in hours:
        one = resample(bars, "day" if n == 24 else "hour", n).withColumn("timeframe", F.lit(f"{n}h"))
        one = gap_fills(one).select("symbol", F.col("timeframe").alias("htf"), F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "kind", "bottom", "top",
            (~F.col("filled")).alias("is_open"))
        out = one if out is None else out.unionByName(one)
    return out


def order_blocks(bars: DataFrame, back: int = 20) -> DataFrame:
    """A bar whose next one breaks the extreme of the `back` bars before it, not yet broken through afterwards."""
    w = ordered()
    prior = w.rowsBetween(-back, -1)
    full = F.count("*").over(prior) == back
    df = bars.withColumn("_top", F.max("high").over(prior)).withColumn("_bottom", F.min("low").over(prior)).withColumn("_full", full)
    df = df.withColumn("_nh", F.lead("high").over(w)).withColumn("_nl", F.lead("low").over(w)).withColumn("_ll", F.min("low").over(_later(2))).withColumn("_lh",
        F.max("high").over(_later(2)))
    bull = (F.col("close") < F.col("open")) & (F.col("_nh") > F.col("_top")) & (F.col("_ll").isNull() | (F.col("_ll") > F.col("low")))
    bear = (F.col("close") > F.col("open")) & (F.col("_nl") < F.col("_bottom")) & (F.col("_lh").isNull() | (F.col("_lh") < F.col("high")))
    return df.withColumn("kind", F.when(F.col("_full") & bull, "bullish").when(F.col("_full") & bear, "bearish")).where("kind IS NOT NULL").select(*bars.columns, "kind")


def smoothed_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with `bar_no`, `tr` and `smma_range`: the true ranges from the second bar on, smoothed by 1/n from the mean of the first n of them; null before it."""
    df = numbered(bars).withColumn("tr", true_range())
    mean = F.avg("tr").over(ordered().rowsBetween(-(n - 1), 0))
    df = df.withColumn("_x", F.when(F.col("bar_no") == n + 1, mean).otherwise(F.col("tr")))
    return ewm(df, {"_y": ("_x", 1 / n, n + 1)}).withColumn("smma_range", F.when(F.col("bar_no") > n, F.col("_y"))).drop("_x", "_y")


def sweeps(bars: DataFrame, back: int = 20, tolerance: float = 0.002, depth: float = 0.1) -> DataFrame:
    """P10: a bar that goes beyond the extreme of bars 2 to back + 1 before it by at least `depth` smoothed ranges and closes back inside,
 where the bar before it had not gone beyond."""
    prior = ordered().rowsBetween(-(back + 1), -2)
    full = F.count("*").over(prior) == back
    df = smoothed_range(bars)
    df = df.withColumn("_h", F.when(full, F.max("high").over(prior))).withColumn("_l", F.when(full, F.min("low").over(prior))).withColumn("_ph",
        F.lag("high").over(ordered())).withColumn("_pl", F.lag("low").over(ordered()))
    least = depth * F.when(F.col("smma_range") > 0, F.col("smma_range")).otherwise(1.0)
    low = (F.col("low") < F.col("_l") - F.col("_l") * tolerance) & (F.col("close") > F.col("_l")) & (F.col("_pl") >= F.col("_l") * (1 - tolerance)) & (F.col("_l") - F.col("low") >= least)
    high = (F.col("high") > F.col("_h") + F.col("_h") * tolerance) & (F.col("close") < F.col("_h")) & (F.col("_ph") <= F.col("_h") * (1 + tolerance)) & (F.col("high") - F.col("_h") >= least)
    df = df.withColumn("side", F.when(low, "low").when(high, "high")).where("side IS NOT NULL")
    is_low = F.col("side") == "low"
    return df.withColumn("level", F.when(is_low, F.col("_l")).otherwise(F.col("_h"))).withColumn("sweep_depth", F.when(is_low,
        F.col("_l") - F.col("low")).otherwise(F.col("high") - F.col("_h"))).select(*bars.columns, "side", "level", "sweep_depth")


PRICES = ("open", "high", "low", "close")


def _plain(c: str) -> Column:
    """The number, null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def _filled(bars: DataFrame, arrival: str | None) -> DataFrame:
    """Prices filled forward, then backward, over all rows of a series, those of one time in the order of `arrival`; _again: a later row of its time follows."""
    df = bars.withColumn("_a", F.col(arrival) if arrival else F.monotonically_increasing_id())
    up, down = Window.partitionBy(*KEYS).orderBy("bar_ts", "_a"), Window.partitionBy(*KEYS).orderBy(F.desc("bar_ts"), F.desc("_a"))
    for c in PRICES:
        before, after = F.last(_plain(c), True).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.last(_plain(c), True).over(down.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn(f"_{c}", F.coalesce(_plain(c), before, after))
    return df.withColumn("_again", F.coalesce(F.lead("bar_ts").over(up) == F.col("bar_ts"), F.lit(False)))


def validated(bars: DataFrame, *, arrival: str | None = None, strict: bool = False) -> DataFrame:
    """Prices filled forward then backward, volume 0 for null and never negative, high and low widened, of the rows of one time the last kept,
 gaps flagged at over 3 median steps.

    arrival: a column by which rows of one time came in (without it, the order in which Spark reads them). strict: raises where `bar_issues` counts any."""
    if strict and (found := bar_issues(bars, arrival=arrival).where("issues > 0").limit(5).collect()):  # five series to name
        raise ValueError(f"bars are not clean: {[r.asDict() for r in found]}")
    df = _filled(bars, arrival).where("NOT _again")
    df = df.withColumns({c: F.col(f"_{c}") for c in PRICES})
    df = df.withColumn("volume", F.abs(F.coalesce(F.nanvl("volume", F.lit(0.0)), F.lit(0.0)))).withColumn("high", F.greatest("high", "open",
        "close")).withColumn("low", F.least("low", "open", "close"))
    df = _with_gaps(df.select(*bars.columns))
    return df.drop("_step", "_median")


def _with_gaps(df: DataFrame) -> DataFrame:
    df = df.withColumn("_step", F.unix_timestamp(F.col("bar_ts").cast("timestamp")) - F.unix_timestamp(F.lag("bar_ts").over(ordered()).cast("timestamp")))
    median = df.groupBy(*KEYS).agg(F.percentile("_step", F.lit(0.5)).alias("_median"))
    return df.join(median, list(KEYS)).withColumn("gap", F.coalesce((F.col("_step") > 3 * F.col("_median")) & (F.col("_median") > 0), F.lit(False)))


def bar_issues(bars: DataFrame, *, arrival: str | None = None) -> DataFrame:
    """A row per series with what `validated` mends, and `issues`, their sum: missing and infinite prices, missing and negative volumes,
 highs and lows inside the body, repeated times, gaps."""
    df = _filled(bars, arrival)
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    missing = sum((F.coalesce(F.isnan(c) | F.isnull(c), F.lit(True)).cast("int") for c in PRICES), F.lit(0))
    infinite = sum((F.coalesce(F.abs(c) == float("inf"), F.lit(False)).cast("int") for c in PRICES), F.lit(0))
    counts = df.groupBy(*KEYS).agg(
        F.sum(missing).alias("missing"), F.sum(infinite).alias("infinite"), n(F.isnan("volume") | F.isnull("volume")).alias("missing_volume"), n(~F.isnan("volume") & (F.col("volume") < 0)).alias("negative_volume"),
        n(F.col("_high") < F.greatest("_open", "_close")).alias("low_highs"), n(F.col("_low") > F.least("_open",
            "_close")).alias("high_lows"), n(F.col("_again")).alias("repeated"),
    )
    gaps_ = _with_gaps(df.where("NOT _again").select(*KEYS, "bar_ts")).groupBy(*KEYS).agg(n(F.col("gap")).alias("gaps"))
    out = counts.join(gaps_, list(KEYS))
    return out.withColumn("issues", sum((F.col(c) for c in ("missing", "infinite", "missing_volume", "negative_volume", "low_highs", "high_lows", "repeated",
        "gaps")), F.lit(0).cast("long")))


def structure_bias(bars: DataFrame, side: int = 3) -> DataFrame:
    """Per bar the bias (1, -1, 0) and confidence from the last three swing highs and lows (counts of higher highs and lows against lower ones).

    As in the reference a swing stands at its own bar, and values start with the fourth swing of a kind; a series with fewer than three of one kind has zeros."""
    w = ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = swings(bars, side, causal=False)
    whole = Window.partitionBy(*KEYS)
    for c in ("swing_high", "swing_low"):
        nth = F.count(c).over(w)
        mark = Window.partitionBy(*KEYS).orderBy(F.col(c).isNull(), "bar_ts")
        three = F.struct(F.col(c).alias("v0"), F.lag(c, 1).over(mark).alias("v1"), F.lag(c, 2).over(mark).alias("v2"))
        df = df.withColumn(f"_3{c}", F.when(F.col(c).isNotNull() & (nth >= 4), three)).withColumn(f"_n{c}", F.count(c).over(whole))
    df = df.withColumns({f"_l{c}": F.last(f"_3{c}", True).over(w) for c in ("swing_high", "swing_low")})
    h, low = F.col("_lswing_high"), F.col("_lswing_low")
    up = sum((F.coalesce(x[a] > x[b], F.lit(False)).cast("int") for x in (h, low) for a, b in (("v0", "v1"), ("v1", "v2"))), F.lit(0))
    down = sum((F.coalesce(x[a] < x[b], F.lit(False)).cast("int") for x in (h, low) for a, b in (("v0", "v1"), ("v1", "v2"))), F.lit(0))
    valid = h.isNotNull() & low.isNotNull() & (F.col("_nswing_high") >= 3) & (F.col("_nswing_low") >= 3)
    bias = F.when(~valid, 0.0).when(up > down, 1.0).when(down > up, -1.0).otherwise(0.0)
    strong = F.when((up >= 3) & (down <= 1), up).when((down >= 3) & (up <= 1), down).otherwise(F.abs(up - down))
    return df.select(*bars.columns, bias.alias("structure_bias"), F.when(~valid, 0.0).otherwise(strong / 4).alias("structure_conf"))
