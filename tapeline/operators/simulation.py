"""Signals, bar-by-bar trade simulation, walk-forward windows and scores, all as window folds in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series


@dataclass(frozen=True)
class Costs:
    spread: float = 0.0002
    commission: float = 0.0005
    slippage: float = 0.0001


def sweep_signals(bars: DataFrame, *, back: int = 20, tolerance: float = 0.002, reward: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """A sweep of the prior extreme is faded at its close: stop beyond the bar, targets at multiples of the risk."""
    s = series.sweeps(bars, back, tolerance)
    long = F.col("side") == "low"
    s = s.withColumn("direction", F.when(long, "LONG").otherwise("SHORT")).withColumn("entry", F.col("close")).withColumn("sl", F.when(long, F.col("low")).otherwise(F.col("high")))
    risk, sign = F.abs(F.col("entry") - F.col("sl")), F.when(long, 1.0).otherwise(-1.0)
    return s.withColumn("risk", risk).where("risk > 0").withColumn("tp1", F.col("entry") + sign * reward[0] * risk).withColumn("tp2",
        F.col("entry") + sign * reward[1] * risk).select(*series.KEYS, "bar_ts", "direction", "entry", "sl", "tp1", "tp2", "risk")


#: The longest trade of the reference in 4h bars, its signal's bar counted, and the bars of other timeframes in one of 4h.
LONGEST, SCALE = 168, {"5m": 48, "15m": 16, "30m": 8, "1h": 4, "2h": 2, "4h": 1}


def longest(timeframe: str | None = None) -> Column | int:
    """Bars that a trade is followed after its signal's bar: of one timeframe, or a column by the rows' own."""
    if timeframe is not None:
        return LONGEST * SCALE.get(timeframe, 1) - 1
    scale = F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv])
    return LONGEST * F.coalesce(scale[F.col("timeframe")], F.lit(1)) - 1


def _numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("no", F.row_number().over(series.ordered()) - 1)


def _with_paths(numbered: DataFrame, signals: DataFrame, most: Column) -> DataFrame:
    """signals (with `no`) and their next `most` bars as `_path`: a series is cut into blocks of `most` bars, and a signal's path lies in its own block and the next."""
    block = F.floor(F.col("no") / most).alias("_block")
    blocks = numbered.groupBy(*series.KEYS, block).agg(F.sort_array(F.collect_list(F.struct("no", "bar_ts", "high", "low", "close"))).alias("_own"))
    blocks = blocks.withColumn("_next", F.lead("_own").over(Window.partitionBy(*series.KEYS).orderBy("_block")))
    df = signals.withColumn("_block", block).join(blocks, [*series.KEYS, "_block"])
    path = F.slice(F.when(F.col("_next").isNull(), F.col("_own")).otherwise(F.concat("_own", "_next")), (F.col("no") % most + 2).cast("int"), most.cast("int"))
    return df.withColumn("_path", path).drop("_block", "_own", "_next")


def walk(bars: DataFrame, signals: DataFrame, *, costs: Costs = Costs(), most: int | None = None, tie_rule: str = "sl_first") -> DataFrame:
    """M1: from the bar after the signal on, stop first (or the first target first), first target moves the stop to entry, second target or time ends it.

    A trade is followed for `most` bars, by default the reference's limit for its timeframe. Each signal row carries its path as an array, so the fold
    needs no state beyond the row."""
    numbered = _numbered(bars)
    df = signals.join(numbered.select(*series.KEYS, "bar_ts", "no"), [*series.KEYS, "bar_ts"])
    return _walked(_with_paths(numbered, df, longest() if most is None else F.lit(most)), costs, tie_rule)


def _walked(df: DataFrame, costs: Costs, tie_rule: str, keep: tuple[str, ...] = ()) -> DataFrame:
    df = df.where("size(_path) > 0")
    long = "direction = 'LONG'"
    step = f"""
        IF(s.done IS NOT NULL, s, named_struct(
          'n', s.n + 1,
          'tp1', s.tp1 OR (IF({long}, x.high >= tp1, x.low <= tp1) AND ({'true' if tie_rule == 'tp1_first' else 'NOT ' + f"IF({long}, x.low <= s.sl, x.high >= s.sl)"})),
          'sl', IF(s.tp1 OR (IF({long}, x.high >= tp1, x.low <= tp1) AND ({'true' if tie_rule == 'tp1_first' else 'NOT ' + f"IF({long}, x.low <= s.sl, x.high >= s.sl)"})), entry, s.sl),
          'mfe', greatest(s.mfe, IF({long}, x.high - entry, entry - x.low) / risk),
          'mae', greatest(s.mae, IF({long}, entry - x.low, x.high - entry) / risk),
          'exit', CASE WHEN {{hit}} THEN {{stop}} WHEN IF({long}, x.high >= tp2, x.low <= tp2) THEN tp2 ELSE x.close END,
          'done', CASE WHEN {{hit}} THEN IF({{moved}}, 'breakeven', 'loss') WHEN IF({long}, x.high >= tp2, x.low <= tp2) THEN 'win_tp2' END,
          'at', x.bar_ts))"""
    if tie_rule == "tp1_first":
        moved = f"(s.tp1 OR IF({long}, x.high >= tp1, x.low <= tp1))"
        stop = f"IF({moved}, entry, s.sl)"
    else:
        moved, stop = "s.tp1", "s.sl"
    hit = f"IF({long}, x.low <= {stop}, x.high >= {stop})"
    step = step.format(hit=hit, stop=stop, moved=moved)
    fold = f"aggregate(_path, named_struct('n', 0, 'tp1', false, 'sl', sl, 'mfe', 0.0D, 'mae', 0.0D, 'exit', entry, 'done', CAST(NULL AS STRING), 'at', bar_ts), (s, x) -> {step})"
    df = df.withColumn("_s", F.expr(fold))
    late = F.col("_s.done").isNull()
    price = F.when(late & F.col("_s.tp1"), F.col("tp1")).otherwise(F.col("_s.exit"))
    outcome = F.when(late & F.col("_s.tp1"), "win_tp1").when(late, "timeout").otherwise(F.col("_s.done"))
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    paid = F.col("entry") * (1 + sign * (costs.spread + costs.slippage))
    gross = sign * (price - paid) / F.col("risk")
    cost = (F.col("entry") * costs.commission + price * (costs.spread + costs.commission + costs.slippage)) / F.col("risk")
    return df.select(*series.KEYS, *keep, F.col("bar_ts").alias("entry_time"), F.col("_s.at").alias("exit_time"), "direction", "entry", price.alias("exit"),
        outcome.alias("outcome"), (gross - cost).alias("r_multiple"), F.col("_s.n").alias("bars_held"), F.col("_s.mfe").alias("mfe"), F.col("_s.mae").alias("mae"))


def windows(bars: DataFrame, *, train: int, test: int, step: int, embargo: int = 0, anchored: bool = False) -> DataFrame:
    """M3: train and test ranges of bar numbers (end exclusive) for each series."""
    n = bars.groupBy(*series.KEYS).agg(F.count("*").alias("bars"))
    last = F.col("bars") - train - embargo - test
    df = n.where(last >= 0).select(*series.KEYS, F.posexplode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("window", "start"))
    begin = F.lit(0).cast("long") if anchored else F.col("start")
    return df.select(*series.KEYS, "window", begin.alias("train_start"), (F.col("start") + train).alias("train_end"),
        (F.col("start") + train + embargo).alias("test_start"), (F.col("start") + train + embargo + test).alias("test_end"))


def walk_forward(bars: DataFrame, grid: list[dict], *, train: int, test: int, step: int, embargo: int = longest("1h"), least: int = 3) -> DataFrame:
    """M4/M5: each window picks the parameter set of best mean R in its train range and reports it in its test range.

    Trades run to their own end or the limit of `walk`; those of a train range are followed to the bar before the test range at most, so none is scored by
    bars of it. An embargo of the longest trade (the default, as in the reference) lets all of them end.

    grid: parameter sets of `sweep_signals` (a small driver-side list); the passes over the bars are one per set, unioned."""
    numbered = _numbered(bars)
    signals = None
    for i, params in enumerate(grid):
        one = sweep_signals(bars, **params).withColumn("combo", F.lit(i))
        signals = one if signals is None else signals.union(one)
    signals = signals.join(numbered.select(*series.KEYS, "bar_ts", "no"), [*series.KEYS, "bar_ts"])
    w = windows(bars, train=train, test=test, step=step, embargo=embargo)
    inside = signals.join(w, list(series.KEYS)).where("no >= train_start AND no < train_end OR no >= test_start AND no < test_end")
    is_train, is_test = F.col("no") < F.col("train_end"), F.col("no") >= F.col("test_start")
    known = F.when(is_train, F.slice("_path", F.lit(1), F.greatest(F.col("test_start") - F.col("no") - 1, F.lit(0)).cast("int"))).otherwise(F.col("_path"))
    inside = _walked(_with_paths(numbered, inside, longest()).withColumn("_path", known), Costs(), "sl_first", ("window", "combo", "no", "train_end", "test_start"))
    r = F.col("r_multiple")
    per = inside.groupBy(*series.KEYS, "window", "combo").agg(F.count(F.when(is_train, r)).alias("n_is"), F.avg(F.when(is_train, r)).alias("is_r"),
        F.count(F.when(is_test, r)).alias("n_oos"), F.avg(F.when(is_test, r)).alias("oos_r"))
    best = Window.partitionBy(*series.KEYS, "window").orderBy(F.desc("is_r"), "combo")
    return per.where(F.col("n_is") >= least).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
