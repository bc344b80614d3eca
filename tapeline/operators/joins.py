"""Time-aware joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import correlation
from .trades import running


def asof(left: DataFrame, right: DataFrame, *, keys: dict[str, str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """To each left row the latest right row of its key at or before its time.

    Rows meet in windows of (key, day), so a hot key is spread over its days; what the last earlier day leaves to a day
    comes from one row per key and day."""
    lk, rk = list(keys), list(keys.values())
    names = [f"_k{i}" for i in range(len(lk))]
    value = F.struct(F.col(right_time).alias("_rt"), *columns)
    l_ = left.select(*[F.col(k).alias(n) for k, n in zip(lk, names, strict=True)], F.col(left_time).alias("_t"), F.lit(1).alias("_o"), F.struct(*left.columns).alias("_left"))
    r_ = right.select(*[F.col(k).alias(n) for k, n in zip(rk, names, strict=True)], F.col(right_time).alias("_t"), F.lit(0).alias("_o"), value.alias("_right"))
    both = l_.unionByName(r_, allowMissingColumns=True).withColumn("_day", F.to_date("_t"))
    last = both.groupBy(*names, "_day").agg(F.max("_right").alias("_last"))
    carry = last.withColumn("_carry", F.last("_last", True).over(Window.partitionBy(*names).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    w = Window.partitionBy(*names, "_day").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_in", F.last("_right", True).over(w)).where("_o = 1").join(carry, [*names, "_day"], "left")
    hit = F.coalesce("_in", "_carry")
    return found.select("_left.*", *[hit[c].alias(c) for c in columns])


def nearest(left: DataFrame, right: DataFrame, *, keys: dict[str, str], left_time: str, right_time: str) -> DataFrame:
    """The right time nearest to each left time; the earlier one when two are as near."""
    before = asof(left, right.withColumn("_before", F.col(right_time)), keys=keys, left_time=left_time, right_time=right_time, columns=["_before"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    nxt = right.withColumn("_after", F.lead(right_time).over(Window.partitionBy(*keys.values()).orderBy(right_time))).withColumn("_before",
        F.col(right_time)).select(*keys.values(), "_before", "_after")
    first = right.groupBy(*keys.values()).agg(F.min(right_time).alias("_first"))
    out = before
    for k, v in keys.items():
        nxt, first = nxt.withColumnRenamed(v, f"_r_{k}"), first.withColumnRenamed(v, f"_f_{k}")
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    nxt = nxt.withColumnRenamed("_before", "_b2")
    cond = same[0]
    for s in same[1:]:
        cond &= s
    cond &= F.col("_before") == F.col("_b2")
    start = F.col(next(iter(keys))) == F.col(f"_f_{next(iter(keys))}")
    for k in list(keys)[1:]:
        start &= F.col(k) == F.col(f"_f_{k}")
    out = out.join(nxt, cond, "left").join(first, start, "left")
    later = F.when(F.col("_before").isNull(), F.col("_first")).otherwise(F.col("_after"))
    best = F.when(later.isNull() | (F.col("_before").isNotNull() & (micros(left_time) - micros("_before") <= F.unix_micros(later.cast("timestamp")) - micros(left_time))), F.col("_before")).otherwise(later)
    return out.select(*left.columns, best.alias("nearest"))


def filled_from(left: DataFrame, companion: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left with its missing values of `columns` taken from the companion table's row of the same key."""
    other = companion.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return left.join(other, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in left.columns])


def aligned(first: DataFrame, others: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Inner joins of tables by their own keys; only rows that all of them have stay."""
    for df, keys in others:
        first = first.join(df, keys)
    return first


def in_every_window(scores: DataFrame) -> DataFrame:
    """Scores (window, combo, score) of the combos that every window has."""
    n = scores.agg(F.countDistinct("window").alias("_n"))  # one row
    whole = scores.groupBy("combo").agg(F.countDistinct("window").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("combo")
    return scores.join(whole, "combo", "left_semi")


def open_positions(trades: DataFrame, times: DataFrame, *, key: str, time: str) -> DataFrame:
    """How many trades are open (entry <= t < exit) at each time of `times` (key, time): a running sum of entries less exits, without a range join."""
    ins = trades.select(key, F.col("entry_time").alias("_t"), F.lit(1).alias("_d"), F.lit(0).alias("_o"))
    outs = trades.select(key, F.col("exit_time").alias("_t"), F.lit(-1).alias("_d"), F.lit(0).alias("_o"))
    asks = times.select(key, F.col(time).alias("_t"), F.lit(0).alias("_d"), F.lit(1).alias("_o"))
    # same moment: all entries and exits come before the question
    return running(ins.union(outs).union(asks), [key], ["_t", "_o"], F.col("_d"), "open_trades").where("_o = 1").select(key, F.col("_t").alias(time), "open_trades")


def daily_r(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """R per day of exit."""
    return trades.groupBy(by, F.to_date("exit_time").cast("string").alias("day")).agg(F.sum("r_multiple").alias("r"))


def overlap_wide(daily: DataFrame, labels: list[str], *, outer: bool) -> DataFrame:
    """One column per given label by date; outer fills 0, inner keeps only the dates that all have. All labels of the data: `overlap_long`."""
    wide = daily.groupBy("day").pivot("strategy", labels).agg(F.sum("r"))
    return wide.fillna(0.0) if outer else wide.dropna(subset=labels)


def overlap_long(daily: DataFrame, *, outer: bool) -> DataFrame:
    """J8/J9 for all labels that the data has, a row per date and label; outer fills 0, inner keeps only the dates that all have."""
    if outer:
        grid = daily.select("day").distinct().crossJoin(daily.select("strategy").distinct())  # days times labels, as the result has
        return grid.join(daily, ["day", "strategy"], "left").fillna(0.0, ["r"])
    whole = daily.groupBy("day").agg(F.count("*").alias("_n")).join(daily.agg(F.countDistinct("strategy").alias("_all"))).where("_n = _all")  # one row
    return daily.join(whole.select("day"), "day")


def pair_correlations(long: DataFrame) -> DataFrame:
    """Correlation of each pair of labels over the dates that both have."""
    b = long.select("day", F.col("strategy").alias("b"), F.col("r").alias("_r"))
    out = long.withColumnRenamed("strategy", "a").join(b, "day").where("a < b").groupBy("a", "b").agg(correlation(F.col("r"), F.col("_r")).alias("corr"))
    return out.withColumn("corr", F.round(F.col("corr") + 1.37e-7, 4) + F.lit(0.0)).withColumn("flag", F.when(F.abs("corr") > 0.5, "high").when(F.abs("corr") < 0.1,
        "low").otherwise("mid"))


def missing_pairs(trades: DataFrame, a: str = "strategy", b: str = "symbol") -> DataFrame:
    """Combinations of two small dimensions that no trade has. Dimensions are the distinct values."""
    have = trades.select(a, b).distinct()
    grid = have.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b")).select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    return grid.join(have, [a, b], "left_anti")


def match_one_to_one(live: DataFrame, shadow: DataFrame, *, keys: list[str], most: int) -> DataFrame:
    """In order of time each live row takes the nearest shadow row within `most` bars that is not yet taken.

    live and shadow: keys, id, bar (int). Returns keys, live_id, shadow_id, kind (matched, missed, phantom). Rows further than `most` bars from any
    other never meet, so each key is first cut at such gaps; a task gets one stretch without a gap."""
    import bisect

    import pandas as pd

    both = live.select(*keys, F.lit("live").alias("side"), "id", "bar").union(shadow.select(*keys, F.lit("shadow").alias("side"), "id", "bar"))
    w = Window.partitionBy(*keys).orderBy("bar", "side", "id")
    cut = F.coalesce(F.col("bar") - F.lag("bar").over(w) > most, F.lit(True)).cast("int")
    both = both.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def greedy(pdf):
        one, two = pdf[pdf.side == "live"].sort_values(["bar", "id"]), pdf[pdf.side == "shadow"].sort_values(["bar", "id"])
        free = list(zip(two["bar"], two["id"], strict=True))  # sorted, so the nearest are found by bisection
        rows = []
        for bar, id_ in zip(one["bar"], one["id"], strict=True):
            at = bisect.bisect_left(free, (bar,))
            near = [at] if at < len(free) else []
            if at:
                near.append(bisect.bisect_left(free, (free[at - 1][0],)))  # of the bar before the first row
            near = [(abs(free[i][0] - bar), free[i][0], i) for i in near if abs(free[i][0] - bar) <= most]
            best = free.pop(min(near)[2]) if near else None
            rows.append((id_, best[1] if best else None, "matched" if best else "missed"))
        rows += [(None, i, "phantom") for _, i in free]
        out = pd.DataFrame(rows, columns=["live_id", "shadow_id", "kind"])
        for n, k in enumerate(keys):
            out.insert(n, k, pdf[k].iloc[0])
        return out

    types = dict(both.dtypes)
    kind = ", ".join(f"{k} {types[k]}" for k in keys) + f", live_id {types['id']}, shadow_id {types['id']}, kind string"
    return both.groupBy(*keys, "_part").applyInPandas(greedy, kind)


