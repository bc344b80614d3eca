"""Price zones: first passage over a tree of block extremes, the lives of imbalance zones, and signals at their touches.

`first_passage` finds for each level the first later bar at or beyond it.  A series' bars are kept in blocks, with the extremes of the blocks in blocks of their own and
the extremes of those in one row a series.  A question looks into the rest of its own block, then among the rest of the block's neighbours, then among all further
ones, and goes back down; each step is an equi-join with one array, so the work grows with the questions, not with how far they have to look.

Defined results: a level that no later bar reaches has a null hit; null extremes reach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .ordering import greatest_before, in_blocks

#: Weights of the score of a touch, and what makes stops and targets. Fixed values of the strategy.
GAP_WEIGHT, VOLUME, TREND, MOMENTUM, STRUCTURE, MOVE, SWEEP, VOLATILE = 0.20, 0.15, 0.15, 0.10, 0.10, 0.15, 0.15, 0.10
BUFFER, RETEST_REWARD, FLIPPED_REWARD = 0.3, 3.0, 2.0
COOLDOWN, YOUNGEST = 4, 2


# ---------------------------------------------------------------- first passage


def first_passage(questions: DataFrame, bars: DataFrame, *, by: list[str], low: str, high: str, no: str = "no", strict: bool = True, block: int = 256) -> DataFrame:
    """questions with `hit`: the number of the first bar from `start` on whose `low` falls below `level` (where `below`) or whose `high` rises above it.

    questions: by, start, level, below and columns of their own. bars: by, no (from 1 without holes), low, high. strict=False: reaching the level is enough."""
    own = questions.columns
    flip = lambda c: (-F.col(c)).alias("_up")  # noqa: E731  above is below with the sign turned
    rows = bars.select(*by, (F.col(no) - 1).alias("_i"), F.col(low).cast("double").alias("_down"), flip(high))

    def level(df: DataFrame) -> DataFrame:
        """Blocks of df's rows, with the extremes of each as rows of the level above."""
        df = df.withColumn("_b", F.floor(F.col("_i") / block))
        lists = F.sort_array(F.collect_list(F.struct("_i", "_down", "_up")))
        return df.groupBy(*by, "_b").agg(F.transform(lists, lambda r: r["_down"]).alias("_downs"), F.transform(lists, lambda r: r["_up"]).alias("_ups"), F.min("_down").alias("_down"), F.min("_up").alias("_up"))

    leaves = level(rows)
    nodes = level(leaves.select(*by, F.col("_b").alias("_i"), "_down", "_up"))
    lists = F.sort_array(F.collect_list(F.struct("_b", "_down", "_up")))
    roots = nodes.groupBy(*by).agg(F.transform(lists, lambda r: r["_down"]).alias("_downs"), F.transform(lists, lambda r: r["_up"]).alias("_ups"))
    leaves, nodes = leaves.drop("_down", "_up"), nodes.drop("_down", "_up")

    wanted = F.when(F.col("below"), F.col("level")).otherwise(-F.col("level")).cast("double")
    df = questions.withColumns({"_level": wanted, "_from": (F.col("start") - 1).cast("long"), "_hit": F.lit(None).cast("long")})

    def look(df: DataFrame, table: DataFrame, at: Column | None, first: Column, name: str, on: Column) -> DataFrame:
        """df with `name`: the first place from `first` on, in the array that `at` names, that reaches the level; null where not `on` or none does."""
        keys = list(by)
        if at is not None:
            df, keys = df.withColumn("_b", F.when(on, at).cast("long")), [*by, "_b"]
        df = df.join(table, keys, "left")
        values = F.when(F.col("below"), F.col("_downs")).otherwise(F.col("_ups"))
        reached = lambda v, i: (i >= first) & ((v < F.col("_level")) if strict else (v <= F.col("_level")))
        place = F.array_position(F.transform(values, lambda v, i: F.coalesce(reached(v, i), F.lit(False))), True)
        return df.withColumn(name, F.when(on & (place > 0), place - 1)).drop("_downs", "_ups", "_b")

    yes, none = F.lit(True), F.lit(0)
    df = look(df, leaves, F.floor(F.col("_from") / block), F.col("_from") % block, "_in", yes)
    df = df.withColumn("_hit", F.floor(F.col("_from") / block) * block + F.col("_in")).withColumn("_next", F.floor(F.col("_from") / block) + 1).drop("_in")
    df = look(df, nodes, F.floor(F.col("_next") / block), F.col("_next") % block, "_in", F.col("_hit").isNull())
    df = df.withColumn("_leaf", F.floor(F.col("_next") / block) * block + F.col("_in")).drop("_in")
    far = F.col("_hit").isNull() & F.col("_leaf").isNull()
    df = look(df, roots, None, F.floor(F.col("_next") / block) + 1, "_node", far)
    df = look(df, nodes, F.col("_node"), none, "_in", far & F.col("_node").isNotNull())
    df = df.withColumn("_leaf", F.coalesce("_leaf", F.col("_node") * block + F.col("_in"))).drop("_in")
    df = look(df, leaves, F.col("_leaf"), none, "_in", F.col("_hit").isNull() & F.col("_leaf").isNotNull())
    return df.withColumn("hit", (F.coalesce("_hit", F.col("_leaf") * block + F.col("_in")) + 1).cast("int")).select(*own, "hit")


# ---------------------------------------------------------------- zones


def _within(df: DataFrame, by: list[str], back: int) -> tuple[DataFrame, Window]:
    return in_blocks(df, by, back), Window.partitionBy(*by, "_block").orderBy("no")


def zones(bars: DataFrame, *, by: list[str], least: float = 0.002) -> DataFrame:
    """G1: imbalances of three numbered bars: by, formed (the third bar's number), bullish, top, bottom, share (of the middle close), busy (volume of the middle bar
    above 1.2 times the mean of its last 20, ten at least)."""
    df, w = _within(bars.select(*by, "no", "high", "low", "close", "volume"), by, 21)
    high2, low2, mid = F.lag("high", 2).over(w), F.lag("low", 2).over(w), F.lag("close").over(w)
    last = w.rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(last) >= 10, F.avg("volume").over(last))
    df = df.withColumns({"bullish": F.when(high2 < F.col("low"), True).when(low2 > F.col("high"), False), "_h2": high2, "_l2": low2, "_mid": mid,
        "busy": F.coalesce((mean > 0) & (F.lag("volume").over(w) > 1.2 * mean), F.lit(False))}).where("NOT _halo AND bullish IS NOT NULL AND _mid > 0")
    top, bottom = F.when(F.col("bullish"), F.col("low")).otherwise(F.col("_l2")), F.when(F.col("bullish"), F.col("_h2")).otherwise(F.col("high"))
    df = df.withColumns({"top": top, "bottom": bottom}).withColumn("share", (F.col("top") - F.col("bottom")) / F.col("_mid"))
    return df.where((F.col("top") > F.col("bottom")) & (F.col("share") >= least)).select(*by, F.col("no").alias("formed"), "bullish", "top", "bottom", "share", "busy")


def zone_lives(bars: DataFrame, *, by: list[str], least: float = 0.002, age: int = 50) -> DataFrame:
    """G1: zones with `broken` (number of the first bar, up to `age` after it formed, that closes beyond the far edge; null: none, the zone expires) and `touched`
    (first bar from the next on that reaches the near edge, up to `age` after it; null: none)."""
    z = cut(zones(bars, by=by, least=least))
    broken = first_passage(z.withColumns({"start": F.col("formed"), "level": F.when(F.col("bullish"), F.col("bottom")).otherwise(F.col("top")), "below": F.col("bullish")}),
        bars, by=by, low="close", high="close")
    timely = lambda c: F.when(F.col(c) - F.col("formed") <= age, F.col(c))
    z = broken.withColumn("broken", timely("hit")).drop("hit")
    z = first_passage(z.withColumns({"start": F.col("formed") + 1, "level": F.when(F.col("bullish"), F.col("top")).otherwise(F.col("bottom"))}), bars, by=by, low="low", high="high", strict=False)
    return z.withColumn("touched", timely("hit")).drop("hit", "start", "level", "below")


# ---------------------------------------------------------------- signals


def touches(bars: DataFrame, *, by: list[str], least: float = 0.002, age: int = 50, confidence: float = 0.45) -> DataFrame:
    """G1: each bar that meets a live zone (`retest`) or one that was broken and changed sides (`flipped`), where the gates let it pass and the score is high enough.

    bars: by, no, bar_ts, OHLCV, atr, and where there are such columns rsi, ema_50 with ema_200, structure, dvol, calm (true: no trade), rv_rank (0 to 1)."""
    have, bars = set(bars.columns), cut(bars)
    lives = cut(zone_lives(bars, by=by, least=least, age=age))
    same = [*by, "top", "bottom", "share", "busy", "formed"]
    retest = lives.select(*same, F.lit(0).alias("flipped"), F.col("formed").alias("since"), F.col("bullish").alias("long"), F.least(F.col("formed") + age, F.col("broken") - 1).alias("until"))
    flipped = lives.where("broken IS NOT NULL").select(*same, F.lit(1).alias("flipped"), F.col("broken").alias("since"), (~F.col("bullish")).alias("long"), (F.col("broken") + age).alias("until"))
    live = retest.union(flipped).where(F.col("until") >= F.col("since") + YOUNGEST)
    live = live.withColumn("no", F.explode(F.sequence(F.col("since") + YOUNGEST, F.col("until"))))  # at most `age` bars a zone
    df, w = _within(bars, by, 26)
    move = F.when(F.lag("close", 5).over(w) > 0, F.abs(F.col("close") / F.lag("close", 5).over(w) - 1)).otherwise(0.0)
    enough = F.col("no") > 25
    before, now = w.rowsBetween(-25, -6), w.rowsBetween(-5, 0)
    df = df.withColumns({"_move": F.coalesce(move, F.lit(0.0)), "_swept_low": F.when(enough, F.min("low").over(now) < F.min("low").over(before)).otherwise(True),
        "_swept_high": F.when(enough, F.max("high").over(now) > F.max("high").over(before)).otherwise(True)}).where("NOT _halo").drop("_block", "_halo")
    df = live.join(df, [*by, "no"]).where((F.col("low") <= F.col("top")) & (F.col("high") >= F.col("bottom")) & (F.col("atr") > 0) & ~F.isnan("atr"))
    long, second = F.col("long"), F.col("flipped") == 1
    sided = lambda up, down: F.coalesce(F.when(long, up).otherwise(down), F.lit(False))
    add = lambda hit, value: F.when(hit, value).otherwise(0.0)
    if "dvol" in have:
        dvol = F.col("dvol")
        barred = F.when(second, (dvol < 45) & long).otherwise((dvol < 45) & ~long | (dvol >= 65) & long)
        df = df.where(~F.coalesce(barred, F.lit(False)))
    else:
        df = df.where(F.hour("bar_ts").between(7, 20))
    if "calm" in have:
        df = df.where(~F.coalesce("calm", F.lit(False)))
    score = F.least(F.col("share") / 0.005, F.lit(1.0)) * GAP_WEIGHT + add(F.col("busy"), VOLUME)
    trend = sided(F.col("ema_50") > F.col("ema_200"), F.col("ema_50") < F.col("ema_200")) if {"ema_50", "ema_200"} <= have else F.lit(False)
    shape = sided(F.col("structure") > 0, F.col("structure") < 0) if "structure" in have else F.lit(False)
    score = score + add(trend, TREND)
    if "rsi" in have:
        score = score + add(sided(F.col("rsi").between(30, 55), F.col("rsi").between(45, 70)), MOMENTUM)
    score = score + add(shape, STRUCTURE) + F.least(F.col("_move") / 0.015, F.lit(1.0)) * MOVE + add(sided(F.col("_swept_low"), F.col("_swept_high")), SWEEP)
    if "rv_rank" in have:
        rank = F.when(~F.isnan("rv_rank"), F.col("rv_rank"))
        df = df.where(~second | F.coalesce(rank >= 0.5, F.lit(True)))
        score = score + add(second & F.coalesce(rank >= 0.5, F.lit(False)), VOLATILE)
    df = df.withColumns({"score": score, "aligned": trend & shape}).where(F.col("score") >= confidence)
    return df.select(*by, "no", "bar_ts", "flipped", "since", "formed", "long", "top", "bottom", "atr", "score", "aligned")


def _chosen(batches: Iterator[pa.RecordBatch], by: list[str], age: int) -> Iterator[pa.RecordBatch]:
    """Of touches in order of (by, stretch, no, flipped, best score first): those whose zone is unused, COOLDOWN bars after the one before at least."""
    key, last, used = None, 0, {}
    for batch in batches:
        take = []
        names = [*by, "_stretch"]
        for *own, no, kind, since in zip(*(batch.column(c).to_pylist() for c in (*names, "no", "flipped", "since")), strict=True):
            if own != key:
                key, last, used = own, -COOLDOWN, {}
            good = no - last >= COOLDOWN and (kind, since) not in used
            if good:
                last, used[kind, since] = no, no
                if len(used) > 4 * age:
                    used = {z: at for z, at in used.items() if z[1] + age >= no}
            take.append(good)
        yield batch.filter(pa.array(take, pa.bool_()))


def zone_signals(bars: DataFrame, *, by: list[str], least: float = 0.002, age: int = 50, confidence: float = 0.45) -> DataFrame:
    """G1: entries at touched zones, one a bar (a retest before a flipped zone, then the best score, then the older zone), each zone (of a flipped one: each bar that
    breaks zones) once, COOLDOWN bars apart, with stop and targets.

    Touches fall into stretches that share neither a zone nor a cooldown; within one the choice is a fold over its touches, which holds the zones of the last `age` bars."""
    found = cut(touches(bars, by=by, least=least, age=age, confidence=confidence))
    spans = found.groupBy(*by, "flipped", "since").agg(F.min("no").alias("no"), (F.max("no") + COOLDOWN).alias("_end"))
    starts = greatest_before(spans, by, "_end").where(F.col("before").isNull() | (F.col("before") <= F.col("no"))).select(*by, F.col("no").alias("_begin")).distinct()
    # of each touch the last stretch that begins at or before it
    rows = found.withColumn("_begin", F.lit(None).cast("int")).unionByName(starts.withColumn("no", F.col("_begin") - 1), allowMissingColumns=True)
    df = greatest_before(rows, by, "_begin", name="_stretch").where("since IS NOT NULL").drop("_begin")
    df = df.repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", "no", "flipped", F.desc("score"), "since", "formed", F.desc("long"))
    df = df.mapInArrow(lambda b: _chosen(b, by, age), df.schema)
    height = F.col("top") - F.col("bottom")
    entry, room = (F.col("top") + F.col("bottom")) / 2, F.greatest(height * BUFFER, F.col("atr") * BUFFER)
    sign = F.when(F.col("long"), 1.0).otherwise(-1.0)
    df = df.withColumns({"entry": entry, "sl": F.when(F.col("long"), F.col("bottom") - room).otherwise(F.col("top") + room)}).withColumn("risk", F.abs(F.col("entry") - F.col("sl")))
    reward = F.when(F.col("flipped") == 1, FLIPPED_REWARD).otherwise(RETEST_REWARD)
    return df.select(*by, "no", "bar_ts", F.when(F.col("long"), "LONG").otherwise("SHORT").alias("direction"), F.when(F.col("flipped") == 1, "IFVG").otherwise("RETEST").alias("signal_type"),
        "entry", "sl", (F.col("entry") + sign * reward * F.col("risk")).alias("tp1"), (F.col("entry") + sign * reward * 1.5 * F.col("risk")).alias("tp2"), "risk",
        F.col("score").alias("confidence"), F.when(F.col("aligned"), "ALIGNED").otherwise("PARTIAL").alias("bias"), "formed", "since")
