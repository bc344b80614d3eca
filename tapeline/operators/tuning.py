"""M5, V1, V2: parameter sets scored over the trades that they let pass, the best set of each window, and how its parameters move from window to window and key to key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import rounded

METRICS = ("expectancy", "profit_factor", "sharpe", "total_r")


def score(metric: str) -> Column:
    """M5 as an aggregate over r_multiple: expectancy, profit_factor (0 without losses), sharpe (0 without spread) or total_r; minus infinity for fewer than two trades."""
    if metric not in METRICS:
        raise ValueError(f"metric: one of {METRICS}")
    r = F.col("r_multiple")
    n, lost, sd = F.count(r), F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))), F.stddev_samp(r)
    won = F.avg((r > 0).cast("double"))
    value = {
        "expectancy": won * F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)) + (1 - won) * F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)),
        "profit_factor": F.when(lost > 0, F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / F.nullif(lost, F.lit(0.0))).otherwise(0.0),
        "sharpe": F.when(sd > 0, F.avg(r) / F.nullif(sd, F.lit(0.0))).otherwise(0.0),
        "total_r": F.sum(r),
    }[metric]
    return F.when(n < 2, F.lit(float("-inf"))).otherwise(value)


def by_sets(trades: DataFrame, sets: list[dict[str, float]], passes) -> DataFrame:
    """Each trade once for every parameter set that lets it pass, with `set_no` and `params`. passes(params column): condition; a set without a parameter does not ask for it.

    sets: a short list, put into the plan; nothing is joined."""
    made = F.array(*[F.struct(F.lit(i).alias("no"), F.create_map(*[x for k, v in sorted(s.items()) for x in (F.lit(k), F.lit(float(v)))]).alias("params")) for i, s in enumerate(sets)])
    df = trades.withColumn("_set", F.explode(made)).withColumn("set_no", F.col("_set.no")).withColumn("params", F.col("_set.params")).drop("_set")
    return df.where(passes(F.col("params")))


def best_sets(passed: DataFrame, keys: list[str], metric: str = "expectancy") -> DataFrame:
    """keys, set_no, params, n, score: the best set of each window (ties: the first); windows in which no set has two trades have none."""
    df = passed.where("r_multiple IS NOT NULL").groupBy(*keys, "set_no").agg(F.first("params").alias("params"), F.count("*").alias("n"), score(metric).alias("score")).where("n > 1")
    top = F.min_by(F.struct("set_no", "params", "n", "score"), F.struct(-rounded(F.col("score"), 9), F.col("set_no"))).alias("_t")
    return df.groupBy(*keys).agg(top).select(*keys, "_t.*")


def parameter_matrix(best: DataFrame, by: str = "strategy", window: str = "window") -> DataFrame:
    """V1: by, parameter, window, value and its place between the parameter's least (0) and largest (1) over the windows of its key, 0.5 where it does not move; a row for each
    window and parameter of a key, null where the window's set lacks it."""
    long = best.select(by, window, F.explode("params").alias("parameter", "value"))
    grid = best.select(by, window).distinct().join(long.select(by, "parameter").distinct(), by)  # as large as the result
    df = grid.join(long, [by, window, "parameter"], "left")
    w = Window.partitionBy(by, "parameter")  # a row a window
    low, high, v = F.min("value").over(w), F.max("value").over(w), F.col("value")
    place = F.when(v.isNotNull(), F.coalesce(F.try_divide(v - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.5)))
    return df.select(by, "parameter", window, "value", place.alias("place"))


def latest_parameters(best: DataFrame, by: str = "strategy", window: str = "window") -> DataFrame:
    """V2: by, parameter, value of each key's last window, 0 where it lacks one that another key has; no rows for a single key."""
    last = best.groupBy(by).agg(F.max_by("params", window).alias("params"))  # a row a key
    names = last.select(F.explode(F.map_keys("params")).alias("parameter")).distinct()
    many = last.agg(F.count("*").alias("_n")).where("_n > 1").select()
    return last.crossJoin(names).crossJoin(many).select(by, "parameter", F.coalesce(F.col("params")[F.col("parameter")], F.lit(0.0)).alias("value"))  # as large as the result


def sampled(df: DataFrame, most: int, key: str, *, seed: int = 42) -> DataFrame:
    """`most` rows at random (all where there are no more): those with the smallest hashes of (seed, key), so reruns agree. key: names a row."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(most)
