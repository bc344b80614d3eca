"""Volatility clustering and heavy tails of trade results.

GARCH(1,1): the variance h after a trade is omega + alpha * e^2 + beta * h, an affine recurrence, and so are its three derivatives.  A series is cut into
blocks; a block's effect on (h, its derivatives) is beta to the power of its length and four own sums, so blocks are composed by one row each, and a second
pass gives each block's part of the log likelihood, its gradient and its expected information.  The fit takes damped scoring steps within the bounds.  Series of
at most `whole` trades are fitted within one task each, longer ones by rounds of one job each with the same functions, over stretches that need no other.

Defined results: rows without an R take no part; a key with fewer than 20 trades or without spread has no model (nulls); ties in time are ordered by R.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.distributions import chi2_sf, normal_quantile
from ..functions.metrics import ratio, rounded
from ..functions.storage import cut
from .ordering import in_blocks, positions, ranked

#: Bounds of omega, alpha, beta; where the search begins (omega in units of the variance). Fixed values of the model.
LOW, HIGH = np.array([1e-6, 1e-6, 1e-6]), np.array([np.inf, 0.5, 0.99])
BEGIN = (0.05, 0.10, 0.85)
#: Trades of a stretch of a long series, and of what it brings along before it: with beta at most 0.99, what lies REACH trades back weighs 1e-18.
STRETCH, REACH = 32_768, 4_096


# ---------------------------------------------------------------- blocks in numpy


def block_maps(e2: np.ndarray, size: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Per block (beta^n, n beta^(n-1), and what comes out of nothing coming in: h and its derivatives)."""
    omega, alpha, beta = theta.T
    out = np.zeros((4, len(e2)))
    for t in range(e2.shape[1]):
        h, a, b, c = out
        new = np.stack([omega + alpha * e2[:, t] + beta * h, 1 + beta * a, e2[:, t] + beta * b, h + beta * c])
        out = np.where(t < size, new, out)
    return np.column_stack([beta**size, size * beta ** (size - 1.0), out.T])


def incoming(maps: np.ndarray, variance: float) -> np.ndarray:
    """(h, derivatives) at the first trade of each block of a series."""
    out = np.zeros((len(maps), 4))
    now = np.array([variance, 0.0, 0.0, 0.0])
    for i, (m, dm, *own) in enumerate(maps):
        out[i] = now
        now = m * now + np.array([0.0, 0.0, 0.0, dm * now[0]]) + own
    return out


def block_sums(e2: np.ndarray, size: np.ndarray, theta: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per block the log likelihood, its gradient (3) and expected information (6, upper triangle by rows)."""
    omega, alpha, beta = theta.T
    h, a, b, c = before.T
    out = np.zeros((10, len(e2)))
    for t in range(e2.shape[1]):
        live = t < size
        x = e2[:, t]
        d = np.stack([a, b, c]) / h
        pull = 0.5 * (x / h - 1)
        now = np.concatenate([[-0.5 * (np.log(h) + x / h)], pull * d, 0.5 * np.stack([d[i] * d[j] for i in range(3) for j in range(i, 3)])])
        out += np.where(live, now, 0.0)
        h, a, b, c = np.where(live, [omega + alpha * x + beta * h, 1 + beta * a, x + beta * b, h + beta * c], [h, a, b, c])
    return out.T


def search_step(state: dict, found: np.ndarray, tol: float) -> dict:
    """One damped scoring step: `found` are the sums at state['trial']; gives the state with the next trial or done."""
    s = dict(state)
    s["rounds"] += 1
    if found[0] > s["ll"]:
        gain, s["theta"], s["ll"], s["sums"] = found[0] - s["ll"], s["trial"], found[0], found
        s["damp"] = max(s["damp"] / 5, 1e-9)
        s["still"] = s["still"] + 1 if gain < tol * (1 + abs(found[0])) else 0
    else:
        s["damp"] *= 4
        s["still"] = s["still"] + 1 if s["damp"] > 1e8 else s["still"]
    theta, g, info = np.array(s["theta"]), np.array(s["sums"][1:4]), np.zeros((3, 3))
    info[np.triu_indices(3)] = s["sums"][4:]
    info += np.triu(info, 1).T
    held = (theta <= LOW) & (g < 0) | (theta >= HIGH) & (g > 0)
    free = np.flatnonzero(~held)
    step = np.zeros(3)
    if len(free):
        m = info[np.ix_(free, free)]
        step[free] = np.linalg.lstsq(m + s["damp"] * np.diag(np.maximum(np.diag(m), 1e-12)), g[free], rcond=None)[0]
    s["trial"] = np.clip(theta + step, LOW, HIGH).tolist()
    s["done"] = s["still"] >= 3 or not np.any(np.abs(np.array(s["trial"]) - theta) > 1e-13)
    return s


def first_state(variance: float) -> dict:
    theta = np.clip([BEGIN[0] * variance, BEGIN[1], BEGIN[2]], LOW, HIGH).tolist()
    return {"theta": theta, "trial": theta, "ll": -np.inf, "sums": [0.0] * 10, "damp": 1e-3, "still": 0, "rounds": 0, "done": False}


def _padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), size.max()))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out, size


# ---------------------------------------------------------------- Spark

_STATE = "theta array<double>, trial array<double>, ll double, sums array<double>, damp double, still int, rounds int, done boolean"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _state_columns(states: list[dict]) -> list[pa.Array]:
    kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
    return [pa.array([np.asarray(s[n]).tolist() for s in states], k) for n, k in zip(_STATE_NAMES, kinds, strict=True)]


def garch_fit(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", most: int = 200, tol: float = 1e-12, block: int = 256, whole: int = 100_000) -> DataFrame:
    """By, n, variance, omega, alpha, beta, log_likelihood (without its constant), rounds; of keys with at least 20 trades and some spread."""
    rows = trades.where(F.col("r_multiple").isNotNull()).select(by, time, F.col("r_multiple").cast("double").alias("r"))
    scale = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("r").alias("_mean"), F.var_pop("r").alias("variance")).where("n >= 20 AND variance > 1e-12")
    rows = positions(rows.join(scale, by), [by], time, ("r",)).withColumn("_b", F.floor((F.col("no") - 1) / block).cast("int"))
    squares = F.transform(F.sort_array(F.collect_list(F.struct("no", F.pow(F.col("r") - F.col("_mean"), 2).alias("x")))), lambda v: v["x"])
    kind = dict(trades.dtypes)[by]
    blocks = rows.groupBy(by, "_b").agg(squares.alias("_x"), F.first("n").alias("n"), F.first("variance").alias("variance"))

    def short(group: pa.Table) -> pa.Table:
        group = group.sort_by("_b")
        e2, size = _padded([np.asarray(v.values) for v in group["_x"].combine_chunks()])
        variance = group["variance"][0].as_py()
        state = first_state(variance)
        while not state["done"] and state["rounds"] < most:
            theta = np.tile(state["trial"], (len(e2), 1))
            state = search_step(state, block_sums(e2, size, theta, incoming(block_maps(e2, size, theta), variance)).sum(0), tol)
        return pa.table([group[by].slice(0, 1).combine_chunks(), *_state_columns([state])], [by, *_STATE_NAMES])

    scale = cut(scale.select(by, "n", "variance"))
    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes hold much work
    done = blocks.where(F.col("n") <= whole).repartition(tasks, by).groupBy(by).applyInArrow(short, f"`{by}` {kind}, {_STATE}")
    if not scale.where(F.col("n") > whole).isEmpty():
        done = done.union(_garch_long(blocks.where(F.col("n") > whole), scale.where(F.col("n") > whole), by, block, most, tol))
    theta = [F.col("theta")[i].alias(c) for i, c in enumerate(("omega", "alpha", "beta"))]
    return scale.join(done.select(by, *theta, F.col("ll").alias("log_likelihood"), "rounds"), by)


def _garch_long(blocks: DataFrame, scale: DataFrame, by: str, block: int, most: int, tol: float) -> DataFrame:
    """The same search, each round one pass over stretches of the series that bring the REACH trades before them along, so none waits for another.

    The driver holds a search's state (some twenty numbers) for each key, and keys are at least `whole` trades long."""
    spark, keys = blocks.sparkSession, scale.collect()
    names = spark.createDataFrame([(r[by], i) for i, r in enumerate(keys)], StructType([scale.schema[by], StructField("_key", IntegerType())]))
    size, reach = max(1, STRETCH // block), -(-REACH // block)
    rows = blocks.select(by, "_b", "_x").join(F.broadcast(names), by).withColumn("_c", F.floor(F.col("_b") / size).cast("int"))
    ahead = rows.withColumn("_ahead", F.explode(F.sequence(F.lit(0), F.lit(-(-reach // size))))).withColumn("_c", F.col("_c") + F.col("_ahead"))
    ahead = ahead.where(F.col("_b") >= F.col("_c") * size - reach)
    ahead = ahead.join(F.broadcast(spark.createDataFrame([(i, (r["n"] - 1) // block // size) for i, r in enumerate(keys)], "_key int, _last int")), "_key").where("_c <= _last")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in keys) // (8 * STRETCH))  # given, as few bytes hold much work
    stretches = ahead.repartition(tasks, "_key", "_c").groupBy("_key", "_c").agg(F.sort_array(F.collect_list(F.struct("_b", "_x"))).alias("_rows"))
    stretches = cut(stretches.select("_key", (F.least(F.lit(reach), F.col("_c") * size)).alias("_before"), F.transform("_rows", lambda v: v["_x"]).alias("_xs")))
    variance = [r["variance"] for r in keys]

    def round_sums(live: dict[int, list[float]]) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, before, xs in zip(batch.column("_key").to_pylist(), batch.column("_before").to_pylist(), batch.column("_xs"), strict=True):
                    e2, n = _padded([np.asarray(v.values) for v in xs])
                    theta = np.tile(live[key], (len(e2), 1))
                    begin = incoming(block_maps(e2, n, theta), variance[key])
                    total[key] = total.get(key, 0.0) + block_sums(e2[before:], n[before:], theta[before:], begin[before:]).sum(0)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array(v) for v in np.stack(list(total.values())).T]], ["_key", *[f"_{i}" for i in range(10)]])

        parts = stretches.where(F.col("_key").isin(list(live))).mapInArrow(run, "_key int, " + ", ".join(f"_{i} double" for i in range(10)))
        return {r["_key"]: np.array(r[1:]) for r in parts.groupBy("_key").agg(*[F.sum(f"_{i}") for i in range(10)]).collect()}

    states = [first_state(v) for v in variance]
    for _ in range(most):
        live = {i: s["trial"] for i, s in enumerate(states) if not s["done"]}
        if not live:
            break
        for i, found in round_sums(live).items():
            states[i] = search_step(states[i], found, tol)
    fields = StructType([scale.schema[by], *StructType.fromDDL(_STATE).fields])
    return spark.createDataFrame([(r[by], *[_plain(s[n]) for n in _STATE_NAMES]) for r, s in zip(keys, states, strict=True)], fields)


def _plain(x):
    return np.asarray(x).tolist()


def squared_autocorrelation(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", lags: int = 10) -> DataFrame:
    """Per key the Ljung-Box sum of squared deviations up to min(lags, n // 5) lags (one at least), its p-value, and the first autocorrelation."""
    rows = trades.where(F.col("r_multiple").isNotNull()).select(by, time, F.col("r_multiple").alias("r"))
    means = rows.groupBy(by).agg(F.avg("r").alias("_mean"), F.var_pop("r").alias("_v"), F.count("*").alias("n"))
    df = positions(rows.join(means, by).withColumn("x", F.pow(F.col("r") - F.col("_mean"), 2) - F.col("_v")), [by], time, ("r",))
    w = Window.partitionBy(by, "_block").orderBy("no")
    df = in_blocks(df, [by], lags).select(by, "n", "x", "_halo", *[F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)]).where("NOT _halo")
    sums = df.groupBy(by, "n").agg(F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    m = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.col("n") / 5)))
    rho = [F.when(F.col("v") < 1e-15, 0.0).otherwise(F.coalesce(ratio(F.col(f"c{k}"), F.col("v")), F.lit(0.0))) for k in range(1, lags + 1)]
    total = sum((F.when(F.lit(k) <= m, F.pow(r, 2) / F.nullif(F.col("n") - k, F.lit(0))).otherwise(0.0) for k, r in enumerate(rho, 1)), F.lit(0.0))
    q = F.col("n") * (F.col("n") + 2) * F.coalesce(total, F.lit(0.0))
    return sums.select(by, "n", q.alias("ljung_box"), chi2_sf(q, m).alias("ljung_box_p"), rho[0].alias("sq_autocorr_lag1"))


def clustering(trades: DataFrame, **options) -> DataFrame:
    """W41 as reported: the model of keys whose persistence is below 1, the Ljung-Box test of the squares, and whether volatility clusters."""
    by = options.get("by", "strategy")
    order = {k: v for k, v in options.items() if k in ("by", "time")}
    fit, test = garch_fit(trades, **options), squared_autocorrelation(trades, **order)
    stays = F.col("alpha") + F.col("beta")
    good = F.coalesce(stays < 1, F.lit(False))
    df = test.join(fit.drop("n"), by, "left").withColumn("converged", good)
    shown = [rounded(F.when(good, v), digits).alias(name) for name, v, digits in (("omega", F.col("omega"), 6), ("alpha", F.col("alpha"), 4), ("beta", F.col("beta"), 4), ("persistence", stays, 4))]
    return df.select(by, "n", *shown, "converged", rounded(F.col("ljung_box")).alias("ljung_box"), rounded(F.col("ljung_box_p"), 6).alias("ljung_box_p"),
        rounded(F.col("sq_autocorr_lag1")).alias("sq_autocorr_lag1"), (good & F.coalesce(stays > 0.5, F.lit(False)) | (F.col("ljung_box_p") < 0.05)).alias("has_clustering"))


# ---------------------------------------------------------------- heavy tails


def hill_plot(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-15: Hill's estimate for each number k of largest |R| from 5 % (5 at least) to 30 % of a key's nonzero results."""
    rows = trades.where(F.abs("r_multiple") > 1e-12).select(by, (-F.abs("r_multiple")).alias("_down"), F.ln(F.abs("r_multiple")).alias("_log"))
    n = rows.groupBy(by).agg(F.count("*").alias("n")).where("n >= 10")
    low = F.greatest(F.lit(5), F.floor(0.05 * F.col("n")))
    df = ranked(rows, [by], "_down", {"_log": "_upto"}).join(n, by)
    k = F.col("no") - 1
    return df.where((k >= low) & (k <= F.greatest(F.floor(0.30 * F.col("n")), low + 1)) & (k < F.col("n"))).select(by, "n", k.cast("long").alias("k"),
        (F.try_divide(F.col("_upto") - F.col("_log"), k) - F.col("_log")).alias("hill")).where("hill > 1e-12")


def tail_index(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-15: the median of Hill's estimates, the tail's exponent and whether its variance is finite."""
    df = hill_plot(trades, by=by).groupBy(by).agg(F.count("*").alias("points"), F.percentile("hill", F.lit(0.5)).alias("h"))
    return df.select(by, "points", rounded(F.col("h")).alias("tail_index"), rounded(1 / F.col("h")).alias("tail_exponent"), (1 / F.col("h") > 2).alias("finite_variance"))


def value_at_risk(trades: DataFrame, *, by: str = "strategy", confidence: float = 0.95) -> DataFrame:
    """T-15: normal, historical and Cornish-Fisher value at risk, the mean beyond the historical one, the most cautious of them, and how far the normal one falls short."""
    from statistics import NormalDist

    z, r = NormalDist().inv_cdf(1 - confidence), F.col("r_multiple")
    m = trades.groupBy(by).agg(F.avg(r).alias("mu"), F.greatest(F.coalesce(F.stddev_samp(r), F.lit(0.0)), F.lit(1e-12)).alias("sd"), F.var_pop(r).alias("v"), F.skewness(r).alias("g"),
        F.kurtosis(r).alias("k"), F.percentile(r, F.lit(1 - confidence)).alias("hist"))
    s = F.coalesce(F.col("g") * F.pow("v", F.lit(1.5)), F.lit(0.0)) / F.pow("sd", F.lit(3.0))
    k = F.coalesce((F.col("k") + 3) * F.pow("v", F.lit(2.0)), F.lit(0.0)) / F.pow("sd", F.lit(4.0)) - 3
    cf = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    m = m.withColumn("normal", F.col("mu") + z * F.col("sd")).withColumn("cf", F.col("mu") + cf * F.col("sd"))
    tail = trades.join(m.select(by, "hist"), by).where(r <= F.col("hist")).groupBy(by).agg(F.avg(r).alias("cvar"))
    names = {"normal": F.col("normal"), "historical": F.col("hist"), "cornish_fisher": F.col("cf")}
    worst = F.least(*names.values())
    chosen = F.coalesce(*[F.when(v == worst, F.lit(n)) for n, v in names.items()])
    under = F.when(F.abs("hist") > 1e-12, 100 * (F.col("normal") - F.col("hist")) / F.abs(F.when(F.abs("hist") > 1e-12, F.col("hist")))).otherwise(0.0)
    return m.join(tail, by).select(by, *[rounded(v).alias(f"{n}_var") for n, v in names.items()], rounded(F.col("cvar")).alias("cvar"), chosen.alias("most_conservative"),
        rounded(under, 2).alias("normal_underestimate_pct"))


def quantile_pairs(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-15: each result, standardised, beside the standard normal quantile of its place."""
    rows = trades.where(F.col("r_multiple").isNotNull()).select(by, "r_multiple")
    m = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("r_multiple").alias("mu"), F.stddev_samp("r_multiple").alias("sd"))
    df = ranked(rows, [by], "r_multiple").join(m, by)
    sd: Column = F.when(F.col("sd") >= 1e-12, F.col("sd")).otherwise(1.0)
    return df.select(by, "no", rounded(normal_quantile((F.col("no") - 0.5) / F.col("n"))).alias("theoretical"), rounded((F.col("r_multiple") - F.col("mu")) / sd).alias("empirical"))
