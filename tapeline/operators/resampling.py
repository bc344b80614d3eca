"""Resampled equity paths, where the order of draws counts, and paths of compounded capital.

A path of n draws is cut into segments of steps.  A segment's blocks of trades are drawn by a generator of its own, seeded by (seed, key, segment), for all paths at once,
so results do not depend on partitions, and any task can make any segment again.  What a segment does to a path (sum, highest and lowest place, deepest fall, and sums for
the other statistics) composes along the path, path by path; bands are taken step by step once the places where segments begin are known.  A task holds one
key's R values (eight bytes a trade) and one segment of all paths; segments of a share are composed as they are drawn, so only `tasks` rows a key are shuffled.

Defined results: rows without an R take no part; keys with fewer than `least` trades have no paths; ties in time are ordered by R; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio, rounded
from ..functions.storage import cut

_SUMS = ("s", "top", "low", "fall", "q", "wins", "gain")
_PATHS = 500  # paths that are composed in one group
_DIGITS = 9  # of results: the order of sums, which follows the shares, shows only beyond


def _drawn(r: np.ndarray, seed: int, segment: int, steps: int, size: int, rounds: int) -> np.ndarray:
    """The R values of a segment of all paths: blocks of `size` trades in a row from random places."""
    rng = np.random.Generator(np.random.SFC64([seed & (1 << 64) - 1, segment]))
    blocks = -(-steps // size)
    starts = rng.integers(0, max(1, len(r) - size + 1), (rounds, blocks))
    at = (starts[:, :, None] + np.arange(size)).reshape(rounds, -1)[:, :steps]
    return r[np.minimum(at, len(r) - 1)]


def _work(trades: DataFrame, by: str, time: str, seed: int, steps: int, tasks: int, least: int) -> DataFrame:
    """A row per (key, share of its segments): by, n, rs, seed, first and last segment."""
    rows = trades.where(F.col("r_multiple").isNotNull()).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(time, "r_multiple"))), lambda x: x["r_multiple"].cast("double")).alias("rs"))
    rows = rows.where(F.size("rs") >= least).select(by, F.size("rs").alias("n"), "rs", F.xxhash64(F.lit(seed), by).alias("seed"))
    count = F.ceil(F.col("n") / steps).cast("int")
    shares = F.least(F.lit(tasks), count)
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    first = lambda i: F.floor(i * count / shares).cast("int")
    rows = rows.select(by, "n", "rs", "seed", "share", first(F.col("share")).alias("first"), (first(F.col("share") + 1) - 1).alias("last"))
    return rows.repartition(by, "share")


def _after(a: dict | None, b: dict) -> dict:
    """What two stretches in a row do to each path, as one."""
    if a is None:
        return b
    fall = np.maximum(np.maximum(a["fall"], b["fall"]), a["top"] - (a["s"] + b["low"]))
    return {"s": a["s"] + b["s"], "top": np.maximum(a["top"], a["s"] + b["top"]), "low": np.minimum(a["low"], a["s"] + b["low"]), "fall": fall, **{c: a[c] + b[c] for c in ("q", "wins", "gain")}}


def _shares(trades: DataFrame, by: str, time: str, *, rounds: int, size: int, seed: int, steps: int, tasks: int, least: int) -> DataFrame:
    """by, n, share, chunk and arrays of what the share's segments, composed as they are drawn, do to each of the chunk's paths. A group is one share, so a task holds one key's values."""
    kind = dict(trades.dtypes)[by]

    def run(row: pa.Table) -> pa.Table:
        row = row.combine_chunks()
        n, h, first, last, share = (row[c][0].as_py() for c in ("n", "seed", "first", "last", "share"))
        r, total = np.asarray(row["rs"][0].values), None
        for segment in range(first, last + 1):
            x = _drawn(r, h, segment, min(steps, n - segment * steps), size, rounds)
            c = np.cumsum(x, 1)
            fall = (np.maximum.accumulate(c, 1) - c).max(1)
            total = _after(total, dict(zip(_SUMS, [c[:, -1], c.max(1), c.min(1), fall, (x * x).sum(1), (x > 0).sum(1).astype(float), np.where(x > 0, x, 0.0).sum(1)], strict=True)))
        cuts = range(0, rounds, _PATHS)
        same = lambda v: pa.array([v] * len(cuts), pa.int32())
        return pa.table([row[by].take(pa.array([0] * len(cuts))), same(n), same(share), pa.array([k // _PATHS for k in cuts], pa.int32()),
            *[pa.array([total[c][k : k + _PATHS] for k in cuts]) for c in _SUMS]], [by, "n", "share", "chunk", *_SUMS])

    work = _work(trades, by, time, seed, steps, tasks, least)
    return work.groupBy(by, "share").applyInArrow(run, f"`{by}` {kind}, n int, share int, chunk int, " + ", ".join(f"{c} array<double>" for c in _SUMS))


def _composed(shares: DataFrame, by: str, starts: bool) -> DataFrame:
    """Per path its statistics; starts: instead, where each share of each path begins (by, share, chunk, begin). A group has a row for each of a key's shares."""
    kind = dict(shares.dtypes)[by]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("share").combine_chunks()
        v = {c: np.stack([np.asarray(x.values) for x in group[c].combine_chunks()]) for c in _SUMS}
        key, chunk, n = group[by].slice(0, 1).combine_chunks(), group["chunk"][0].as_py(), group["n"][0].as_py()
        if starts:
            return pa.table([group[by], group["share"], group["chunk"], pa.array(list(np.cumsum(v["s"], 0) - v["s"]))], [by, "share", "chunk", "begin"])
        total = None
        for i in range(group.num_rows):
            total = _after(total, {c: v[c][i] for c in _SUMS})
        m = len(total["s"])
        return pa.table([key.take(pa.array([0] * m)), pa.array(chunk * _PATHS + np.arange(m, dtype=np.int32), pa.int32()), pa.array([n] * m, pa.int32()), *[pa.array(np.round(total[c], _DIGITS)) for c in ("s", "q", "wins", "gain", "fall")]],
            [by, "path", "n", "s", "q", "wins", "gain", "fall"])

    kinds = f"`{by}` {kind}, share int, chunk int, begin array<double>" if starts else f"`{by}` {kind}, path int, n int, s double, q double, wins double, gain double, fall double"
    return shares.groupBy(by, "chunk").applyInArrow(run, kinds)


def resampled_paths(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", rounds: int = 10_000, size: int = 1, seed: int = 42, steps: int = 256, tasks: int = 32, least: int = 5) -> DataFrame:
    """T-2: per path its final R, mean R, win rate, expectancy, profit factor, Sharpe ratio and deepest fall; blocks of `size` trades keep their order."""
    steps = -(-steps // size) * size
    p = _composed(_shares(trades, by, time, rounds=rounds, size=size, seed=seed, steps=steps, tasks=tasks, least=least), by, False)
    n, s, wins, gain = F.col("n").cast("double"), F.col("s"), F.col("wins"), F.col("gain")
    loss, sd = gain - s, F.sqrt(F.greatest(F.col("q") - s * s / n, F.lit(0.0)) / (n - 1))
    rate = wins / n
    expectancy = rate * F.coalesce(ratio(gain, wins), F.lit(0.0)) - (1 - rate) * F.coalesce(ratio(loss, n - wins), F.lit(0.0))
    real = lambda x: x > 1e-9
    return p.select(by, "path", s.alias("final_r"), (s / n).alias("mean_r"), rate.alias("win_rate"), expectancy.alias("expectancy"),
        F.when(real(loss), gain / F.when(real(loss), loss)).otherwise(0.0).alias("profit_factor"), F.when(real(sd), s / n / F.when(real(sd), sd)).otherwise(0.0).alias("sharpe"), F.col("fall").alias("max_drawdown"))


def path_intervals(trades: DataFrame, *, by: str = "strategy", confidence: float = 0.95, **options) -> DataFrame:
    """T-2: intervals of the statistics of resampled paths, and the share of paths with a mean above 0."""
    ends = F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))
    names = ("mean_r", "win_rate", "expectancy", "profit_factor", "sharpe", "max_drawdown")
    p = resampled_paths(trades, by=by, **options).groupBy(by).agg(F.count("*").alias("paths"), F.avg((F.col("mean_r") > 0).cast("double")).alias("p"), *[F.percentile(c, ends).alias(c) for c in names])
    return p.select(by, "paths", rounded(F.col("p")).alias("p_profitable"), *[rounded(F.col(c)[i]).alias(f"{c}_{x}") for c in names for i, x in enumerate(("low", "high"))])


def equity_fan(trades: DataFrame, *, by: str = "strategy", time: str = "entry_time", rounds: int = 10_000, size: int = 1, seed: int = 42, steps: int = 256, tasks: int = 32, least: int = 5,
               bands: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """T-3, V5: percentiles of the resampled equity after each number of trades, exact over all paths."""
    steps = -(-steps // size) * size
    begins = _composed(_shares(trades, by, time, rounds=rounds, size=size, seed=seed, steps=steps, tasks=tasks, least=least), by, True)
    begins = begins.groupBy(by, "share").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "begin"))), lambda x: x["begin"])).alias("begin"))
    # where a share's paths begin goes to the task that has it; there they go on from segment to segment
    work = _work(trades, by, time, seed, steps, tasks, least).join(cut(begins), [by, "share"])
    kind = dict(trades.dtypes)[by]

    def run(row: pa.Table) -> pa.Table:
        row = row.combine_chunks()
        n, h, first, last = (row[c][0].as_py() for c in ("n", "seed", "first", "last"))
        r, begin, found = np.asarray(row["rs"][0].values), np.asarray(row["begin"][0].values), []
        for segment in range(first, last + 1):
            paths = begin[:, None] + np.cumsum(_drawn(r, h, segment, min(steps, n - segment * steps), size, rounds), 1)
            found.append(np.percentile(paths, bands, axis=0))
            begin = paths[:, -1]
        found = np.round(np.concatenate(found, 1), _DIGITS)
        m = found.shape[1]
        return pa.table([row[by].take(pa.array(np.zeros(m, np.int64))), pa.array(first * steps + 1 + np.arange(m, dtype=np.int64)), *[pa.array(v) for v in found]], [by, "trade", *[f"p{b}" for b in bands]])

    return work.groupBy(by, "share").applyInArrow(run, f"`{by}` {kind}, trade long, " + ", ".join(f"p{b} double" for b in bands))


def fan_summary(trades: DataFrame, *, by: str = "strategy", **options) -> DataFrame:
    """T-3: percentiles of the final R and of the deepest fall over the paths of the fan."""
    p = resampled_paths(trades, by=by, **options)
    q = lambda c, x: rounded(F.percentile(c, F.lit(x)))
    return p.groupBy(by).agg(F.count("*").alias("paths"), q("final_r", 0.05).alias("final_p5"), q("final_r", 0.5).alias("final_median"), q("final_r", 0.95).alias("final_p95"),
        q("max_drawdown", 0.5).alias("fall_median"), q("max_drawdown", 0.95).alias("fall_p95"))


# ---------------------------------------------------------------- capital


def capital_paths(trades: DataFrame, *, by: str = "strategy", risk: float = 0.01, ruin: float = 0.10, trades_ahead: int = 1000, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """T-14: per path the capital at the end (1 at the start, each draw times 1 + risk * R) and the first trade after which it lies below `ruin` (null: never).

    Draws are by the counts of a key's distinct R values; paths go to tasks in hundreds, and only ends and first passages come back."""
    kind = dict(trades.dtypes)[by]
    r = trades.where(F.col("r_multiple").isNotNull()).groupBy(by, "r_multiple").agg(F.count("*").alias("k"))
    law = r.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("r_multiple", "k"))).alias("law"))
    work = law.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // _PATHS) - 1)))).withColumn("seed", F.xxhash64(F.lit(seed), by, "chunk")).repartition(by, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("law")[i].values
                growth, upto = 1 + risk * np.asarray(parts.field("r_multiple"), float), np.cumsum(np.asarray(parts.field("k")))
                rng = np.random.Generator(np.random.SFC64(batch.column("seed")[i].as_py() & (1 << 64) - 1))
                m = min(_PATHS, rounds - batch.column("chunk")[i].as_py() * _PATHS)
                now, broke = np.ones(m), np.zeros(m, np.int64)
                for at in range(0, trades_ahead, 100):
                    draws = growth[np.searchsorted(upto, rng.integers(0, upto[-1], (m, min(100, trades_ahead - at))), "right")]
                    path = now[:, None] * np.cumprod(draws, 1)
                    below = path < ruin
                    new = (broke == 0) & below.any(1)
                    broke[new] = at + 1 + below[new].argmax(1)
                    now = path[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array([i] * m)), pa.array(now), pa.array(broke, mask=broke == 0)], [by, "capital", "ruined_at"])

    return work.mapInArrow(run, f"`{by}` {kind}, capital double, ruined_at long")


def ruin_chances(trades: DataFrame, *, by: str = "strategy", start: float = 10_000.0, trades_ahead: int = 1000, **options) -> DataFrame:
    """T-14: chance of ruin in all and within 100, 250 and 500 trades, the median trade at which it comes, and percentiles of the final capital."""
    p = capital_paths(trades, by=by, trades_ahead=trades_ahead, **options)
    hit = F.col("ruined_at")
    chance = lambda c: rounded(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    end = lambda x: rounded(start * F.percentile("capital", F.lit(x)), 2)
    return p.groupBy(by).agg(F.count("*").alias("paths"), chance(hit.isNotNull()).alias("p_ruin"), *[chance(hit <= t).alias(f"p_ruin_{t}") for t in (100, 250, 500) if t <= trades_ahead],
        F.percentile(hit, F.lit(0.5)).alias("median_trades_to_ruin"), end(0.05).alias("capital_p5"), end(0.5).alias("capital_median"), end(0.95).alias("capital_p95"))


def kelly_bounds(trades: DataFrame, *, by: str = "strategy", rounds: int = 5_000, seed: int = 42) -> DataFrame:
    """T-14: the Kelly fraction (win rate less loss rate over the ratio of mean win to mean loss) with intervals over resamples, and what is advised: a quarter of its 5th percentile."""
    from .statistics import _replicates

    def draw(rng, r, k, into):
        w = rng.poisson(k, into.shape[1])
        into[0] += w
        if r:
            at = 1 if r > 0 else 3
            into[at] += w
            into[at + 1] += w * abs(r)

    def fraction(k, wins, gain, losses, loss):
        rate = ratio(wins, k)
        some = (wins > 0) & (losses > 0) & (loss > 1e-12 * losses)
        return F.when(some, rate - (1 - rate) * ratio(ratio(loss, losses), ratio(gain, wins))).otherwise(0.0)

    names = ("k", "wins", "gain", "losses", "loss")
    reps = _replicates(trades, by, rounds, seed, draw, names).where("k > 0").select(by, fraction(*map(F.col, names)).alias("f"))
    r = F.col("r_multiple")
    one = lambda hit: F.sum(F.when(hit, 1).otherwise(0))
    real = trades.where(r.isNotNull()).groupBy(by).agg(F.count("*").alias("k"), one(r > 0).alias("wins"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gain"), one(r < 0).alias("losses"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("loss")).select(by, fraction(*map(F.col, names)).alias("point"))
    shares = (0.025, 0.05, 0.1, 0.9, 0.975)
    q = reps.groupBy(by).agg(F.percentile("f", F.array(*map(F.lit, shares))).alias("q"), F.avg((F.col("f") > 0).cast("double")).alias("up"))
    at = {s: F.col("q")[i] for i, s in enumerate(shares)}
    point = F.col("point")
    return real.join(q, by).select(by, rounded(point, 6).alias("kelly"), rounded(at[0.025], 6).alias("low_95"), rounded(at[0.975], 6).alias("high_95"), rounded(at[0.1], 6).alias("low_80"),
        rounded(at[0.9], 6).alias("high_80"), rounded(at[0.05], 6).alias("conservative"), rounded(point / 2, 6).alias("half_kelly"), rounded(point / 4, 6).alias("quarter_kelly"),
        rounded(F.greatest(F.lit(0.0), at[0.05] / 4), 6).alias("recommended"), rounded(F.col("up")).alias("share_positive"))
