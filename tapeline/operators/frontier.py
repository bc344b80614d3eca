"""Long-only portfolios by mean and variance.

Daily returns go to rows of a day each; tasks add up outer products of their days, and only sums of labels x labels leave them.  The covariance is shrunk towards a
multiple of the identity (Ledoit and Wolf's weight, from the same sums and the fourth powers of the days' lengths).  Weights come from a quadratic program with an
active set, on the one row that is left.

Defined results: days without a row of a label count as 0 for it; where no label has a positive mean the largest Sharpe ratio is no program with a solution, and weights are
equal; a target outside of what the labels' means span gives equal weights too; weights below 0.001 become 0 and the rest is scaled to 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut

RIDGE, SMALL = 1e-6, 0.001


def quadratic_program(cov: np.ndarray, c: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The x that makes x'cov x / 2 - c'x least, where x >= 0 and a x stays as it is at the start; cov must be positive definite.

    Steps go to the least point of the face that is free, or as far as the first bound; at a face's least point the bound that pulls most is let go."""
    x, free, m = x.copy(), x > 0, len(a)
    for _ in range(50 * (len(x) + 1)):
        g = cov @ x - c
        on = np.flatnonzero(free)
        kkt = np.block([[cov[np.ix_(on, on)], a[:, on].T], [a[:, on], np.zeros((m, m))]])
        solved = np.linalg.lstsq(kkt, np.concatenate([-g[on], np.zeros(m)]), rcond=None)[0]
        step = np.zeros(len(x))
        step[on] = solved[: len(on)]
        if np.abs(step).max(initial=0.0) <= 1e-12 * max(1.0, np.abs(x).max()):
            pull = g + a.T @ solved[len(on) :] if m else g
            pull = np.where(free, 0.0, pull)
            if pull.min(initial=0.0) >= -1e-12 * max(1.0, np.abs(g).max()):
                break
            free[int(np.argmin(pull))] = True
            continue
        down = np.flatnonzero(free & (step < 0))
        room = -x[down] / step[down]
        if len(down) and room.min() < 1:
            x = x + room.min() * step
            gone = down[int(np.argmin(room))]
            x[gone], free[gone] = 0.0, False
        else:
            x = x + step
    return np.maximum(x, 0.0)


def shrunk(outer: np.ndarray, fourth: float, n: int) -> tuple[np.ndarray, float]:
    """Covariance and its shrinkage from the sums of the centred days' outer products and of the fourth powers of their lengths."""
    p, cov = len(outer), outer / n
    mean, spread = np.trace(cov) / p, (cov**2).sum()
    away = (spread - p * mean**2) / p
    noise = min((fourth / n - spread) / (n * p), away)
    weight = noise / away if away > 0 else 0.0
    return (1 - weight) * cov + weight * mean * np.eye(p), weight


def weights_of(mu: np.ndarray, cov: np.ndarray, target: float | None) -> np.ndarray:
    n = len(mu)
    cov = cov + RIDGE * np.eye(n)
    equal = np.full(n, 1 / n)
    if target is None:
        if mu.max() <= 0:
            return equal
        scale = np.abs(mu).max()
        x = quadratic_program(cov / np.trace(cov), mu / scale, np.zeros((0, n)), np.zeros(n))
    else:
        low, high = int(mu.argmin()), int(mu.argmax())
        if not mu[low] <= target <= mu[high]:
            return equal
        x = np.zeros(n)
        share = (target - mu[low]) / (mu[high] - mu[low]) if mu[high] > mu[low] else 1.0
        x[low], x[high] = x[low] + 1 - share, x[high] + share
        x = quadratic_program(cov / np.trace(cov), np.zeros(n), np.stack([np.ones(n), mu]), x)
    x = x / x.sum()
    x = np.where(x < SMALL, 0.0, x)
    return x / x.sum()


def moments(daily: DataFrame, by: str = "strategy") -> tuple[DataFrame, DataFrame]:
    """labels (by, place, mean, days) and one row of sums over all days: n, outer (labels x labels, of centred days), fourth."""
    labels = daily.select(by).distinct()
    days = daily.select("day").distinct().count()
    mean = daily.groupBy(by).agg((F.sum("r") / F.lit(max(1, days))).alias("mean"))
    names = [r[0] for r in labels.orderBy(by).collect()]  # the labels are the size of the result
    place = daily.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"`{by}` {dict(daily.dtypes)[by]}, place int")
    labels = cut(mean.join(place, by))
    size, centre = len(names), None
    rows = labels.select("place", "mean").orderBy("place").collect()
    centre = np.array([r["mean"] for r in rows])
    wide = daily.join(F.broadcast(place), by).groupBy("day").agg(F.collect_list(F.struct("place", "r")).alias("v"))  # a row per label, no more than the result has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, outer, fourth = 0, np.zeros((size, size)), 0.0
        for batch in batches:
            lists = batch.column(0)
            x = np.zeros((batch.num_rows, size))
            at = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            np.add.at(x, (at, np.asarray(flat.field("place"))), np.asarray(flat.field("r")))
            x -= centre
            n, outer, fourth = n + len(x), outer + x.T @ x, fourth + ((x**2).sum(1) ** 2).sum()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([outer.ravel()]), pa.array([fourth])], ["n", "outer", "fourth"])

    parts = wide.select("v").mapInArrow(run, "n long, outer array<double>, fourth double")
    total = parts.select("n", "fourth", F.posexplode("outer").alias("i", "o")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("fourth").alias("fourth"), F.sum("o").alias("o"))
    return labels, total.agg(F.first("n").alias("n"), F.first("fourth").alias("fourth"), F.sort_array(F.collect_list(F.struct("i", "o"))).alias("outer"))


def mean_variance(daily: DataFrame, *, by: str = "strategy", target: float | None = None) -> DataFrame:
    """T-7: weight of each label for the largest Sharpe ratio, or for the least variance at a mean of `target` a day; with its mean, deviation and the shrinkage."""
    labels, total = moments(daily, by)
    rows = labels.orderBy("place").agg(F.sort_array(F.collect_list(F.struct("place", by, "mean"))).alias("labels"))
    kind = dict(daily.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mu = np.array([x["mean"] for x in row["labels"]])
                if not len(mu):
                    continue
                outer = np.array([x["o"] for x in row["outer"]]).reshape(len(mu), len(mu))
                cov, weight = shrunk(outer, row["fourth"], row["n"])
                w = weights_of(mu, cov, target)
                names = batch.column("labels")[0].values.field(by)
                yield pa.RecordBatch.from_arrays([names, pa.array(w), pa.array(mu), pa.array(np.sqrt(np.diag(cov))), pa.array([weight] * len(mu))], [by, "weight", "mean", "deviation", "shrinkage"])

    return rows.join(total).mapInArrow(run, f"`{by}` {kind}, weight double, mean double, deviation double, shrinkage double")  # one row each
