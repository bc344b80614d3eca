"""Hidden Markov regimes by a scan over matrices.

A series is cut into blocks of bars.  What a block does to the state probabilities before it is a K x K matrix, the product of its transitions and
emissions in the log-sum semiring (max-plus for the most likely path).  Blocks are composed by these matrices alone, from the front and from the back,
which gives each block the message that comes in on either side; a second pass then finishes each block on its own.  So a series of any length is worked on
by as many tasks as it has blocks, and one task sees at most K * K numbers of each block of a series.

Fitting (Baum-Welch) repeats the two passes with sums per series between them.  Series of at most `whole` bars are fitted within one task each, by the
same functions; longer ones by rounds of Spark jobs.  Numpy works on many blocks at once, step by step.

Defined results: rows with a null or NaN feature take no part in a fit and count as the mean when they are decoded; a series with fewer than `least` usable rows
has no model and no decoded rows; order must be unique within a series (ties are broken by the features); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..functions.storage import cut
from .ordering import positions

STICKY = 0.9  # chance to stay at the start of a fit
TINY = 1e-300
_MODEL = ("mu", "sigma", "trans", "start")


# ---------------------------------------------------------------- blocks in numpy: n blocks, t steps, k states, d features


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def _emission(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Log densities (n, t, k)."""
    var = np.maximum(sigma**2, 1e-12)[:, None]
    return -0.5 * (np.log(2 * np.pi * var) + (x[:, :, None] - mu[:, None]) ** 2 / var).sum(-1)


class Blocks:
    """Blocks padded to one length, each with its model."""

    def __init__(self, no: np.ndarray, xs: list[np.ndarray], model: dict[str, np.ndarray]):
        self.size = np.array([len(x) for x in xs])
        self.x = np.zeros((len(xs), self.size.max(), xs[0].shape[1]))
        for i, x in enumerate(xs):
            self.x[i, : len(x)] = x
        self.first = no == 0
        self.set(model)

    def set(self, model: dict[str, np.ndarray]) -> None:
        self.b = _emission(self.x, model["mu"], model["sigma"])
        self.trans, self.start = np.log(model["trans"] + TINY), np.log(model["start"] + TINY)

    def step(self, t: int) -> np.ndarray:
        """Log transition and emission of step t; the first step of a series forgets where it came from."""
        a = np.where((self.first & (t == 0))[:, None, None], self.start[:, None], self.trans)
        return a + self.b[:, t, None]

    def on(self, t: int, new: np.ndarray, old: np.ndarray) -> np.ndarray:
        return np.where((t < self.size).reshape(-1, *[1] * (new.ndim - 1)), new, old)

    def matrices(self, best: bool = False) -> np.ndarray:
        """Each block's product; best: in the max-plus semiring."""
        n, _, k = self.b.shape
        out = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, -np.inf), (n, k, k)).copy()
        for t in range(self.x.shape[1]):
            both = out[:, :, :, None] + self.step(t)[:, None]
            out = self.on(t, both.max(2) if best else _lse(both, 2), out)
        return out

    def forward(self, before: np.ndarray) -> np.ndarray:
        """Normalised log filtered probabilities (n, t, k)."""
        out, now = np.zeros_like(self.b), before
        for t in range(self.x.shape[1]):
            new = _lse(now[:, :, None] + self.step(t), 1)
            now = self.on(t, new - _lse(new, 1)[:, None], now)
            out[:, t] = now
        return out

    def backward(self, after: np.ndarray) -> np.ndarray:
        """Log backward messages, up to a constant a step."""
        out, now = np.zeros_like(self.b), after
        for t in range(self.x.shape[1] - 1, -1, -1):
            now = self.on(t, now, after)
            out[:, t] = now
            new = _lse(self.step(t) + now[:, None], 2)
            now = self.on(t, new - new.max(1, keepdims=True), after)
        return out

    def sums(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Per block the expected counts that a new model is made of: states, their x and x^2, transitions, the first state."""
        f, g = self.forward(before), self.backward(after)
        n, t, k = f.shape
        live = (np.arange(t) < self.size[:, None])[:, :, None]
        gamma = f + g
        gamma = np.where(live, np.exp(gamma - _lse(gamma, 2)[:, :, None]), 0.0)
        moves = np.zeros((n, k, k))
        for s in range(t):
            xi = (f[:, s - 1] if s else before)[:, :, None] + self.trans + (self.b[:, s] + g[:, s])[:, None]
            xi = np.exp(xi - _lse(xi.reshape(n, -1), 1)[:, None, None])
            moves += np.where((self.first & (s == 0) | (s >= self.size))[:, None, None], 0.0, xi)
        x = np.einsum("ntk,ntd->nkd", gamma, self.x), np.einsum("ntk,ntd->nkd", gamma, self.x**2)
        begin = np.where(self.first[:, None], gamma[:, 0], 0.0)
        return np.concatenate([gamma.sum(1), *(v.reshape(n, -1) for v in (*x, moves)), begin], 1)

    def best_steps(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the best path to each state at each step comes from (n, t, k), and scores at the end."""
        now, back = before, np.tile(np.arange(self.b.shape[2]), (*self.b.shape[:2], 1))
        for t in range(self.x.shape[1]):
            both = now[:, :, None] + self.step(t)
            back[:, t] = self.on(t, both.argmax(1), back[:, t])
            now = self.on(t, both.max(1), now)
        return back, now

    def labels(self, back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States along the best path that ends in `last`, and the state before the block."""
        out, now, rows = np.zeros(back.shape[:2], int), last, np.arange(len(back))
        for t in range(back.shape[1] - 1, -1, -1):
            out[:, t] = now
            now = self.on(t, back[rows, t, now], now)
        return out, now


def messages(mats: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a series' block matrices in order: what comes into each block from the front and from the back, normalised, and the log likelihood."""
    k, total = mats.shape[1], 0.0
    front, back = np.full(mats.shape[:2], -np.inf), np.zeros(mats.shape[:2])
    now = np.where(np.arange(k) == 0, 0.0, -np.inf)
    for i, m in enumerate(mats):
        front[i] = now
        new = _lse(now[:, None] + m, 0)
        scale = _lse(new[None], 1)[0]
        now, total = new - scale, total + scale
    for i in range(len(mats) - 2, -1, -1):
        new = _lse(mats[i + 1] + back[i + 1][None], 1)
        back[i] = new - new.max()
    return front, back, float(total)


def next_model(sums: np.ndarray, model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model that a series' expected counts ask for."""
    k, d = model["mu"].shape
    g, x, xx, moves, begin = np.split(sums, np.cumsum([k, k * d, k * d, k * k]))
    x, xx, moves = x.reshape(k, d), xx.reshape(k, d), moves.reshape(k, k)
    out = {n: v.copy() for n, v in model.items()}
    start = np.clip(begin / begin.sum(), 1e-6, 1.0)
    out["start"] = start / start.sum()
    left = moves.sum(1)
    for i in range(k):
        if left[i] > 1e-12:
            out["trans"][i] = moves[i] / left[i]
        row = np.clip(out["trans"][i], 1e-6, 1.0)
        out["trans"][i] = row / row.sum()
        if g[i] > 1e-12:
            out["mu"][i] = x[i] / g[i]
            out["sigma"][i] = np.maximum(np.sqrt(np.maximum(xx[i] / g[i] - out["mu"][i] ** 2, 0.0)), 1e-6)
    return out


def fit_whole(xs: list[np.ndarray], model: dict[str, np.ndarray], most: int, tol: float) -> tuple[dict[str, np.ndarray], float, int]:
    """A series' model, log likelihood and rounds, within one task."""
    wide = lambda m: {n: np.broadcast_to(v, (len(xs), *v.shape)) for n, v in m.items()}
    blocks, before, ll, round_ = Blocks(np.arange(len(xs)), xs, wide(model)), -np.inf, -np.inf, 0
    for round_ in range(1, most + 1):
        front, back, ll = messages(blocks.matrices())
        if abs(ll - before) < tol and round_ > 1:
            break
        before, model = ll, next_model(blocks.sums(front, back).sum(0), model)
        blocks.set(wide(model))
    return model, ll, round_


# ---------------------------------------------------------------- Spark


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values) for v in column]


def _shaped(batch: pa.RecordBatch, rows: int, k: int, d: int) -> dict[str, np.ndarray]:
    shapes = {"mu": (k, d), "sigma": (k, d), "trans": (k, k), "start": (k,)}
    return {n: np.stack(_arrays(batch.column(n))).reshape(rows, *s) for n, s in shapes.items()}


def _each(batches: Iterator[pa.RecordBatch], k: int, d: int, at_once: int = 128) -> Iterator[tuple[pa.RecordBatch, Blocks]]:
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            some = batch.slice(i, at_once)
            yield some, Blocks(np.asarray(some.column("_b")), [x.reshape(-1, d) for x in _arrays(some.column("_x"))], _shaped(some, some.num_rows, k, d))


def _lists(values: np.ndarray, size: int) -> pa.Array:
    flat = np.ascontiguousarray(values, float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _blocks(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """by, _b, _x: features of `block` rows of a series side by side, by _no (from 0)."""
    rows = rows.withColumn("_b", F.floor(F.col("_no") / block).cast("int"))
    return rows.groupBy(*by, "_b").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_f"))), lambda r: r["_f"])).alias("_x"))


def _usable(df: DataFrame, features: list[str]) -> Column:
    hit = F.lit(True)
    for f in features:
        hit = hit & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return hit


def fit_regimes(df: DataFrame, *, by: list[str], order: str, features: list[str], states: int = 2, most: int = 100, tol: float = 1e-4, least: int = 50, block: int = 256,
                whole: int = 100_000) -> DataFrame:
    """Per series mean, std (of the features), mu, sigma, trans, start (of the standardised ones; state 0 has the smallest mean of the second feature,
    or of the only one), n, log_likelihood and rounds."""
    k, d = states, len(features)
    rows = df.where(_usable(df, features)).select(*by, order, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    scale = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"_f{i}").alias(f"_m{i}") for i in range(d)], *[F.stddev_pop(f"_f{i}").alias(f"_s{i}") for i in range(d)],
        F.percentile("_f0", F.array(*[F.lit(j / k) for j in range(1, k)])).alias("_cuts"))
    scale = cut(scale.where(F.col("n") >= least).withColumns({f"_s{i}": F.greatest(F.col(f"_s{i}"), F.lit(1e-8)) for i in range(d)}))
    rows = rows.join(scale, by)
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_f0")))
    z = [((F.col(f"_f{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(f"_z{i}") for i in range(d)]
    rows = positions(rows, by, order, tuple(f"_f{i}" for i in range(d)), name="_no").select(*by, part.alias("_part"), (F.col("_no") - 1).alias("_no"), *z)
    rows = rows.select(*by, "_part", "_no", F.array(*[f"_z{i}" for i in range(d)]).alias("_f"))
    # a first model: the states are the parts of the first feature between its quantiles
    parts = [F.col("_part") == j for j in range(k)]
    value = lambda i: F.col("_f")[i]
    some = [F.count(F.when(p, 1)) > 0 for p in parts]
    mu = [F.when(some[j], F.avg(F.when(parts[j], value(i)))).otherwise(F.avg(value(i)) + 0.2 * (j - (k - 1) / 2)) for j in range(k) for i in range(d)]
    sigma = [F.greatest(F.lit(1e-6), F.when(some[j], F.stddev_pop(F.when(parts[j], value(i)))).otherwise(F.stddev_pop(value(i)))) for j in range(k) for i in range(d)]
    stay = [F.lit(STICKY if i == j else (1 - STICKY) / max(1, k - 1)) if k > 1 else F.lit(1.0) for i in range(k) for j in range(k)]
    first = rows.groupBy(*by).agg(F.array(*mu).alias("mu"), F.array(*sigma).alias("sigma")).withColumns({"trans": F.array(*stay), "start": F.array(*[F.lit(1.0 / k)] * k)})
    first = cut(first.join(scale.select(*by, "n"), by))
    blocks = _blocks(rows, by, block)
    short = first.where(F.col("n") <= whole)
    done = _fit_short(blocks.join(short, by), by, k, d, most, tol)
    if not first.where(F.col("n") > whole).isEmpty():
        long = first.where(F.col("n") > whole)
        done = done.union(_fit_long(cut(blocks.join(long.select(*by), by)), long, by, k, d, most, tol))
    sorted_ = _relabelled(done, by, k, d)
    stats = scale.select(*by, "n", F.array(*[f"_m{i}" for i in range(d)]).alias("mean"), F.array(*[f"_s{i}" for i in range(d)]).alias("std"))
    return stats.join(sorted_, by)


_FITTED = "mu array<double>, sigma array<double>, trans array<double>, start array<double>, log_likelihood double, rounds int"


def _fit_short(blocks: DataFrame, by: list[str], k: int, d: int, most: int, tol: float) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_b").combine_chunks()
        model = {n: v[0] for n, v in _shaped(group.slice(0, 1).to_batches()[0], 1, k, d).items()}
        model, ll, rounds = fit_whole([x.reshape(-1, d) for b in group.to_batches() for x in _arrays(b.column("_x"))], model, most, tol)
        columns = [group.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.table([*columns, *[_lists(model[n], model[n].size) for n in _MODEL], pa.array([ll]), pa.array([rounds], pa.int32())], [*by, *_MODEL, "log_likelihood", "rounds"])

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes hold much work
    return blocks.repartition(tasks, *by).groupBy(*by).applyInArrow(run, f"{_kinds(blocks, by)}, {_FITTED}")


def _messages(blocks: DataFrame, models: DataFrame, by: list[str], k: int, d: int, best: bool = False) -> DataFrame:
    """by, _b, _front, _back, _ll: what comes into each block; best: scores in the max-plus semiring."""
    joined = blocks.join(models.select(*by, *_MODEL), by)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, work in _each(batches, k, d):
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in (*by, "_b")], _lists(work.matrices(best), k * k)], [*by, "_b", "_m"])

    def composed(group: pa.Table) -> pa.Table:
        group = group.sort_by("_b")
        mats = np.concatenate([np.asarray(c.values) for c in group["_m"].chunks]).reshape(-1, k, k)
        if best:
            front, now = np.zeros((len(mats), k)), np.where(np.arange(k) == 0, 0.0, -np.inf)
            for i, m in enumerate(mats):
                front[i] = now
                now = (now[:, None] + m).max(0)
                now = now - now.max()
            back, ll = np.broadcast_to(now, front.shape), 0.0
        else:
            front, back, ll = messages(mats)
        return pa.table([*[group[c] for c in (*by, "_b")], _lists(front, k), _lists(back, k), pa.array(np.full(len(mats), ll))], [*by, "_b", "_front", "_back", "_ll"])

    mats = joined.mapInArrow(products, f"{_kinds(blocks, by)}, _b int, _m array<double>")
    return mats.groupBy(*by).applyInArrow(composed, f"{_kinds(blocks, by)}, _b int, _front array<double>, _back array<double>, _ll double")


def _fit_long(blocks: DataFrame, models: DataFrame, by: list[str], k: int, d: int, most: int, tol: float) -> DataFrame:
    """Baum-Welch by rounds of jobs: each round's sums per series make one row of the next model."""
    size = 2 * k + 2 * k * d + k * k

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, work in _each(batches, k, d):
            found = work.sums(np.stack(_arrays(some.column("_front"))), np.stack(_arrays(some.column("_back"))))
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in (*by, "_ll")], *[pa.array(found[:, i]) for i in range(size)]], [*by, "_ll", *[f"_{i}" for i in range(size)]])

    def renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _MODEL}
            models = _shaped(batch, batch.num_rows, k, d)
            for i in range(batch.num_rows):
                own = {n: v[i] for n, v in models.items()}
                if not batch.column("_stop")[i].as_py():
                    own = next_model(np.array([batch.column(f"_{j}")[i].as_py() for j in range(size)]), own)
                for n in _MODEL:
                    out[n].append(own[n].reshape(-1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], *[_lists(np.stack(v), len(v[0])) for v in out.values()], *[batch.column(c) for c in ("_now", "rounds", "_stop")]],
                [*by, *_MODEL, "log_likelihood", "rounds", "_stop"])

    kinds = _kinds(blocks, by)
    now = models.select(*by, *_MODEL, F.lit(float("-inf")).alias("log_likelihood"), F.lit(0).alias("rounds"), F.lit(False).alias("_stop"))
    ended: DataFrame | None = None
    for round_ in range(1, most + 1):
        fronts = _messages(blocks, now, by, k, d)
        work = blocks.join(now.select(*by, *_MODEL), by).join(fronts, [*by, "_b"])
        found = work.mapInArrow(sums, f"{kinds}, _ll double, " + ", ".join(f"_{i} double" for i in range(size)))
        found = found.groupBy(*by).agg(F.first("_ll").alias("_now"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(size)])
        stop = (F.lit(round_ > 1) & (F.abs(F.col("_now") - F.col("log_likelihood")) < tol))
        step = now.drop("_stop", "rounds").join(found, by).withColumns({"rounds": F.lit(round_), "_stop": stop})
        now = cut(step.mapInArrow(renewed, f"{kinds}, {_FITTED}, _stop boolean"))
        over = now.where(F.col("_stop") | F.lit(round_ == most)).drop("_stop")
        ended = over if ended is None else ended.union(over)
        now = now.where(~F.col("_stop"))
        if now.isEmpty():
            break
    return ended


def _relabelled(models: DataFrame, by: list[str], k: int, d: int) -> DataFrame:
    """States in order of their mean of the second feature."""
    place = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.element_at("mu", i * d + min(1, d - 1) + 1).alias("v"), i.alias("i"))))
    df = models.withColumn("_p", F.transform(place, lambda s: s["i"]))
    rows = lambda c, n: F.flatten(F.transform("_p", lambda i: F.slice(c, i * n + 1, n)))
    trans = F.flatten(F.transform("_p", lambda i: F.transform("_p", lambda j: F.element_at("trans", i * k + j + 1))))
    start = F.transform("_p", lambda i: F.element_at("start", i + 1))
    return df.select(*by, rows("mu", d).alias("mu"), rows("sigma", d).alias("sigma"), trans.alias("trans"), start.alias("start"), "log_likelihood", "rounds")


def regime_paths(df: DataFrame, models: DataFrame, *, by: list[str], order: str, features: list[str], states: int = 2, block: int = 256) -> DataFrame:
    """Per row filtered (given the rows up to it), smoothed (given all) probabilities of the states, and the state on the most likely path."""
    k, d = states, len(features)
    model = models.select(*by, "mean", "std", *_MODEL)
    rows = df.select(*by, order, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]).join(model.select(*by, "mean", "std"), by)
    usable = _usable(rows, [f"_f{i}" for i in range(d)])
    z = F.array(*[F.when(usable, (F.col(f"_f{i}") - F.col("mean")[i]) / F.col("std")[i]).otherwise(0.0) for i in range(d)])
    rows = positions(rows.select(*by, order, z.alias("_f")), by, order, ("_f",), name="_no")
    rows = cut(rows.select(*by, order, "_f", (F.col("_no") - 1).alias("_no")))
    blocks = _blocks(rows, by, block)
    front, scores = _messages(blocks, model, by, k, d), _messages(blocks, model, by, k, d, best=True)
    kinds = _kinds(blocks, by)

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each state at a block's end, the state before the block."""
        for some, work in _each(batches, k, d):
            back, _ = work.best_steps(np.stack(_arrays(some.column("_front"))))
            came = np.stack([work.labels(back, np.full(some.num_rows, j))[1] for j in range(k)], 1)
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in (*by, "_b", "_back")], _lists(came, k)], [*by, "_b", "_back", "_came"])

    def ends(group: pa.Table) -> pa.Table:
        """The state at each block's end, from the last block to the first."""
        group = group.sort_by("_b")
        came = np.concatenate([np.asarray(c.values) for c in group["_came"].chunks]).reshape(-1, k).astype(int)
        last = np.zeros(len(came), np.int32)
        last[-1] = int(np.argmax(group["_back"][0].values.to_numpy()))
        for i in range(len(came) - 1, 0, -1):
            last[i - 1] = came[i, last[i]]
        return pa.table([*[group[c] for c in (*by, "_b")], pa.array(last)], [*by, "_b", "_last"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, work in _each(batches, k, d):
            f = work.forward(np.stack(_arrays(some.column("_front"))))
            both = f + work.backward(np.stack(_arrays(some.column("_back"))))
            smooth = np.exp(both - _lse(both, 2)[:, :, None])
            back, _ = work.best_steps(np.stack(_arrays(some.column("_score"))))
            path, _ = work.labels(back, np.asarray(some.column("_last")))
            live = np.arange(f.shape[1]) < work.size[:, None]
            again = pa.array(np.repeat(np.arange(some.num_rows), work.size))
            no = (np.asarray(some.column("_b"))[:, None].astype(np.int64) * block + np.arange(f.shape[1]))[live]
            yield pa.RecordBatch.from_arrays([*[some.column(c).take(again) for c in by], pa.array(no), _lists(np.exp(f)[live], k), _lists(smooth[live], k), pa.array(path[live].astype(np.int32))],
                [*by, "_no", "filtered", "smoothed", "state"])

    joined = blocks.join(model.select(*by, *_MODEL), by)
    came = joined.join(scores.drop("_ll"), [*by, "_b"]).mapInArrow(origins, f"{kinds}, _b int, _back array<double>, _came array<double>")
    last = came.groupBy(*by).applyInArrow(ends, f"{kinds}, _b int, _last int")
    full = joined.join(front.drop("_ll"), [*by, "_b"]).join(scores.select(*by, "_b", F.col("_front").alias("_score")), [*by, "_b"]).join(last, [*by, "_b"])
    out = full.mapInArrow(decoded, f"{kinds}, _no long, filtered array<double>, smoothed array<double>, state int")
    return rows.select(*by, order, "_no").join(out, [*by, "_no"]).drop("_no")


def size_multiplier(calm: Column, volatile: Column) -> Column:
    """T-12: position size by the filtered probabilities of the calm and the volatile state."""
    return F.when(calm >= 0.70, 1.0).when(calm >= 0.55, 0.7).when(volatile >= 0.60, 0.3).otherwise(0.5)


def sizing(paths: DataFrame, by: list[str]) -> DataFrame:
    """T-12: what filtered regimes say of each series: mean chance of calm, share of calm bars, mean size, and shares of the sizes."""
    calm = F.col("filtered")[0]
    df = paths.withColumn("_s", size_multiplier(calm, F.col("filtered")[1])).withColumn("_c", calm)
    share = lambda hit: rounded(100 * F.avg(hit.cast("double")), 1)
    sizes = {"full_pct": 1.0, "reduced_pct": 0.7, "uncertain_pct": 0.5, "defensive_pct": 0.3}
    return df.groupBy(*by).agg(F.count("*").alias("bars"), rounded(F.avg("_c")).alias("mean_p_calm"), share(F.col("_c") >= 0.5).alias("pct_calm"),
        rounded(F.avg("_s")).alias("mean_size"), *[share(F.col("_s") == v).alias(n) for n, v in sizes.items()])
