"""Statistical table functions over trades. Random draws come from hashes of (seed, replicate, row), so partitions do not change results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, normal_cdf
from ..functions.metrics import ratio, rounded, won
from .ordering import in_blocks, positions


def _replicates(trades: DataFrame, by: str, rounds: int, seed: int, draw, sums: tuple[str, ...]) -> DataFrame:
    """by, rep and the sums of `draw` over each replicate.

    Equal R values of a group are one row with their count, as the sum of their draws is one draw of known law: the work is rounds times the distinct values.
    A task adds up vectors of all rounds for each group, and only these go through the shuffle. draw(generator, r, counts, rounds): one vector a sum; the
    generator comes from (seed, group, r), so partitions change nothing."""
    import pyarrow as pa

    kind = dict(trades.dtypes)[by]
    rows = trades.where(F.col("r_multiple").isNotNull()).groupBy(by, "r_multiple").agg(F.count("*").alias("k")).withColumn("h", F.xxhash64(F.lit(seed), by, "r_multiple"))
    key = trades.select(by).schema[0].dataType

    def partial(batches):
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_type

        held: dict = {}

        def given():
            for g, m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * rounds, to_arrow_type(key)), pa.array(np.arange(1, rounds + 1, dtype=np.int32)),
                    *[pa.array(v) for v in m]], names=[by, "rep", *sums])
            held.clear()

        for batch in batches:
            for g, r, k, h in zip(*[batch.column(c).to_pylist() for c in (by, "r_multiple", "k", "h")], strict=True):
                if g not in held:
                    if len(held) >= 200:  # bounds the memory of a task
                        yield from given()
                    held[g] = np.zeros((len(sums), rounds))
                draw(np.random.Generator(np.random.SFC64(h & (1 << 64) - 1)), r, k, held[g])
        yield from given()

    tasks = max(2, int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # given, as few bytes hold much work
    parts = rows.repartition(tasks, "h").mapInArrow(partial, f"`{by}` {kind}, rep int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy(by, "rep").agg(*[F.sum(c).alias(c) for c in sums])


def sign_flip(trades: DataFrame, *, by: str = "strategy", rounds: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """T-13: share of sign-flipped mean R at least as far from 0 (p_value), as high or as low as the real one; effect size, power and the trades needed for
    80, 90 and 95 %; and the one-sided p of all groups together after Bonferroni, Holm and Benjamini-Hochberg."""
    from statistics import NormalDist

    def draw(rng, r, k, into):
        import numpy as np

        size = into.shape[1]
        plus = np.bitwise_count(rng.integers(0, 1 << k, size, dtype=np.uint64)) if k < 64 else rng.binomial(k, 0.5, size)
        into[0] += r * (2.0 * plus - k)

    reps = _replicates(trades, by, rounds, seed, draw, ("s",))
    real = trades.groupBy(by).agg(F.count("r_multiple").alias("n"), F.sum("r_multiple").alias("total"), F.avg("r_multiple").alias("mean_r"),
        F.stddev_samp("r_multiple").alias("sd"), F.sum(F.abs("r_multiple")).alias("size"))
    near = 1e-12 * F.col("size")  # sums of the same terms in another order are equal

    def share(hit):
        return (F.sum(hit.cast("long")) + 1) / (rounds + 1)

    s, total = F.col("s"), F.col("total")
    df = reps.join(real, by).groupBy(by).agg(*[F.first(c).alias(c) for c in ("n", "mean_r", "sd")], share(F.abs(s) >= F.abs(total) - near).alias("p_value"),
        share(s >= total - near).alias("p_positive"), share(s <= total + near).alias("p_negative"))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    flat, size = F.col("sd") < 1e-12, F.abs("mean_r")
    d = F.when(flat, F.when(size > 0, float("inf")).otherwise(0.0)).otherwise(size / F.col("sd"))
    power = F.when(flat, (size > 0).cast("double")).otherwise(normal_cdf(size * F.sqrt("n") / F.when(~flat, F.col("sd")) - z))

    def needed(level):
        n = F.ceil(F.pow((z + NormalDist().inv_cdf(level)) / F.col("d"), 2))
        return F.when(flat & (size > 0), F.lit(1)).when(F.col("d") >= 1e-12, F.greatest(n, F.lit(2))).cast("long")

    df = df.withColumn("d", d).withColumn("power", power)
    every, up = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("p_positive", by)  # over one row a group
    m, p, rank = F.count("*").over(every), F.col("p_positive"), F.row_number().over(up)
    df = df.withColumn("_holm", p * (m - rank + 1)).withColumn("_bh", p * m / rank).withColumn("_bonferroni", p * m)
    before, after = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    adjusted = {"bonferroni": F.col("_bonferroni"), "holm": F.max("_holm").over(before), "benjamini_hochberg": F.min("_bh").over(after)}
    return df.select(by, rounded(F.col("mean_r")).alias("mean_r"), "p_value", "p_positive", "p_negative", rounded(F.col("d"), 6).alias("cohens_d"),
        rounded(F.col("power"), 6).alias("power"), *[needed(x / 100).alias(f"n_for_{x}") for x in (80, 90, 95)], *[F.least(v, F.lit(1.0)).alias(f"p_{k}") for k,
        v in adjusted.items()])


def bootstrap(trades: DataFrame, *, by: str = "strategy", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """T-2: percentile intervals of mean R, win rate, expectancy, profit factor and Sharpe ratio, and the share of replicates with a mean R above 0.

    Poisson weights: each row is in a replicate 0, 1, 2, ... times, with partial sums and no index join. Expectancy (win rate times mean win plus loss rate
    times mean loss) is equal to mean R by its definition. Not here: maximum drawdown and blocks, which need the order of the draws."""

    def draw(rng, r, k, into):
        w = rng.poisson(k, into.shape[1])
        into[0] += w
        into[1] += w * r
        into[2] += w * (r * r)
        if r > 0:
            into[3] += w
            into[4] += w * r

    reps = _replicates(trades, by, rounds, seed, draw, ("k", "s", "q", "wins", "gain"))
    k, s, q, wins, gain = (F.col(c) for c in ("k", "s", "q", "wins", "gain"))
    sd = F.sqrt(F.greatest(q - s * s / F.when(k > 0, k), F.lit(0.0)) / F.when(k > 1, k - 1))
    loss = gain - s
    win_rate = ratio(wins, k)
    expectancy = win_rate * F.coalesce(ratio(gain, wins), F.lit(0.0)) - (1 - win_rate) * F.coalesce(ratio(loss, k - wins), F.lit(0.0))
    few = 1e-12 * (gain + F.abs(s))
    stats = {"": ratio(s, k), "win_rate_": win_rate, "expectancy_": expectancy, "profit_factor_": F.when(loss > few, gain / F.when(loss > few, loss)).otherwise(0.0),
        "sharpe_": F.when(sd > 1e-9, ratio(s, k) / F.when(sd > 1e-9, sd)).otherwise(0.0)}
    reps = reps.where("k > 0").select(by, *[v.alias(f"_{n}") for n, v in stats.items()])
    ends = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    out = reps.groupBy(by).agg(*[F.percentile(f"_{n}", ends).alias(f"q_{n}") for n in stats], F.avg((F.col("_") > 0).cast("double")).alias("p_profitable"))
    return out.select(by, *[rounded(F.col(f"q_{n}")[i]).alias(n + x) for n in stats for i, x in enumerate(("low", "middle", "high"))],
        rounded(F.col("p_profitable")).alias("p_profitable"))


def tail_risk(trades: DataFrame, *, by: str = "strategy") -> DataFrame:
    """T-15: normal and historical value at risk, conditional value at risk and Jarque-Bera at 95 %."""
    r = F.col("r_multiple")
    m = trades.groupBy(by).agg(F.count("*").alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
        F.percentile(r, F.lit(0.05)).alias("var_hist"))
    tail = trades.join(m.select(by, "var_hist"), by).where(r <= F.col("var_hist")).groupBy(by).agg(F.avg(r).alias("cvar"))
    jb = F.col("n") / 6 * (F.pow("skew", 2) + F.pow("kurt", 2) / 4)
    return m.join(tail, by).select(by, "n", rounded(F.col("mu") - 1.6448536269514722 * F.col("sd")).alias("var_normal"),
        rounded(F.col("var_hist")).alias("var_hist"), rounded(F.col("cvar")).alias("cvar"), rounded(F.col("skew"), 3).alias("skew"), rounded(F.col("kurt"),
        3).alias("kurt"), rounded(jb, 2).alias("jarque_bera"), rounded(chi2_sf(jb, F.lit(2)), 6).alias("jarque_bera_p"))


def transitions(trades: DataFrame) -> DataFrame:
    """T-16: counts and shares of regime changes from trade to trade."""
    w = Window.partitionBy("strategy").orderBy("entry_time")
    df = trades.withColumn("to_regime", F.lead("regime").over(w)).where("to_regime IS NOT NULL").groupBy(F.col("regime").alias("from_regime"),
        "to_regime").agg(F.count("*").alias("n"))
    return df.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("from_regime"))))


def autocorrelation(trades: DataFrame, *, by: str = "strategy", lags: int = 20) -> DataFrame:
    """Mean-centred autocorrelation against the variance of the whole sample, and the Ljung-Box sum up to each lag with its p-value."""
    mean = trades.groupBy(by).agg(F.avg("r_multiple").alias("_mean"))
    df = positions(trades.select(by, "entry_time", "r_multiple"), [by], "entry_time", ("r_multiple",)).join(mean, by).withColumn("x", F.col("r_multiple") - F.col("_mean"))
    w = Window.partitionBy(by, "_block").orderBy("no")
    df = in_blocks(df, [by], lags).select(by, "x", "_halo", *[F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)]).where("NOT _halo")
    sums = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    long = sums.select(by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), ratio(F.col(f"c{k}"), F.col("v")).alias("acf")) for k in range(1,
        lags + 1)])).alias("z")).select(by, "n", "z.lag", "z.acf")
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.pow("acf", 2) / (F.col("n") - F.col("lag"))).over(Window.partitionBy(by).orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    long = long.withColumn("_q", q)
    return long.select(by, "lag", rounded(F.col("acf")).alias("acf"), rounded(F.col("_q"), 3).alias("ljung_box"), rounded(chi2_sf(F.col("_q"), F.col("lag")), 6).alias("ljung_box_p"),
        (F.abs("acf") > 1.96 / F.sqrt("n")).alias("significant"))


def excursion_bins(trades: DataFrame, bins: int = 5) -> DataFrame:
    """T-17: mean R by quantile bins of the bars held."""
    cuts = trades.agg(F.percentile("bars_held", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("q"))
    df = trades.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("q", lambda c: c < F.col("bars_held"))))  # cuts: one row
    return df.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("r_multiple")).alias("mean_r"), rounded(F.avg("mfe")).alias("mfe"), rounded(F.avg("mae")).alias("mae"))


def bayes(trades: DataFrame, *, by: str = "strategy", alpha: float = 1.0, beta: float = 1.0, mu: float = 0.0, sigma: float = 10.0) -> DataFrame:
    """T-11: Beta posterior of the win rate and normal posterior of mean R."""
    df = trades.groupBy(by).agg(F.count("*").alias("n"), F.sum(won().cast("long")).alias("wins"), F.avg("r_multiple").alias("m"), F.var_samp("r_multiple").alias("v"))
    a, b = alpha + F.col("wins"), beta + F.col("n") - F.col("wins")
    precision = 1 / sigma**2 + F.col("n") / F.col("v")
    return df.select(by, "n", "wins", rounded(a / (a + b)).alias("win_mean"), rounded(F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))), 6).alias("win_sd"),
        rounded((mu / sigma**2 + F.col("n") * F.col("m") / F.col("v")) / precision).alias("r_mean"), rounded(F.sqrt(1 / precision), 6).alias("r_sd"))


def risk_ratios(daily: DataFrame, by: str = "strategy") -> DataFrame:
    """M10 over daily R: Sharpe, Sortino (downside only), Omega, 252 days a year."""
    r = F.col("r")
    return daily.groupBy(by).agg(
        F.count("*").alias("days"),
        rounded(ratio(F.avg(r), F.stddev_samp(r)) * 252**0.5).alias("sharpe"),
        rounded(ratio(F.avg(r), F.sqrt(F.avg(F.when(r < 0, r * r)))) * 252**0.5).alias("sortino"),
        rounded(ratio(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r)))).alias("omega"),
    )


def expected_best(trials: int) -> float:
    """T-5: the Sharpe ratio that the best of `trials` (two or more) strategies without an edge is taken to show."""
    import math

    log = math.log(trials)
    return math.sqrt(2 * log) - (math.log(math.pi) + math.log(log)) / (2 * math.sqrt(2 * log))


def minimum_length(sr: Column, trials: int, *, skew: Column | float = 0.0, kurt: Column | float = 3.0, confidence: float = 0.95) -> Column:
    """T-5: how many results a Sharpe ratio needs to stand out from `trials`: 252 where there is nothing to test, 99,999 where it stays below what chance shows, 30 at least."""
    from statistics import NormalDist

    if trials <= 1:
        return F.lit(252).cast("long")
    best, z = expected_best(trials), NormalDist().inv_cdf(confidence)
    spread = 1 + 0.5 * sr * sr - skew * sr + (kurt - 3) / 4 * sr * sr
    n = F.ceil(z * z * spread / F.pow(F.when(sr > best, sr - best), F.lit(2.0))) + 1
    return F.when(sr <= 0, 252).when(sr <= best, 99_999).otherwise(F.greatest(n, F.lit(30))).cast("long")


def deflated_sharpe(trades: DataFrame, *, by: str = "strategy", trials: int = 100) -> DataFrame:
    """T-5: the Sharpe ratio against what the best of `trials` would show by chance, with its p-value and verdict, and the number of trades it would need."""
    best = expected_best(trials)
    r = F.col("r_multiple")
    df = trades.groupBy(by).agg(F.count("*").alias("n"), ratio(F.avg(r), F.stddev_samp(r)).alias("sr"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    sr = F.col("sr")
    var = (1 + 0.5 * sr * sr - F.col("skew") * sr + (F.col("kurt") - 3) / 4 * sr * sr) / (F.col("n") - 1)
    stat = (sr - best) / F.sqrt(var)
    p = normal_cdf(-stat)
    return df.select(by, "n", rounded(sr).alias("sharpe"), rounded(stat, 3).alias("statistic"), rounded(p, 6).alias("p_value"), (p < 0.05).alias("significant"),
        minimum_length(sr, trials, skew=F.col("skew"), kurt=F.col("kurt")).alias("min_length"))


def classifier_report(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Q1: accuracy, Brier score, calibration error and exact ROC area. scored: predicted_prob, won (0/1)."""
    from .filters import areas

    p, y = F.col("predicted_prob"), F.col("won").cast("double")
    n = F.count("*")
    auc = areas(scored.select("predicted_prob", F.when(F.col("won") == 1, "win").otherwise("loss").alias("actual_outcome"))).select("roc_auc")
    base = scored.agg(n.alias("n"), rounded(F.avg(((p >= 0.5).cast("int") == F.col("won")).cast("double"))).alias("accuracy"), rounded(F.avg(F.pow(p - y, 2))).alias("brier_score"))
    cells = scored.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("b")).agg(n.alias("k"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    ece = cells.agg(rounded(ratio(F.sum(F.col("k") * F.col("gap")), F.sum("k"))).alias("expected_calibration_error"))
    return base.join(auc).join(ece)  # one row each
