"""Aggregate expressions over trades. A win has three meanings here, so each metric names its own: by outcome, by R or by PnL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def won() -> Column:
    """A win by its outcome label."""
    return F.col("outcome").contains("win")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson's r of the rows that have both, as an aggregate or over a window; null where one side is constant (Spark's own `corr` raises an error there)."""
    both = x.isNotNull() & y.isNotNull()
    parts = [F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))]
    together, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return F.try_divide(together, F.nullif(sx * sy, F.lit(0.0)))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def rounded(x: Column, n: int = 4) -> Column:
    """Rounded without a negative zero. Means of short decimals lie on rounding ties, which engines break by their last bit: a fixed shift far below the last digit moves them off."""
    return F.round(x + F.lit(1.37e-7), n) + F.lit(0.0)


def profit_factor(x: Column) -> Column:
    """Gains over losses (x < 0); null without losses."""
    return ratio(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x))))


def expectancy(x: Column = None) -> Column:
    """wr * mean win + (1 - wr) * mean loss: wr by outcome, means by sign (losses include 0)."""
    r = F.col("r_multiple") if x is None else x
    wr = share(won())
    return wr * F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)) + (1 - wr) * F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the score interval; (0, 1) for n = 0."""
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    low, high = F.greatest(centre - margin, F.lit(0.0)), F.least(centre + margin, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)
