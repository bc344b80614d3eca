"""Queries over resampled paths and portfolios: id_name -> query. Random draws and programs have no SQL; tests hold the operators against exact laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import frontier, joins
from ..operators import resampling as r
from .trade_queries import QUERIES
from .views import trades


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def t2_path_intervals(spark, d):
    """Intervals with the deepest fall, from blocks of five trades."""
    return r.path_intervals(trades(spark, d), rounds=2000, size=5)


@_query
def t3_equity_fan(spark, d):
    df = r.equity_fan(trades(spark, d), rounds=1000)
    return df.select("strategy", "trade", *[rounded(F.col(c)).alias(c) for c in df.columns[2:]])


@_query
def t3_fan_summary(spark, d):
    return r.fan_summary(trades(spark, d), rounds=1000)


@_query
def t14_ruin(spark, d):
    return r.ruin_chances(trades(spark, d))


@_query
def t14_kelly(spark, d):
    return r.kelly_bounds(trades(spark, d))


@_query
def t7_mean_variance(spark, d):
    df = frontier.mean_variance(joins.daily_r(trades(spark, d)))
    return df.select("strategy", *[rounded(F.col(c), 6).alias(c) for c in ("weight", "mean", "deviation", "shrinkage")])
