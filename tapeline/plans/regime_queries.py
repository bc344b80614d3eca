"""Queries over hidden regimes of bars: id_name -> query. SQL has no means for them; tests hold the operators against sequential runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import regimes as r
from ..operators import series as s
from ..operators.ordering import positions
from .trade_queries import QUERIES
from .views import bars

FEATURES = ["log_return", "realised_vol"]
_MODEL = dict(by=["symbol"], order="bar_ts", features=FEATURES)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _features(spark, d) -> DataFrame:
    before = F.lag("close").over(s.ordered())
    df = bars(spark, d).withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))
    return df.select("symbol", "bar_ts", "log_return", s.guarded(F.stddev_samp, F.col("log_return"), 20).alias("realised_vol"))


@_query
def w42_hidden_regimes(spark, d):
    """Every bar's chance to be calm, from the bars up to it and from all, and its state on the most likely path (0: calm)."""
    df = _features(spark, d)
    paths = r.regime_paths(df, r.fit_regimes(df, **_MODEL), **_MODEL)
    return paths.select("symbol", "bar_ts", rounded(F.col("filtered")[0], 6).alias("filtered_calm"), rounded(F.col("smoothed")[0], 6).alias("smoothed_calm"), "state")


@_query
def t12_regime_sizing(spark, d):
    """Models of the first 70 % of each symbol's bars, filtered over the rest: how calm they are and the sizes that follow."""
    df = positions(_features(spark, d), ["symbol"], "bar_ts")
    n = df.groupBy("symbol").agg(F.count("*").alias("_n"))
    df = df.join(n, "symbol").withColumn("_train", F.col("no") <= F.floor(0.7 * F.col("_n")))
    models = r.fit_regimes(df.where("_train"), **_MODEL)
    found = r.sizing(r.regime_paths(df.where("NOT _train"), models, **_MODEL), ["symbol"])
    shown = models.select("symbol", F.col("n").alias("trained_on"), *[rounded(F.col("trans")[i], 6).alias(c) for i, c in ((0, "stay_calm"), (3, "stay_volatile"))])
    return shown.join(found, "symbol")
