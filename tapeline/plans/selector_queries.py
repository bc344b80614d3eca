"""Queries over the choice between strategies: id_name -> (query, oracle SQL). A forest has no SQL; tests hold its parts against plain runs.

The given tables span 30 days, so walks start at 15 days and labels look 3 days ahead (60 and 7 are the operators' defaults)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import joins, market
from ..operators import selector as c
from ..operators import series as s
from .series_queries import w30_market_features, w31_regimes
from .trade_queries import ORACLE_SQL, QUERIES
from .views import bars, trades

DAYS = 3
COLUMNS = [*market.FEATURES, *[f"regime_{x}" for x in c.REGIMES]]


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rows(spark, d) -> DataFrame:
    ind = s.indicators(bars(spark, d))
    regimes = ind.select("symbol", "bar_ts", s.regime(ind).alias("regime"))
    return c.selector_rows(market.market_features(ind), regimes, joins.daily_r(trades(spark, d)), columns=market.FEATURES, days=DAYS)


@_query
def x1_selector_rows(spark, d):
    """A market's features at the end of each day, and the strategy that does best over the days after it."""
    df = _rows(spark, d)
    forward = F.map_values("forward")
    return df.select("symbol", "day", *[rounded(F.col(f)).alias(f) for f in market.FEATURES], *COLUMNS[len(market.FEATURES) :], "label", F.size(forward).cast("long").alias("n_strategies"),
        rounded(F.array_max(forward)).alias("best"), rounded(F.array_min(forward)).alias("worst"))


def _inner(fn) -> str:
    """Another query's SQL as a table."""
    return f"({ORACLE_SQL[fn.__name__].replace('WITH bars', 'WITH RECURSIVE bars', 1).replace('RECURSIVE_MARK ', '')})"


_HALF = " + ".join(f"CAST({f} IS NULL AS INT)" for f in market.FEATURES)
ORACLE_SQL["x1_selector_rows"] = f"""SELECT f.symbol, d.day, {", ".join(f"round(coalesce(f.{x}, 0.0E0), 4) + 0.0E0 AS {x}" for x in market.FEATURES)},
 {", ".join(f"CASE WHEN r.regime = '{x}' THEN 1.0E0 ELSE 0.0E0 END AS regime_{x}" for x in c.REGIMES)}, d.label, d.n_strategies, d.best, d.worst
FROM {_inner(w30_market_features)} f JOIN {_inner(w31_regimes)} r ON r.symbol = f.symbol AND r.bar_ts = f.bar_ts
JOIN (WITH t AS (SELECT event_type AS strategy, CAST(CAST(ts + INTERVAL '15' MINUTE * CAST(event_id % 40 + 1 AS INT) AS DATE) AS VARCHAR) AS day, sum(round((value - 50.0E0) / 50.0E0, 4)) AS r
  FROM events GROUP BY ALL), g AS (SELECT a.day, b.strategy, coalesce(t.r, 0) AS r FROM (SELECT DISTINCT day FROM t) a CROSS JOIN (SELECT DISTINCT strategy FROM t) b
  LEFT JOIN t ON t.day = a.day AND t.strategy = b.strategy), w AS (SELECT *, sum(r) OVER o AS forward, count(*) OVER o AS n FROM g
  WINDOW o AS (PARTITION BY strategy ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {DAYS} FOLLOWING))
  SELECT day, CASE WHEN max(forward) <= 0 THEN 'none' ELSE arg_max(strategy, forward) END AS label, count(*) AS n_strategies, round(max(forward) + 1.37E-7, 4) + 0.0E0 AS best,
  round(min(forward) + 1.37E-7, 4) + 0.0E0 AS worst FROM w WHERE n = {DAYS} GROUP BY day) d ON d.day = CAST(CAST(f.bar_ts AS DATE) AS VARCHAR)
WHERE 2 * ({_HALF}) < {len(COLUMNS)} QUALIFY row_number() OVER (PARTITION BY f.symbol, d.day ORDER BY f.bar_ts DESC) = 1"""


@_query
def x2_selector_training(spark, d):
    """How a forest over past days does on the days after: folds in time order, then the days held out."""
    return c.training(_rows(spark, d), COLUMNS, embargo=DAYS)


@_query
def x3_selector_walk(spark, d):
    """What following the forest's choice earns against equal weights and hindsight, refitted as time goes on."""
    return c.walk_metrics(c.walk_forward(_rows(spark, d), COLUMNS, least=15, every=5, embargo=DAYS))


@_query
def x5_feature_importance(spark, d):
    """Which features the forest's choice rests on, by their contributions, by gain and by dealing their values anew."""
    return c.importance(_rows(spark, d), COLUMNS)


@_query
def q9_win_confidence(spark, d):
    """The last third of the trades by time, each with the chance to win that a forest over trades closed before it gives."""
    df = trades(spark, d)
    span = df.agg(F.min("entry_time").alias("a"), F.max("entry_time").alias("b")).first()
    until = F.lit(span["a"] + (span["b"] - span["a"]) * 2 / 3 if span["a"] else None)  # an empty table has no time to cut at
    known = F.when(F.col("regime") != "unknown", F.array_position(F.array(*[F.lit(x) for x in c.REGIMES]), F.col("regime")).cast("double"))
    df = df.withColumns({"is_win": F.col("outcome").contains("win"), "hour": F.hour("entry_time"), "weekday": F.weekday("entry_time"),
        "is_long": (F.col("direction") == "LONG").cast("double"), "regime_no": known})
    found = c.win_confidence(df, ["hour", "weekday", "is_long", "regime_no", "entry_price"], until=until)
    return found.withColumn("confidence", rounded(F.col("confidence")))
