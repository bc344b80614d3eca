"""Queries over price zones: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import series as s
from ..operators import zones as z
from ..operators.ordering import positions
from ..operators.retracements import retracement_signals
from .trade_queries import QUERIES, query
from .views import bars


def _numbered(df: DataFrame) -> DataFrame:
    return positions(df, ["symbol"], "bar_ts")


@query(""", n AS (SELECT *, CAST(row_number() OVER w AS INT) AS no, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close) OVER w AS mid, lag(volume) OVER w AS v1,
 CASE WHEN count(volume) OVER p >= 10 THEN avg(volume) OVER p END AS vm FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts),
 p AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT symbol, no AS formed, h2 < low AS bullish, CASE WHEN h2 < low THEN low ELSE l2 END AS top, CASE WHEN h2 < low THEN h2 ELSE high END AS bottom, mid,
 coalesce(vm > 0 AND v1 > 1.2E0 * vm, false) AS busy FROM n WHERE (h2 < low OR l2 > high) AND mid > 0), k AS (SELECT *, (top - bottom) / mid AS share FROM z WHERE (top - bottom) / mid >= 0.002)
SELECT symbol, formed, bullish, round(top + 1.37E-7, 4) + 0.0E0 AS top, round(bottom + 1.37E-7, 4) + 0.0E0 AS bottom, round(share + 1.37E-7, 6) AS share, busy,
 (SELECT min(n.no) FROM n WHERE n.symbol = k.symbol AND n.no BETWEEN formed AND formed + 50 AND CASE WHEN bullish THEN close < bottom ELSE close > top END) AS broken,
 (SELECT min(n.no) FROM n WHERE n.symbol = k.symbol AND n.no BETWEEN formed + 1 AND formed + 50 AND CASE WHEN bullish THEN low <= top ELSE high >= bottom END) AS touched FROM k""")
def g1_zone_lives(spark, d):
    df = z.zone_lives(_numbered(bars(spark, d)), by=["symbol"])
    return df.withColumns({"top": rounded(F.col("top")), "bottom": rounded(F.col("bottom")), "share": rounded(F.col("share"), 6)})


def g1_zone_signals(spark, d):
    """Entries at retests of zones and at flipped ones, over bars with their indicators and structure; which of two touches comes first has no SQL, tests follow it bar by bar."""
    df = s.structure_bias(s.indicators(bars(spark, d))).withColumnsRenamed({"bar_no": "no", "structure_bias": "structure"})
    df = z.zone_signals(df, by=["symbol"])
    return df.select("symbol", "bar_ts", "direction", "signal_type", *[rounded(F.col(c)).alias(c) for c in ("entry", "sl", "tp1", "tp2", "confidence")], "bias")


def g6_retracement_signals(spark, d):
    """Entries at rejected sweeps of the 0.618 retracement, over bars with their indicators and structure; tests follow them bar by bar."""
    df = s.structure_bias(s.indicators(bars(spark, d))).withColumnsRenamed({"bar_no": "no", "structure_bias": "structure"})
    df = retracement_signals(df, by=["symbol"])
    return df.select("symbol", "bar_ts", "direction", *[rounded(F.col(c)).alias(c) for c in ("entry", "sl", "tp1", "tp2", "confidence")], "bias")


QUERIES |= {"g1_zone_signals": g1_zone_signals, "g6_retracement_signals": g6_retracement_signals}
