"""Queries over bars: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import joins, market
from ..operators import series as s
from ..operators import sessions as se
from ..operators import simulation as sim
from .trade_queries import _SESSION, query
from .views import bars, trades

_O = "PARTITION BY symbol, timeframe ORDER BY bar_ts"


def _r(*names: str, n: int = 4):
    return [rounded(F.col(c), n).alias(c) for c in names]


@query(f""" SELECT symbol, bar_ts, round(greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) + 1.37E-7,
 4) + 0.0E0 AS tr FROM bars WINDOW w AS ({_O})""")
def w1_true_range(spark, d):
    return bars(spark, d).select("symbol", "bar_ts", rounded(s.true_range()).alias("tr"))


def _ewm_sql(name: str, source: str, alpha: str) -> str:
    return f"""{name} AS (SELECT symbol, no, {source} AS y FROM base WHERE no = 1 UNION ALL SELECT b.symbol, b.no, (1 - {alpha}) * e.y + {alpha} * b.{source}
 FROM {name} e JOIN base b ON b.symbol = e.symbol AND b.no = e.no + 1)"""


_BASE = f""" base0 AS (SELECT *, row_number() OVER w AS no, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
 greatest(coalesce(close - lag(close) OVER w, 0), 0) AS gain, greatest(coalesce(lag(close) OVER w - close, 0), 0) AS loss, high - lag(high) OVER w AS up,
 lag(low) OVER w - low AS down FROM bars WINDOW w AS ({_O})),
base1 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm FROM base0), base AS (SELECT *,
 CASE WHEN down > pdm AND down > 0 THEN down ELSE 0 END AS mdm FROM base1)"""
_W14 = "(1.0E0 / 14)"


@query(f""", RECURSIVE_MARK {_BASE}, nu AS (SELECT symbol, no, close AS y, 1.0E0 AS d FROM base WHERE no = 1 UNION ALL SELECT b.symbol, b.no,
 (49.0E0 / 51) * e.y + b.close, (49.0E0 / 51) * e.d + 1 FROM nu e JOIN base b ON b.symbol = e.symbol AND b.no = e.no + 1) SELECT b.symbol, b.bar_ts,
 round(y / d + 1.37E-7, 4) + 0.0E0 AS ema_50 FROM base b JOIN nu USING (symbol, no)""")
def w3_adjusted_ewm(spark, d):
    return s.ewm_adjusted(bars(spark, d), {"ema_50": ("close", 2 / 51)}).select("symbol", "bar_ts", *_r("ema_50"))


#: ind: the bars of `base` with their indicators.
_IND = ", RECURSIVE_MARK " + ", ".join([
    _BASE, _ewm_sql("e20", "close", "(2.0E0 / 21)"), _ewm_sql("e50", "close", "(2.0E0 / 51)"), _ewm_sql("e200", "close", "(2.0E0 / 201)"), _ewm_sql("atr0", "tr", _W14),
    _ewm_sql("g", "gain", _W14), _ewm_sql("l", "loss", _W14), _ewm_sql("pd", "pdm", _W14), _ewm_sql("md", "mdm", _W14),
    """ds AS (SELECT symbol, no, 100 * pd.y / (atr0.y + 1e-10) AS p, 100 * md.y / (atr0.y + 1e-10) AS m FROM pd JOIN md USING (symbol, no) JOIN atr0 USING (symbol, no))""",
    "dx AS (SELECT symbol, no, 100 * abs(p - m) / (p + m + 1e-10) AS x FROM ds)",
    f"adx0 AS (SELECT symbol, no, x AS y FROM dx WHERE no = 1 UNION ALL SELECT d.symbol, d.no, (1 - {_W14}) * e.y + {_W14} * d.x FROM adx0 e JOIN dx d ON d.symbol = e.symbol AND d.no = e.no + 1)",
    """ind AS (SELECT b.*, e20.y AS ema_20, e50.y AS ema_50, e200.y AS ema_200, CASE WHEN no >= 14 THEN atr0.y END AS atr,
 CASE WHEN no >= 14 THEN 100 - 100 / (1 + g.y / (l.y + 1e-10)) END AS rsi,
 CASE WHEN no >= 14 THEN adx0.y END AS adx FROM base b JOIN e20 USING (symbol, no) JOIN e50 USING (symbol, no) JOIN e200 USING (symbol, no) JOIN atr0 USING (symbol,
 no) JOIN g USING (symbol, no) JOIN l USING (symbol, no) JOIN adx0 USING (symbol, no))""",
])


def _round_sql(*names: str, n: int = 4) -> str:
    return ", ".join(f"round({c} + 1.37E-7, {n}) + 0.0E0 AS {c}" for c in names)


@query(_IND + " SELECT symbol, bar_ts, " + _round_sql("adx", "ema_50") + ", ema_50 > ema_200 AS bullish, ema_50 < ema_200 AS bearish FROM ind")
def w12_trend_flags(spark, d):
    df = s.indicators(bars(spark, d))
    return df.select("symbol", "bar_ts", *_r("adx", "ema_50"), (F.col("ema_50") > F.col("ema_200")).alias("bullish"), (F.col("ema_50") < F.col("ema_200")).alias("bearish"))


@query(f""", RECURSIVE_MARK {_BASE}, {_ewm_sql('e20', 'close', '(2.0E0 / 21)')}, {_ewm_sql('e200', 'close', '(2.0E0 / 201)')},
 {_ewm_sql('atr', 'tr', '(1.0E0 / 14)')}, {_ewm_sql('g', 'gain', '(1.0E0 / 14)')}, {_ewm_sql('l', 'loss', '(1.0E0 / 14)')} SELECT b.symbol, b.bar_ts,
 round(e20.y + 1.37E-7, 4) + 0.0E0 AS ema_20, round(e200.y + 1.37E-7, 4) + 0.0E0 AS ema_200, CASE WHEN b.no >= 14 THEN round(atr.y + 1.37E-7, 4) + 0.0E0 END AS atr,
 CASE WHEN b.no >= 14 THEN round(100 - 100 / (1 + g.y / (l.y + 1e-10)) + 1.37E-7, 4) + 0.0E0 END AS rsi FROM base b JOIN e20 USING (symbol, no)
 JOIN e200 USING (symbol, no) JOIN atr USING (symbol, no) JOIN g USING (symbol, no) JOIN l USING (symbol, no)""")
def w2_ewm_indicators(spark, d):
    return s.indicators(bars(spark, d)).select("symbol", "bar_ts", *_r("ema_20", "ema_200", "atr", "rsi"))


@query(f""" SELECT symbol, bar_ts, CASE WHEN count(*) OVER w >= 20 THEN round(avg(volume) OVER w + 1.37E-7, 4) END AS sma_volume,
 CASE WHEN count(*) OVER w >= 20 THEN volume > 1.5 * avg(volume) OVER w END AS high_volume FROM bars WINDOW w AS ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w6_volume(spark, d):
    sma = s.guarded(F.avg, F.col("volume"), 20)
    return bars(spark, d).select("symbol", "bar_ts", rounded(sma, 4).alias("sma_volume"), (F.col("volume") > 1.5 * sma).alias("high_volume"))


@query(f""" SELECT symbol, bar_ts, CASE WHEN n >= 20 THEN (CASE WHEN high - low > 2 * m THEN 2 WHEN high - low > 1.5 * m THEN 1 ELSE 0 END) END AS manipulation
 FROM (SELECT *, count(*) OVER w AS n, avg(high - low) OVER w AS m FROM bars WINDOW w AS ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def w7_manipulation(spark, d):
    span = F.col("high") - F.col("low")
    mean = s.guarded(F.avg, span, 20)
    return bars(spark, d).select("symbol", "bar_ts", F.when(mean.isNotNull(), F.when(span > 2 * mean, 2).when(span > 1.5 * mean, 1).otherwise(0)).alias("manipulation"))


@query(f""", y AS (SELECT *, lag(close) OVER ({_O}) AS l FROM bars), x AS (SELECT *, CASE WHEN close > 0 AND l > 0 THEN ln(close / l) END AS r FROM y)
SELECT symbol, bar_ts, round(r + 1.37E-7, 4) + 0.0E0 AS log_return, CASE WHEN count(r) OVER w >= 20 THEN round(stddev_samp(r) OVER w + 1.37E-7, 4) + 0.0E0 END AS realised_vol
FROM x WINDOW w AS ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w8_realised_vol(spark, d):
    before = F.lag("close").over(s.ordered())
    df = bars(spark, d).withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))
    return df.select("symbol", "bar_ts", rounded(F.col("log_return")).alias("log_return"), rounded(s.guarded(F.stddev_samp, F.col("log_return"), 20)).alias("realised_vol"))


@query(f""", x AS (SELECT symbol, bar_ts, close, list(close) OVER ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, bar_ts,
 CASE WHEN len(l) >= 20 THEN round(len(list_filter(l, lambda v: v <= close)) / 20.0E0 + 1.37E-7, 4) END AS pct_rank FROM x""")
def w9_percentile_rank(spark, d):
    w = s.ordered().rowsBetween(-19, 0)
    df = bars(spark, d).withColumn("_l", F.collect_list("close").over(w))
    return df.select("symbol", "bar_ts", F.when(F.size("_l") >= 20, rounded(F.size(F.filter("_l", lambda v: v <= F.col("close"))) / 20, 4)).alias("pct_rank"))


@query(f""" SELECT symbol, bar_ts, round((close - lag(close, 5) OVER w) / nullif(lag(close, 5) OVER w, 0) + 1.37E-7, 4) + 0.0E0 AS momentum,
 round(coalesce((close - low) / nullif(high - low, 0), 0.5E0) + 1.37E-7, 4) + 0.0E0 AS close_in_range FROM bars WINDOW w AS ({_O})""")
def w10_momentum(spark, d):
    old = F.lag("close", 5).over(s.ordered())
    return bars(spark, d).select("symbol", "bar_ts", rounded(F.try_divide(F.col("close") - old, old)).alias("momentum"),
        rounded(F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))).alias("close_in_range"))


@query(f""", x AS (SELECT *, coalesce(CAST(sign(close - lag(close) OVER ({_O})) AS INT), 0) AS s FROM bars), y AS (SELECT *,
 CASE WHEN lag(s) OVER ({_O}) IS NULL OR s <> lag(s) OVER ({_O}) THEN 1 ELSE 0 END AS c FROM x), z AS (SELECT *, sum(c) OVER ({_O}) AS run FROM y) SELECT symbol,
 bar_ts, CAST(s * row_number() OVER (PARTITION BY symbol, timeframe, run ORDER BY bar_ts) AS INT) AS streak FROM z""")
def w11_candle_streak(spark, d):
    return s.candle_streaks(bars(spark, d)).select("symbol", "bar_ts", "streak")


@query(""" SELECT symbol, time_bucket(INTERVAL '4 hours', bar_ts, TIMESTAMP '1970-01-01') AS bar_ts, min_by(open, bar_ts) AS open, max(high) AS high,
 min(low) AS low, max_by(close, bar_ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def w14_resample_4h(spark, d):
    return s.resample(bars(spark, d), "hour", 4)


@query(""" SELECT symbol, date_trunc('day', bar_ts) AS bar_ts, min_by(open, bar_ts) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_ts) AS close,
 sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('day', bar_ts)""")
def w14_resample_day(spark, d):
    df = s.resample(bars(spark, d), "day")
    return df.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))


@query(f""", x AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS mh, min(low) OVER w AS ml FROM bars
 WINDOW w AS ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT symbol, bar_ts, lag(CASE WHEN n = 7 AND high = mh THEN high END, 3) OVER ({_O}) AS swing_high,
 lag(CASE WHEN n = 7 AND low = ml THEN low END, 3) OVER ({_O}) AS swing_low FROM x""")
def w15_swings_causal(spark, d):
    return s.swings(bars(spark, d)).select("symbol", "bar_ts", "swing_high", "swing_low")


@query(f""", x AS (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'down' END AS state FROM bars), y AS (SELECT *, CASE WHEN state IS DISTINCT
 FROM lag(state) OVER ({_O}) THEN 1 ELSE 0 END AS c FROM x), z AS (SELECT *, sum(c) OVER ({_O}) AS run FROM y) SELECT symbol, timeframe, state,
 min(bar_ts) AS begins, max(bar_ts) AS ends, count(*) AS bars FROM z GROUP BY symbol, timeframe, run, state""")
def w33_islands(spark, d):
    return s.islands(bars(spark, d), F.when(F.col("close") > F.col("open"), "up").otherwise("down"))


_GAP = f"""x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close) OVER w AS m FROM bars WINDOW w AS ({_O})),
g AS (SELECT *, CASE WHEN low > h2 AND (low - h2) / nullif(m, 0) >= 0.001 THEN 'bullish' WHEN high < l2 AND (l2 - high) / nullif(m, 0) >= 0.001 THEN 'bearish' END AS kind FROM x),
f AS (SELECT *, CASE kind WHEN 'bullish' THEN h2 ELSE high END AS bottom, CASE kind WHEN 'bullish' THEN low ELSE l2 END AS top FROM g)"""


@query(f", {_GAP} SELECT symbol, bar_ts, kind, bottom, top FROM f WHERE kind IS NOT NULL")
def p5_gaps(spark, d):
    return s.gaps(bars(spark, d)).select("symbol", "bar_ts", "kind", "bottom", "top")


@query(f""", {_GAP}, z AS (SELECT *, min(low) OVER w AS ll, max(high) OVER w AS lh FROM f WINDOW w AS ({_O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT symbol, bar_ts, kind, bottom, top FROM z WHERE kind = 'bullish' AND (ll IS NULL OR ll > bottom) OR kind = 'bearish' AND (lh IS NULL OR lh < top)""")
def p6_open_gaps(spark, d):
    return s.open_gaps(bars(spark, d)).select("symbol", "bar_ts", "kind", "bottom", "top")


@query(f""", x AS (SELECT *, count(*) OVER p AS n, max(high) OVER p AS t, min(low) OVER p AS b, lead(high) OVER w AS nh, lead(low) OVER w AS nl,
 min(low) OVER f AS ll, max(high) OVER f AS lh FROM bars
 WINDOW w AS ({_O}), p AS ({_O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS ({_O} ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT symbol, bar_ts, CASE WHEN close < open AND nh > t AND (ll IS NULL OR ll > low) THEN 'bullish' ELSE 'bearish' END AS kind FROM x
 WHERE n = 20 AND (close < open AND nh > t AND (ll IS NULL OR ll > low) OR close > open AND nl < b AND (lh IS NULL OR lh < high))""")
def p9_order_blocks(spark, d):
    return s.order_blocks(bars(spark, d)).select("symbol", "bar_ts", "kind")


@query(f""", RECURSIVE_MARK {_BASE}, seed AS (SELECT symbol, 15 AS no, avg(tr) AS y FROM base WHERE no BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
sm AS (SELECT * FROM seed UNION ALL SELECT b.symbol, b.no, (1 - {_W14}) * e.y + {_W14} * b.tr FROM sm e JOIN base b ON b.symbol = e.symbol AND b.no = e.no + 1),
x AS (SELECT b.*, CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS h, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS l,
 lag(high) OVER w AS ph, lag(low) OVER w AS pl,
 0.1E0 * CASE WHEN sm.y > 0 THEN sm.y ELSE 1 END AS least_depth FROM base b LEFT JOIN sm USING (symbol, no) WINDOW w AS ({_O}),
 p AS ({_O} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)),
y AS (SELECT *, CASE WHEN low < l - l * 0.002E0 AND close > l AND pl >= l * (1 - 0.002E0) AND l - low >= least_depth THEN 'low'
 WHEN high > h + h * 0.002E0 AND close < h AND ph <= h * (1 + 0.002E0) AND high - h >= least_depth THEN 'high' END AS side FROM x)
SELECT symbol, bar_ts, side, CASE side WHEN 'low' THEN l ELSE h END AS level, round(CASE side WHEN 'low' THEN l - low ELSE high - h END + 1.37E-7, 4) AS sweep_depth
 FROM y WHERE side IS NOT NULL""")
def p10_sweeps(spark, d):
    return s.sweeps(bars(spark, d)).select("symbol", "bar_ts", "side", "level", rounded(F.col("sweep_depth")).alias("sweep_depth"))


@query(_IND + f""", x AS (SELECT *, CASE WHEN close <> 0 THEN atr / close ELSE atr * CAST('Infinity' AS DOUBLE) END AS pct,
 CASE WHEN close > 0 THEN atr / close ELSE 0 END AS own FROM ind),
y AS (SELECT *, avg(pct) OVER ({_O} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS mean FROM x)
SELECT symbol, bar_ts, CASE WHEN no <= 50 THEN 'unknown' WHEN own > 1.8E0 * mean THEN 'volatile' WHEN adx > 30 AND close > ema_50 THEN 'trending_up' WHEN adx > 30 THEN 'trending_down' ELSE 'ranging' END AS regime FROM y""")
def w31_regimes(spark, d):
    df = s.indicators(bars(spark, d))
    return df.select("symbol", "bar_ts", s.regime(df).alias("regime"))


@query(_IND + " SELECT symbol, bar_ts, CASE WHEN adx IS NULL OR adx < 20 THEN 'Ranging' WHEN ema_50 > ema_200 THEN 'Trending Up' ELSE 'Trending Down' END AS regime FROM ind")
def w32_simple_regimes(spark, d):
    df = s.indicators(bars(spark, d))
    return df.select("symbol", "bar_ts", s.simple_regime(df).alias("regime"))


_SWING = f""", x AS (SELECT *, row_number() OVER ({_O}) AS no, count(*) OVER w AS n, max(high) OVER w AS mh, min(low) OVER w AS ml FROM bars
 WINDOW w AS ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
hs AS (SELECT symbol, no, high AS v, row_number() OVER (PARTITION BY symbol ORDER BY no) AS k, lag(high) OVER (PARTITION BY symbol ORDER BY no) AS v1, lag(high,
 2) OVER (PARTITION BY symbol ORDER BY no) AS v2 FROM x WHERE n = 7 AND high = mh),
ls AS (SELECT symbol, no, low AS v, row_number() OVER (PARTITION BY symbol ORDER BY no) AS k, lag(low) OVER (PARTITION BY symbol ORDER BY no) AS v1, lag(low,
 2) OVER (PARTITION BY symbol ORDER BY no) AS v2 FROM x WHERE n = 7 AND low = ml),
z AS (SELECT x.symbol, x.bar_ts, h.v AS h0, CAST(h.v > h.v1 AS INT) + CAST(h.v1 > h.v2 AS INT) + CAST(l.v > l.v1 AS INT) + CAST(l.v1 > l.v2 AS INT) AS up,
 CAST(h.v < h.v1 AS INT) + CAST(h.v1 < h.v2 AS INT) + CAST(l.v < l.v1 AS INT) + CAST(l.v1 < l.v2 AS INT) AS down
 FROM x ASOF LEFT JOIN (SELECT * FROM hs WHERE k >= 4) h ON h.symbol = x.symbol AND x.no >= h.no ASOF LEFT JOIN (SELECT * FROM ls
 WHERE k >= 4) l ON l.symbol = x.symbol AND x.no >= l.no)"""


@query(_SWING + """ SELECT symbol, bar_ts, CASE WHEN up > down THEN 1.0E0 WHEN down > up THEN -1.0E0 ELSE 0.0E0 END AS structure_bias,
 CASE WHEN up IS NULL THEN 0.0E0 WHEN up >= 3 AND down <= 1 THEN up / 4.0E0 WHEN down >= 3 AND up <= 1 THEN down / 4.0E0 ELSE abs(up - down) / 4.0E0 END AS structure_conf FROM z""")
def w16_structure_bias(spark, d):
    return s.structure_bias(bars(spark, d)).select("symbol", "bar_ts", "structure_bias", "structure_conf")


_ET = "CAST(extract(hour FROM timezone('America/New_York', timezone('UTC', bar_ts))) AS INT)"
_BLOCKS = f""", se AS (SELECT *, {_SESSION} AS session FROM (SELECT *, {_ET} AS h FROM bars)), sc AS (SELECT *, CASE WHEN session IS DISTINCT
 FROM lag(session) OVER ({_O}) THEN 1 ELSE 0 END AS c FROM se),
sr AS (SELECT *, sum(c) OVER ({_O}) AS run FROM sc), bl AS (SELECT symbol, timeframe, run, session, max(high) AS high, min(low) AS low, min(bar_ts) AS begins,
 max(bar_ts) AS ends FROM sr WHERE session <> 'Off-Hours' GROUP BY ALL)"""


@query(_BLOCKS + " SELECT symbol, timeframe, session, high, low, begins, ends FROM bl")
def w18_session_blocks(spark, d):
    return se.session_blocks(bars(spark, d))


def _levels_sql(source: str, name: str, first: int, last: int, sessions: int) -> str:
    """CTEs {name}3: source with {name}_high and {name}_low."""
    return f"""{name}0 AS (SELECT *, {_ET} BETWEEN {first} AND {last - 1} AS i FROM {source}), {name}1 AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(li,
 false) THEN 1 ELSE 0 END) OVER ({_O}) AS s FROM (SELECT *, lag(i) OVER ({_O}) AS li FROM {name}0)),
{name}2 AS (SELECT symbol, timeframe, s, max(max(high)) OVER w AS h, min(min(low)) OVER w AS l FROM {name}1 WHERE i GROUP BY symbol, timeframe, s
 WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY s ROWS BETWEEN {sessions - 1} PRECEDING AND CURRENT ROW)),
{name}3 AS (SELECT a.* EXCLUDE (i, li, s), CASE WHEN NOT i THEN h END AS {name}_high, CASE WHEN NOT i THEN l END AS {name}_low FROM {name}1 a LEFT
 JOIN {name}2 b USING (symbol, timeframe, s))"""


@query(", " + _levels_sql("bars", "asia", 19, 24, 3) + " SELECT symbol, bar_ts, asia_high, asia_low FROM asia3")
def w17_session_levels(spark, d):
    return se.session_levels(bars(spark, d), 19, 24, sessions=3, name="asia").select("symbol", "bar_ts", "asia_high", "asia_low")


def _swept(name: str, side: str) -> str:
    x = f"{name}_{side}"
    hit = f"low < {x} - {x} * 0.002E0 AND close > {x} AND pl >= {x} * (1 - 0.002E0)" if side == "low" else f"high > {x} + {x} * 0.002E0 AND close < {x} AND ph <= {x} * (1 + 0.002E0)"
    return f"WHEN {x} > 0 AND {hit} THEN {{'level': '{x}', 'price': {x}}}"


@query(", " + ", ".join([_levels_sql("bars", "asia", 19, 24, 1), _levels_sql("asia3", "london", 2, 8, 1), _levels_sql("london3", "new_york", 8, 16, 1)]) + f""",
p AS (SELECT *, coalesce(lag(low) OVER ({_O}), low) AS pl, coalesce(lag(high) OVER ({_O}), high) AS ph FROM new_york3), q AS (SELECT symbol, bar_ts,
 CASE {" ".join(_swept(n, x) for n, _, _ in se.LEVELS for x in ("low", "high"))} END AS hit FROM p)
SELECT symbol, bar_ts, hit.level AS level, hit.price AS swept_price FROM q WHERE hit IS NOT NULL""")
def p11_session_sweeps(spark, d):
    return se.session_sweeps(bars(spark, d)).select("symbol", "bar_ts", "level", "swept_price")


@query(_BLOCKS + """ SELECT symbol, session, ends, (SELECT min(bar_ts) FROM bars b
 WHERE b.symbol = bl.symbol AND b.bar_ts > ends AND CAST(b.bar_ts AS DATE) <= CAST(ends AS DATE) + 5 AND b.high > bl.high) AS high_swept,
 (SELECT min(bar_ts) FROM bars b WHERE b.symbol = bl.symbol AND b.bar_ts > ends AND CAST(b.bar_ts AS DATE) <= CAST(ends AS DATE) + 5 AND b.low < bl.low) AS low_swept FROM bl""")
def p12_first_sweeps(spark, d):
    return se.first_sweeps(bars(spark, d)).select("symbol", "session", "ends", "high_swept", "low_swept")


@query(f""", x AS (SELECT *, count(close) OVER w AS n, list(close) OVER w AS l FROM bars WINDOW w AS ({_O} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT symbol, bar_ts, CASE WHEN n >= 50 THEN round((len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0E0) / n + 1.37E-7, 4) END AS rank_share FROM x""")
def w9_average_rank(spark, d):
    return bars(spark, d).select("symbol", "bar_ts", rounded(s.average_rank("close", 100)).alias("rank_share"))


@query(""", RECURSIVE_MARK h4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', bar_ts, TIMESTAMP '1970-01-01') AS ts, max_by(close, bar_ts) AS close FROM bars GROUP BY 1, 2), hn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS no FROM h4),
 he AS (SELECT symbol, no, ts, close AS y FROM hn WHERE no = 1 UNION ALL SELECT b.symbol, b.no, b.ts, (49.0E0 / 51) * e.y + (2.0E0 / 51) * b.close FROM he e JOIN hn b ON b.symbol = e.symbol AND b.no = e.no + 1)
SELECT b.symbol, b.bar_ts, round(he.y + 1.37E-7, 4) + 0.0E0 AS htf_ema_50 FROM bars b ASOF LEFT JOIN he ON he.symbol = b.symbol AND b.bar_ts >= he.ts""")
def j2_htf_ema(spark, d):
    """The mean of 4-hour closes on every hourly bar, from the label of its 4-hour bar on."""
    b = bars(spark, d)
    long = s.ewm(s.resample(b, "hour", 4).withColumn("timeframe", F.lit("4h")), {"htf_ema_50": ("close", 2 / 51)}).select("symbol", F.col("bar_ts").alias("ts"), "htf_ema_50")
    return joins.asof(b, long, keys={"symbol": "symbol"}, left_time="bar_ts", right_time="ts", columns=["htf_ema_50"]).select("symbol", "bar_ts", *_r("htf_ema_50"))


@query(_IND + f""", x AS (SELECT *, CASE WHEN close <> 0 THEN atr / close ELSE atr * CAST('Infinity' AS DOUBLE) END AS pct, CASE WHEN close > 0 THEN atr / close ELSE 0 END AS own FROM ind),
y AS (SELECT *, avg(pct) OVER ({_O} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS mean FROM x),
z AS (SELECT symbol, bar_ts, CASE WHEN no <= 50 THEN 'unknown' WHEN own > 1.8E0 * mean THEN 'volatile' WHEN adx > 30 AND close > ema_50 THEN 'trending_up' WHEN adx > 30 THEN 'trending_down' ELSE 'ranging' END AS bar_regime FROM y)
SELECT strategy, coalesce(bar_regime, 'unknown') AS bar_regime, count(*) AS n, round(avg(CASE WHEN outcome LIKE '%win%' THEN 1.0E0 ELSE 0 END) + 1.37E-7, 4) AS win_rate, round(avg(r_multiple) + 1.37E-7, 4) + 0.0E0 AS mean_r, round(sum(r_multiple) + 1.37E-7, 4) + 0.0E0 AS total_r
FROM trades t ASOF LEFT JOIN z ON z.symbol = t.strategy AND t.entry_time >= z.bar_ts GROUP BY 1, 2""")
def a21_regime_at_entry(spark, d):
    """Trades by the regime of the last bar at their entry."""
    df = s.indicators(bars(spark, d))
    regimes = df.select("symbol", "bar_ts", s.regime(df).alias("bar_regime"))
    own = joins.asof(trades(spark, d), regimes, keys={"strategy": "symbol"}, left_time="entry_time", right_time="bar_ts", columns=["bar_regime"])
    r = F.col("r_multiple")
    return own.groupBy("strategy", F.coalesce("bar_regime", F.lit("unknown")).alias("bar_regime")).agg(F.count("*").alias("n"), rounded(F.avg(F.col("outcome").contains("win").cast("double"))).alias("win_rate"), rounded(F.avg(r)).alias("mean_r"), rounded(F.sum(r)).alias("total_r"))


#: Bars with every fault that validation mends, made from the hour of the day.
_MESSY = """SELECT symbol, timeframe, bar_ts, CASE WHEN hour(bar_ts) = 3 THEN NULL WHEN hour(bar_ts) = 5 THEN CAST('NaN' AS DOUBLE) ELSE open END AS open,
 CASE WHEN hour(bar_ts) = 7 THEN CAST('Infinity' AS DOUBLE) WHEN hour(bar_ts) = 8 THEN low ELSE high END AS high, low, close,
 CASE WHEN hour(bar_ts) = 9 THEN NULL WHEN hour(bar_ts) = 11 THEN -volume ELSE volume END AS volume, 1 AS seq FROM {bars}
UNION ALL SELECT symbol, timeframe, bar_ts, open + 1, high + 2, low, close + 1, volume, 2 AS seq FROM {bars} WHERE hour(bar_ts) = 13"""
_FILL = f""", m AS ({_MESSY.replace("{bars}", "bars")}), u AS (SELECT *, CASE WHEN isfinite(open) THEN open END AS o1, CASE WHEN isfinite(high) THEN high END AS h1 FROM m),
f AS (SELECT *, coalesce(o1, last_value(o1 IGNORE NULLS) OVER b, first_value(o1 IGNORE NULLS) OVER a) AS o, coalesce(h1, last_value(h1 IGNORE NULLS) OVER b,
 first_value(h1 IGNORE NULLS) OVER a) AS h, lead(bar_ts) OVER w IS NOT DISTINCT FROM bar_ts AS again
 FROM u WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts, seq), b AS (PARTITION BY symbol ORDER BY bar_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 a AS (PARTITION BY symbol ORDER BY bar_ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, epoch(bar_ts) - lag(epoch(bar_ts)) OVER ({_O}) AS step FROM f WHERE NOT again), md AS (SELECT symbol, quantile_cont(step, 0.5) AS median FROM k GROUP BY symbol),
gp AS (SELECT k.*, coalesce(step > 3 * median AND median > 0, false) AS gap FROM k JOIN md USING (symbol))"""


@query(_FILL + " SELECT symbol, bar_ts, o AS open, greatest(h, o, close) AS high, least(low, o, close) AS low, close, abs(coalesce(volume, 0)) AS volume, gap FROM gp")
def p1_validated(spark, d):
    messy = spark.sql(_MESSY, bars=bars(spark, d))
    return s.validated(messy, arrival="seq").select("symbol", "bar_ts", "open", "high", "low", "close", "volume", "gap")


@query(_FILL + """, c AS (SELECT symbol, timeframe, CAST(sum(CASE WHEN open IS NULL OR isnan(open) THEN 1 ELSE 0 END) AS BIGINT) AS missing,
 CAST(sum(CASE WHEN isinf(high) THEN 1 ELSE 0 END) AS BIGINT) AS infinite,
 CAST(sum(CASE WHEN volume IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_volume, CAST(sum(CASE WHEN volume < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_volume,
 CAST(sum(CASE WHEN h < greatest(o, close) THEN 1 ELSE 0 END) AS BIGINT) AS low_highs,
 CAST(sum(CASE WHEN low > least(o, close) THEN 1 ELSE 0 END) AS BIGINT) AS high_lows, CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM f
 GROUP BY symbol, timeframe),
g AS (SELECT symbol, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM gp GROUP BY symbol)
SELECT c.*, gaps, missing + infinite + missing_volume + negative_volume + low_highs + high_lows + repeated + gaps AS issues FROM c JOIN g USING (symbol)""")
def p1_issues(spark, d):
    return s.bar_issues(spark.sql(_MESSY, bars=bars(spark, d)), arrival="seq")


@query(f", {_GAP}, z AS (SELECT *, min(low) OVER w AS ll, max(high) OVER w AS lh FROM f WINDOW w AS ({_O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), "
       "q AS (SELECT *, greatest(0.0E0, least(1.0E0, coalesce(CASE kind WHEN 'bullish' THEN top - ll ELSE lh - bottom END / (top - bottom), 0))) AS share FROM z WHERE kind IS NOT NULL) "
       "SELECT symbol, bar_ts, kind, round(share + 1.37E-7, 4) AS fill_share, share >= 1 AS filled, round(bottom + 0.3E0 * (top - bottom) + 1.37E-7, 4) AS zone_low, round(bottom + 0.7E0 * (top - bottom) + 1.37E-7, 4) AS zone_high FROM q")
def p7_gap_fills(spark, d):
    return s.gap_fills(bars(spark, d)).select("symbol", "bar_ts", "kind", rounded(F.col("fill_share")).alias("fill_share"), "filled", *_r("zone_low", "zone_high"))


_HTF = "SELECT symbol, '{tag}' AS htf, {bucket} AS bar_ts, min_by(open, bar_ts) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_ts) AS close FROM bars GROUP BY ALL"
_OH = "PARTITION BY symbol, htf ORDER BY bar_ts"


@query(", hb AS (" + " UNION ALL ".join(_HTF.format(tag=f"{n}h", bucket=f"time_bucket(INTERVAL '{n} hours', bar_ts, TIMESTAMP '1970-01-01')") for n in (2, 4)) + f"""),
x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close) OVER w AS m, min(low) OVER f AS ll, max(high) OVER f AS lh FROM hb
 WINDOW w AS ({_OH}), f AS ({_OH} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN low > h2 AND (low - h2) / nullif(m, 0) >= 0.001 THEN 'bullish' WHEN high < l2 AND (l2 - high) / nullif(m, 0) >= 0.001 THEN 'bearish' END AS kind FROM x)
SELECT symbol, htf, CAST(bar_ts AS TIMESTAMP) AS bar_ts, kind, CASE kind WHEN 'bullish' THEN h2 ELSE high END AS bottom, CASE kind WHEN 'bullish' THEN low ELSE l2 END AS top,
 CASE kind WHEN 'bullish' THEN ll IS NULL OR ll > h2 ELSE lh IS NULL OR lh < l2 END AS is_open FROM g WHERE kind IS NOT NULL""")
def p8_gaps_by_timeframe(spark, d):
    return s.gaps_by_timeframe(bars(spark, d), (2, 4))


def _last(n: int) -> str:
    return f"OVER ({_O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(_IND + f""", s0 AS (SELECT *, no - 1 AS i, lag(close) OVER ({_O}) AS lc, lag(close, 5) OVER ({_O}) AS c5,
 coalesce(CAST(sign(close - lag(close) OVER ({_O})) AS INT), 0) AS sg FROM ind),
s1 AS (SELECT *, CASE WHEN close > 0 AND lc > 0 THEN ln(close / lc) END AS r, CASE WHEN lag(sg) OVER ({_O}) IS NULL OR sg <> lag(sg) OVER ({_O}) THEN 1 ELSE 0 END AS cut FROM s0),
s2 AS (SELECT *, sum(cut) OVER ({_O}) AS run, CASE WHEN count(r) {_last(5)} = 5 THEN stddev_samp(r) {_last(5)} END AS v5 FROM s1),
s3 AS (SELECT *, sg * row_number() OVER (PARTITION BY symbol, run ORDER BY no) AS streak, list(atr) {_last(20)} AS a20, list(atr) {_last(100)} AS a100,
 count(rsi) OVER p = 19 AS known, max(close) OVER p AS pc, min(close) OVER p AS qc, max(rsi) OVER p AS pr, min(rsi) OVER p AS qr,
 CASE WHEN no >= 20 THEN avg(volume) {_last(20)} END AS sma, avg(volume) {_last(5)} AS m5, (2 * volume + lag(volume) OVER ({_O}) - lag(volume,
 3) OVER ({_O}) - 2 * lag(volume, 4) OVER ({_O})) / 10 AS slope,
 CASE WHEN count(atr) {_last(20)} = 20 THEN avg(atr) {_last(20)} END AS ma, max(high) {_last(20)} AS h20, min(low) {_last(20)} AS l20, max(high) {_last(50)} AS h50,
 min(low) {_last(50)} AS l50,
 CASE WHEN count(r) {_last(20)} = 20 THEN stddev_samp(r) {_last(20)} END AS rv, CASE WHEN count(v5) {_last(20)} = 20 THEN stddev_samp(v5) {_last(20)} END AS vv
 FROM s2 WINDOW p AS ({_O} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
t AS (SELECT symbol, bar_ts, CASE WHEN i >= 20 THEN len(list_filter(a20, lambda v: v <= atr)) / 20.0E0 END AS atr_percentile_20,
 CASE WHEN i >= 100 THEN len(list_filter(a100, lambda v: v <= atr)) / 100.0E0 END AS atr_percentile_100,
 CASE WHEN i >= 21 THEN rv END AS realized_vol_20, CASE WHEN i >= 30 THEN vv END AS vol_of_vol,
 CASE WHEN i >= 20 THEN CASE WHEN ma > 0 THEN atr / ma ELSE 1 END END AS atr_ratio, adx - lag(adx, 5) OVER ({_O}) AS adx_slope_5,
 CASE WHEN i >= 20 THEN CASE WHEN close >= pc AND NOT coalesce(known AND rsi >= pr, false) THEN -1 WHEN close <= qc AND NOT coalesce(known AND rsi <= qr,
 false) THEN 1 ELSE 0 END END AS rsi_divergence, greatest(-20, least(20, streak)) AS candle_streak,
 coalesce((close - low) / nullif(high - low, 0), 0.5E0) AS close_vs_range, CASE WHEN c5 > 0 THEN close / c5 - 1 END AS momentum_5,
 CASE WHEN sma > 0 THEN volume / sma WHEN i >= 20 THEN 1 END AS relative_volume,
 CASE WHEN i >= 5 THEN CASE WHEN m5 > 0 THEN slope / m5 ELSE 0 END END AS volume_trend_5, CASE WHEN i >= 1 THEN CASE WHEN coalesce(volume > 1.2E0 * sma,
 false) AND (close > lc) = (ema_50 > ema_200) THEN 1 ELSE 0 END END AS volume_price_confirm,
 CASE WHEN i >= 20 AND atr > 0 THEN (h20 - close) / atr END AS dist_from_high_20, CASE WHEN i >= 20 AND atr > 0 THEN (close - l20) / atr END AS dist_from_low_20,
 CASE WHEN close > ema_20 THEN 1 ELSE -1 END + CASE WHEN ema_20 > ema_50 THEN 1 ELSE -1 END + CASE WHEN ema_50 > ema_200 THEN 1 ELSE -1 END AS ema_alignment,
 CASE WHEN atr > 0 THEN (close - ema_200) / atr END AS price_vs_ema200,
 CASE WHEN i >= 50 THEN coalesce((close - l50) / nullif(h50 - l50, 0), 0.5E0) END AS range_position FROM s3)
SELECT symbol, bar_ts, {_round_sql(*market.FEATURES)} FROM t""")
def w30_market_features(spark, d):
    return market.market_features(s.indicators(bars(spark, d))).select("symbol", "bar_ts", *_r(*market.FEATURES))


@query(""", ab AS (SELECT a.timeframe, a.bar_ts, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.bar_ts = b.bar_ts AND a.symbol = 'click' AND b.symbol = 'view'),
l AS (SELECT *, lag(a) OVER w AS la, lag(b) OVER w AS lb, lag(a, 5) OVER w AS a5, lag(b, 5) OVER w AS b5 FROM ab WINDOW w AS (PARTITION BY timeframe ORDER BY bar_ts)),
r AS (SELECT *, CASE WHEN a > 0 AND la > 0 THEN ln(a / la) END AS ra, CASE WHEN b > 0 AND lb > 0 THEN ln(b / lb) END AS rb FROM l)
SELECT timeframe, bar_ts, CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER f = 20 THEN round(corr(ra, rb) OVER f + 1.37E-7,
 4) + 0.0E0 END AS rolling_corr,
 round(CASE WHEN a5 > 0 THEN a / a5 - 1 END - CASE WHEN b5 > 0 THEN b / b5 - 1 END + 1.37E-7, 4) + 0.0E0 AS divergence FROM r WINDOW f AS (PARTITION BY timeframe
 ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w29_cross_asset(spark, d):
    """Two symbols of the reference's kind (a main and another asset) are parameters; the query takes click and view."""
    return market.cross_asset(bars(spark, d), "click", "view").select("timeframe", "bar_ts", *_r("rolling_corr", "divergence"))


@query(", n AS (SELECT symbol, timeframe, count(*) AS b FROM bars GROUP BY ALL) SELECT symbol, timeframe, CAST(i AS INT) AS \"window\""", i * 50 AS train_start, i * 50 + 200 AS train_end, i * 50 + 210 AS test_start, i * 50 + 260 AS test_end FROM n, LATERAL (SELECT unnest(range(0, (b - 260) // 50 + 1)) AS i) WHERE b >= 260""")
def m3_windows(spark, d):
    return sim.windows(bars(spark, d), train=200, test=50, step=50, embargo=10)


@query(None)
def m1_trade_walk(spark, d):
    b = bars(spark, d)
    out = sim.walk(b, sim.sweep_signals(b))
    return out.select("symbol", "entry_time", "exit_time", "direction", "outcome", "bars_held", *_r("r_multiple", "mfe", "mae"))


@query(None)
def m4_walk_forward(spark, d):
    grid = [{"back": n, "reward": (1.0, r)} for n in (10, 20) for r in (1.5, 2.0)]
    return sim.walk_forward(bars(spark, d), grid, train=300, test=100, step=100, embargo=20)


@query(" SELECT symbol, timeframe, count(*) AS n_bars, min(bar_ts) AS first_bar, max(bar_ts) AS last_bar FROM bars GROUP BY symbol, timeframe")
def s16_coverage(spark, d):
    return bars(spark, d).groupBy("symbol", "timeframe").agg(F.count("*").alias("n_bars"), F.min("bar_ts").alias("first_bar"), F.max("bar_ts").alias("last_bar"))


@query(" SELECT * FROM (SELECT symbol, bar_ts, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS n FROM bars) WHERE n <= 100")
def s5_latest_bars(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ts"))).cast("long")
    return bars(spark, d).select("symbol", "bar_ts", "close", n.alias("n")).where("n <= 100")
