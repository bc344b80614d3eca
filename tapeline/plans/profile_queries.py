"""Queries over where an edge lies: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import profiles as p
from .sequence_queries import w38_edge_half_life
from .trade_queries import ORACLE_SQL, query, w39_autocorrelation
from .views import trades

_EDGE = """, eg AS (SELECT strategy, regime, count(*) AS n, avg(r_multiple) AS m, stddev_samp(r_multiple) AS sd, avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END) AS wr,
 avg(CASE WHEN r_multiple > 0 THEN r_multiple END) AS gain, -avg(CASE WHEN r_multiple <= 0 THEN r_multiple END) AS loss FROM trades GROUP BY ALL),
edge AS (SELECT strategy, regime, n, round(n / sum(n) OVER (PARTITION BY strategy) + 1.37E-7, 4) AS share, round(m + 1.37E-7, 4) + 0.0E0 AS mean_r, round(coalesce(sd, 0) + 1.37E-7, 4) + 0.0E0 AS std_r,
 round(wr + 1.37E-7, 4) + 0.0E0 AS win_rate, round(wr * coalesce(gain, 0) - (1 - wr) * coalesce(loss, 0) + 1.37E-7, 4) + 0.0E0 AS expectancy FROM eg)"""
_STEP = """, st AS (SELECT strategy, regime AS from_regime, lead(regime) OVER (PARTITION BY strategy ORDER BY entry_time, trade_id) AS to_regime FROM trades),
ch AS (SELECT strategy, from_regime, to_regime, count(*) AS n FROM st WHERE to_regime IS NOT NULL GROUP BY ALL)"""
_CUTS = " ".join(f"WHEN {m} THEN quantile_cont(bars_held, [{', '.join(repr(k / m) for k in range(m + 1))}])" for m in p.BINS)
_HOLD = f""", qs AS (SELECT strategy, least(8, greatest(3, count(*) // 10)) AS m, min(bars_held) AS a, max(bars_held) AS b, CASE least(8, greatest(3, count(*) // 10)) {_CUTS} END AS q
 FROM trades GROUP BY strategy), ds AS (SELECT *, list_sort(list_distinct(list_transform(q, lambda x: round(x, 6)))) AS own FROM qs),
es AS (SELECT strategy, CASE WHEN len(own) < 3 THEN list_transform(range(0, m + 1), lambda k: a + (b + 1.0E0 - a) * k / m) ELSE own END AS edges FROM ds),
bs AS (SELECT t.*, edges, least(len(list_filter(edges, lambda x: x <= bars_held)), len(edges) - 1) AS bin FROM trades t JOIN es USING (strategy)),
hs AS (SELECT strategy, bin, count(*) AS n, any_value(edges[bin]) AS low, any_value(edges[bin + 1]) AS high, avg(mfe) AS f, avg(abs(mae)) AS a, avg(r_multiple) AS r,
 avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END) AS w FROM bs GROUP BY ALL), hold AS (SELECT strategy, CAST(bin AS INT) AS bin, round(low + 1.37E-7, 1) + 0.0E0 AS low, round(high + 1.37E-7, 1) + 0.0E0 AS high, n,
 round(f + 1.37E-7, 4) + 0.0E0 AS mean_mfe, round(a + 1.37E-7, 4) + 0.0E0 AS mean_mae, round(f / greatest(a, 0.01E0) + 1.37E-7, 4) + 0.0E0 AS mfe_mae_ratio, round(r + 1.37E-7, 4) + 0.0E0 AS mean_r,
 round(w + 1.37E-7, 4) + 0.0E0 AS win_rate, row_number() OVER (PARTITION BY strategy ORDER BY round(f / greatest(a, 0.01E0), 9) DESC, bin) = 1 AS best_ratio,
 row_number() OVER (PARTITION BY strategy ORDER BY round(r, 9) DESC, bin) = 1 AS best_mean FROM hs)"""


@query(_EDGE + " SELECT * FROM edge")
def t16_regime_edge(spark, d):
    return p.regime_edge(trades(spark, d))


@query(_STEP + " SELECT *, round(n / sum(n) OVER (PARTITION BY strategy, from_regime) + 1.37E-7, 6) AS share FROM ch")
def t16_regime_steps(spark, d):
    df = p.regime_steps(trades(spark, d))
    total = df.groupBy("strategy", "from_regime").agg(F.sum("n").alias("_n"))
    return df.join(total, ["strategy", "from_regime"]).select("strategy", "from_regime", "to_regime", "n", rounded(F.col("n") / F.col("_n"), 6).alias("share"))


@query(_STEP.replace(", st AS", ", RECURSIVE_MARK st AS", 1) + """, sh AS (SELECT *, n / sum(n) OVER (PARTITION BY strategy, from_regime) AS share FROM ch),
it AS (SELECT strategy, from_regime AS regime, 1.0E0 / count(*) OVER (PARTITION BY strategy) AS law, 0 AS i FROM (SELECT DISTINCT strategy, from_regime FROM ch)
 UNION ALL SELECT it.strategy, to_regime, sum(law * share), any_value(i) + 1 FROM it JOIN sh ON sh.strategy = it.strategy AND from_regime = regime WHERE i < 60 GROUP BY it.strategy, to_regime)
SELECT strategy, regime, round(law + 1.37E-7, 6) AS law FROM it WHERE i = 60""")
def t16_stationary(spark, d):
    df = p.stationary(p.regime_steps(trades(spark, d)))
    return df.withColumn("law", rounded(F.col("law"), 6))


@query(_HOLD + " SELECT * FROM hold")
def t17_hold_profiles(spark, d):
    return p.hold_profiles(trades(spark, d))


@query(_EDGE + _HOLD + f""", nn AS (SELECT strategy, count(*) AS n FROM trades GROUP BY 1),
ac AS (SELECT a.strategy, arg_max(ljung_box_p, lag) AS p, count(*) FILTER (significant) AS hits FROM ({ORACLE_SQL[w39_autocorrelation.__name__]}) a JOIN nn ON nn.strategy = a.strategy
 WHERE lag <= least(20, greatest(1, n // 3)) GROUP BY 1), hl AS (SELECT strategy, CASE WHEN mean_reverting THEN half_life END AS half FROM ({ORACLE_SQL[w38_edge_half_life.__name__]})),
hb AS (SELECT strategy, max(mean_r) AS best, avg(CASE WHEN mean_r > 0 THEN 1.0E0 ELSE 0 END) AS above, max(mfe_mae_ratio) AS ratio FROM hold GROUP BY 1),
de AS (SELECT hb.strategy, 50 + CASE WHEN best > 0.3 THEN 25 WHEN best > 0.1 THEN 15 WHEN best > 0 THEN 10 WHEN best > -0.05 THEN -10 WHEN best > -0.2 THEN -20 ELSE -30 END
 + CASE WHEN best > 0 AND above > 0.5 THEN 5 ELSE 0 END + CASE WHEN ratio > 2 THEN 5 WHEN ratio < 0.8 THEN -5 ELSE 0 END
 + CASE WHEN p > 0.05 THEN 5 WHEN hits > 3 THEN -10 ELSE -5 END + CASE WHEN half < 20 THEN -10 WHEN half < 50 THEN -5 ELSE 0 END AS s FROM hb JOIN ac USING (strategy) JOIN hl USING (strategy)),
rg AS (SELECT strategy, min(mean_r) AS worst, max(mean_r) AS best, max(n) / sum(n) AS top, arg_max(mean_r, n) AS main FROM (SELECT * FROM edge ORDER BY regime) GROUP BY strategy),
re AS (SELECT strategy, CASE WHEN worst > 0.1 THEN least(95, 85 + worst * 10) WHEN worst > 0 THEN 85 WHEN main > 0 AND top > 0.5 THEN least(80, 65 + CASE WHEN main > 0.2 THEN 10 ELSE 0 END
 - CASE WHEN worst < -0.3 THEN 10 ELSE 0 END) WHEN best > 0 THEN 40 WHEN best > -0.05 THEN 25 ELSE greatest(5, 15 + best * 10) END AS s FROM rg),
sc AS (SELECT strategy, 'signal_decay' AS skill, CAST(greatest(0, least(100, s)) AS DOUBLE) AS score FROM de UNION ALL SELECT strategy, 'regime_edge', CAST(s AS DOUBLE) FROM re)
SELECT strategy, skill, round(score + 1.37E-7, 4) AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END AS grade FROM sc""")
def t18_skill_scores(spark, d):
    """Two of the six skills: signal decay and regime edge."""
    return p.skill_scores(trades(spark, d))
