"""Queries over parameter sets: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import tuning as t
from .trade_queries import query
from .views import trades

SETS = [{"max_hold": 10}, {"max_hold": 20}, {"max_hold": 40}, {"min_mfe": 0.2}, {"min_mfe": 0.4, "max_hold": 20}, {"min_mfe": 0.4, "max_hold": 40}]
_SETS = ", ".join(f"({i}, {float(s['max_hold']) if 'max_hold' in s else 'NULL'}, {float(s['min_mfe']) if 'min_mfe' in s else 'NULL'})" for i, s in enumerate(SETS))
_PASSED = f""", se AS (SELECT no, CAST(h AS DOUBLE) AS h, CAST(m AS DOUBLE) AS m FROM (VALUES {_SETS}) v(no, h, m)),
pa AS (SELECT t.*, no, h, m, CAST(CAST(date_trunc('week', exit_time) AS DATE) AS VARCHAR) AS wk FROM trades t JOIN se ON coalesce(bars_held <= h, true) AND coalesce(mfe >= m, true))"""
_AVG = "coalesce(avg(r_multiple) FILTER (r_multiple {}), 0)"
_WIN = "avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END)"
_EXPECT = f"{_WIN} * {_AVG.format('> 0')} + (1 - {_WIN}) * {_AVG.format('<= 0')}"
_BEST = _PASSED + f""", sc AS (SELECT strategy, wk, no, h, m, count(*) AS n, {_EXPECT} AS s FROM pa GROUP BY ALL HAVING count(*) > 1),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY strategy, wk ORDER BY round(s + 1.37E-7, 9) DESC, no) = 1),
lo AS (SELECT strategy, wk, 'max_hold' AS parameter, h AS value FROM be WHERE h IS NOT NULL UNION ALL SELECT strategy, wk, 'min_mfe', m FROM be WHERE m IS NOT NULL)"""


def _passed(spark, d):
    week = F.to_date(F.date_trunc("week", F.col("exit_time").cast("timestamp_ntz"))).cast("string")
    passes = lambda p: F.coalesce(F.col("bars_held") <= p["max_hold"], F.lit(True)) & F.coalesce(F.col("mfe") >= p["min_mfe"], F.lit(True))
    return t.by_sets(trades(spark, d).withColumn("window", week), SETS, passes)


def _best(spark, d):
    return t.best_sets(_passed(spark, d), ["strategy", "window"])


@query(_PASSED + f""" SELECT strategy, no AS set_no, count(*) AS n, round({_EXPECT} + 1.37E-7, 4) + 0.0E0 AS expectancy,
 round(sum(CASE WHEN r_multiple > 0 THEN r_multiple ELSE 0 END) / abs(sum(CASE WHEN r_multiple < 0 THEN r_multiple END)) + 1.37E-7, 4) + 0.0E0 AS profit_factor,
 round(avg(r_multiple) / stddev_samp(r_multiple) + 1.37E-7, 4) + 0.0E0 AS sharpe, round(sum(r_multiple) + 1.37E-7, 4) + 0.0E0 AS total_r FROM pa GROUP BY strategy, no""")
def m5_set_scores(spark, d):
    return _passed(spark, d).groupBy("strategy", "set_no").agg(F.count("*").alias("n"), *[rounded(t.score(m)).alias(m) for m in t.METRICS])


@query(_BEST + """ SELECT strategy, wk AS "window", no AS set_no, n, round(s + 1.37E-7, 4) + 0.0E0 AS score FROM be""")
def m5_best_sets(spark, d):
    return _best(spark, d).select("strategy", "window", "set_no", "n", rounded(F.col("score")).alias("score"))


@query(_BEST + """, g AS (SELECT DISTINCT a.strategy, a.wk, b.parameter FROM be a JOIN lo b ON b.strategy = a.strategy), v AS (SELECT g.*, value FROM g LEFT JOIN lo USING (strategy, wk, parameter)),
x AS (SELECT *, min(value) OVER p AS a, max(value) OVER p AS b FROM v WINDOW p AS (PARTITION BY strategy, parameter))
SELECT strategy, parameter, wk AS "window", value, CASE WHEN value IS NULL THEN NULL WHEN b > a THEN round((value - a) / (b - a) + 1.37E-7, 4) + 0.0E0 ELSE 0.5E0 END AS place FROM x""")
def v1_parameter_matrix(spark, d):
    return t.parameter_matrix(_best(spark, d)).withColumn("place", F.when(F.col("place") == 0.5, 0.5).otherwise(rounded(F.col("place"))))


@query(_BEST + """, la AS (SELECT * FROM be QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY wk DESC) = 1),
n AS (SELECT DISTINCT parameter FROM lo JOIN la USING (strategy, wk))
SELECT la.strategy, n.parameter, coalesce(CASE parameter WHEN 'max_hold' THEN h ELSE m END, 0.0E0) AS value FROM la CROSS JOIN n WHERE (SELECT count(*) FROM la) > 1""")
def v2_latest_parameters(spark, d):
    return t.latest_parameters(_best(spark, d))


@query(" SELECT trade_id, strategy, r_multiple FROM trades ORDER BY md5('42:' || trade_id), trade_id LIMIT 500")
def l6_sampled_trades(spark, d):
    """500 trades at random, as its feature."""
    return t.sampled(trades(spark, d).select("trade_id", "strategy", "r_multiple"), 500, "trade_id")
