"""Queries over filter predictions: id_name -> (query, oracle SQL).

Predictions are made of trades: the chance is mfe / (mfe + mae), the threshold 0.3 to 0.5 by trade, and every ninth trade has no outcome yet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import filters as f
from .trade_queries import query
from .views import trades

_P = """, pr AS (SELECT trade_id, strategy, entry_time AS prediction_ts, round(mfe / (mfe + mae), 2) AS predicted_prob, 0.3E0 + CAST(bars_held % 3 AS DOUBLE) / 10 AS threshold,
 round(mfe / (mfe + mae), 2) < 0.3E0 + CAST(bars_held % 3 AS DOUBLE) / 10 AS was_filtered,
 CASE WHEN bars_held % 9 = 0 THEN NULL WHEN outcome LIKE '%win%' THEN 'win' WHEN outcome = 'breakeven' THEN 'breakeven' ELSE 'loss' END AS actual_outcome,
 r_multiple, pnl_usd FROM trades), k AS (SELECT *, actual_outcome = 'win' AS won, was_filtered <> (actual_outcome = 'win') AS good FROM pr WHERE actual_outcome IS NOT NULL)"""


def _predictions(spark, d):
    p, t = F.round(F.col("mfe") / (F.col("mfe") + F.col("mae")), 2), F.lit(0.3) + (F.col("bars_held") % 3).cast("double") / 10
    outcome = F.when(F.col("bars_held") % 9 == 0, None).when(F.col("outcome").contains("win"), "win").when(F.col("outcome") == "breakeven", "breakeven").otherwise("loss")
    return trades(spark, d).select("trade_id", "strategy", F.col("entry_time").alias("prediction_ts"), p.alias("predicted_prob"), t.alias("threshold"),
        (p < t).alias("was_filtered"), outcome.alias("actual_outcome"), "r_multiple", "pnl_usd")


def _known(spark, d):
    return _predictions(spark, d).where("actual_outcome IS NOT NULL")


@query(_P + """ SELECT count(*) AS logged, CAST(sum(CAST(was_filtered AS INT)) AS BIGINT) AS blocked,
 CAST(count(*) - sum(CAST(was_filtered AS INT)) AS BIGINT) AS passed, count(actual_outcome) AS reconciled, round(count(actual_outcome) / count(*) + 1.37E-7,
 4) AS reconciled_share FROM pr""")
def q2_filter_counts(spark, d):
    return f.filter_counts(_predictions(spark, d))


_QUALITY = """count(*) AS n, round(avg(CAST(good AS INT)) + 1.37E-7, 4) AS accuracy,
 round(coalesce(sum(CASE WHEN was_filtered AND NOT won THEN 1 ELSE 0 END) / nullif(sum(CAST(was_filtered AS INT)), 0), 0) + 1.37E-7, 4) AS precision,
 round(coalesce(sum(CASE WHEN was_filtered AND NOT won THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN won THEN 0 ELSE 1 END), 0), 0) + 1.37E-7, 4) AS recall,
 round(avg(pow(predicted_prob - CAST(won AS INT), 2)) + 1.37E-7, 4) AS brier_score,
 coalesce(sum(CASE WHEN was_filtered AND NOT won AND pnl_usd < 0 THEN -pnl_usd END), 0) AS su,
 coalesce(sum(CASE WHEN was_filtered AND won AND pnl_usd > 0 THEN pnl_usd END), 0) AS mu,
 coalesce(sum(CASE WHEN was_filtered AND NOT won AND r_multiple < 0 THEN -r_multiple END), 0) AS sr,
 coalesce(sum(CASE WHEN was_filtered AND won AND r_multiple > 0 THEN r_multiple END), 0) AS mr"""


@query(_P + f""", q AS (SELECT strategy, {_QUALITY} FROM k GROUP BY strategy) SELECT strategy, n, accuracy, precision, recall, brier_score, round(su + 1.37E-7,
 2) + 0.0E0 AS saved_usd, round(mu + 1.37E-7, 2) + 0.0E0 AS missed_usd, round(su - mu + 1.37E-7, 2) + 0.0E0 AS net_usd, round(sr + 1.37E-7, 4) + 0.0E0 AS saved_r,
 round(mr + 1.37E-7, 4) + 0.0E0 AS missed_r, round(sr - mr + 1.37E-7, 4) + 0.0E0 AS net_r FROM q""")
def q6_filter_value(spark, d):
    return f.filter_quality(_known(spark, d), "strategy")


@query(_P + """, c AS (SELECT CAST(least(floor(predicted_prob * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(predicted_prob) + 1.37E-7, 4) AS mean_prob,
 round(avg(CAST(won AS INT)) + 1.37E-7, 4) AS win_rate FROM k GROUP BY 1) SELECT CAST(g.i AS INT) AS bin, coalesce(n, 0) AS n, mean_prob, win_rate
 FROM (SELECT unnest(range(10)) AS i) g LEFT JOIN c ON c.bin = g.i""")
def q4_calibration(spark, d):
    return f.calibration(_known(spark, d))


_ROC = """, pp AS (SELECT predicted_prob, sum(CAST(won AS INT)) AS pos, sum(CASE WHEN won THEN 0 ELSE 1 END) AS neg FROM k GROUP BY 1), cc AS (SELECT *,
 sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM pp WINDOW w AS (ORDER BY predicted_prob DESC))"""


@query(_P + _ROC + " SELECT predicted_prob, round(cp / tp + 1.37E-7, 4) AS tpr, round(cn / tn + 1.37E-7, 4) AS fpr, round(cp / (cp + cn) + 1.37E-7, 4) AS precision FROM cc")
def q5_roc_points(spark, d):
    return f.roc_points(_known(spark, d)).select("predicted_prob", *[rounded(F.col(c)).alias(c) for c in ("tpr", "fpr", "precision")])


@query(_P + _ROC + " SELECT round(sum(neg * (cp - pos / 2.0E0)) / max(tp * tn) + 1.37E-7, 4) AS roc_auc, round(sum(pos / tp * (cp / (cp + cn))) + 1.37E-7, 4) AS pr_auc FROM cc")
def q3_areas(spark, d):
    return f.areas(_known(spark, d))


@query(_P + " SELECT CAST(least(floor(predicted_prob * 20), 19) AS INT) AS bin, actual_outcome, count(*) AS n FROM k GROUP BY ALL")
def q7_histogram(spark, d):
    return f.histogram(_known(spark, d))


@query(_P + ", c AS (SELECT threshold, count(*) AS n FROM k GROUP BY threshold) SELECT threshold, n FROM c ORDER BY n DESC, threshold LIMIT 1")
def q7_modal_threshold(spark, d):
    return f.modal_threshold(_known(spark, d))


@query(_P + """ SELECT strategy, prediction_ts, CASE WHEN count(*) OVER w >= 10 THEN round(avg(CAST(good AS INT)) OVER w + 1.37E-7, 4) END AS rolling_accuracy FROM k
 WINDOW w AS (PARTITION BY strategy ORDER BY prediction_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def q8_rolling_accuracy(spark, d):
    return f.rolling_accuracy(_known(spark, d)).withColumn("rolling_accuracy", rounded(F.col("rolling_accuracy")))


@query(_P + """, n AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY prediction_ts DESC) AS n FROM k), l AS (SELECT strategy, count(*) AS n,
 avg(CAST(good AS INT)) AS a, avg(CASE WHEN n <= 15 THEN CAST(good AS INT) END) AS late, avg(CASE WHEN n > 15 THEN CAST(good AS INT) END) AS early FROM n
 WHERE n <= 30 GROUP BY strategy)
SELECT strategy, n, round(a + 1.37E-7, 4) AS accuracy, CASE WHEN late - early > 0.05 THEN 'improving' WHEN early - late > 0.05 THEN 'degrading' ELSE 'stable' END AS trend, a < 0.5 AS drifting FROM l""")
def q8_drift(spark, d):
    return f.drift(_known(spark, d))


@query(_P + f""", q AS (SELECT {_QUALITY} FROM k) SELECT n, accuracy, round(su - mu + 1.37E-7, 2) + 0.0E0 AS net_usd, round(sr - mr + 1.37E-7, 4) + 0.0E0 AS net_r,
 CASE WHEN n < 30 THEN 'insufficient' WHEN accuracy >= 0.55 AND su - mu > 0 THEN 'edge' ELSE 'no edge' END AS verdict FROM q""")
def q8_verdict(spark, d):
    return f.verdict(_known(spark, d))
