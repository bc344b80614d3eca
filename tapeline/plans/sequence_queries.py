"""Queries over the order and the timing of trades: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import joins
from ..operators import portfolio as p
from ..operators import sequences as s
from ..operators import timing as t
from .trade_queries import _HOUR_NY, _SESSION, query
from .views import normal_sql, trades

_NO = """, n AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_time) AS no, r_multiple AS r FROM trades)"""
_CUM = _NO + """, c AS (SELECT *, sum(r) OVER (PARTITION BY strategy ORDER BY no) AS cum FROM n), dd AS (SELECT *, max(cum) OVER (PARTITION BY strategy
 ORDER BY no) - cum AS dd FROM c)"""
_RECOVERY = """, fl AS (SELECT *, sum(CASE WHEN dd <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY no) AS fall FROM dd),
 th AS (SELECT unnest([1.0E0, 2.0E0, 5.0E0, 10.0E0]) AS threshold), fa AS (SELECT strategy, threshold, fall, min(no) AS first,
 min(CASE WHEN dd >= threshold THEN no END) AS crossed FROM fl, th GROUP BY ALL),
 nx AS (SELECT *, lead(first) OVER (PARTITION BY strategy, threshold ORDER BY fall) - crossed AS took FROM fa),
 rec AS (SELECT strategy, threshold, count(crossed) AS n, count(took) AS recovered, count(took) / nullif(count(crossed), 0) AS rate, avg(took) AS mean_trades,
 max(took) AS max_trades FROM nx GROUP BY strategy, threshold)"""


@query(_CUM + _RECOVERY + " SELECT strategy, threshold, n, recovered, round(rate + 1.37E-7, 4) AS recovery_rate, round(mean_trades + 1.37E-7, 4) AS mean_trades, max_trades FROM rec")
def w23_recovery(spark, d):
    return s.recovery(trades(spark, d)).withColumn("mean_trades", rounded(F.col("mean_trades")))


def _rolled(n: int) -> str:
    return f"""SELECT strategy, {n} AS "window", list_max(list_transform(range(1, {n} + 1), lambda i: list_max(c[1:i]) - c[i])) AS d FROM (SELECT strategy,
 list_transform(range(1, {n} + 1), lambda i: list_sum(l[1:i])) AS c
 FROM (SELECT strategy, list(r_multiple) OVER (PARTITION BY strategy ORDER BY entry_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l FROM trades) WHERE len(l) = {n})"""


@query(", o AS (" + " UNION ALL ".join(map(_rolled, (10, 20, 50))) + ") SELECT strategy, \"window\", " + ", ".join(f"round(quantile_cont(d, {q / 100}) + 1.37E-7, 4) AS p{q}" for q in (75, 90, 95)) + ", round(max(d) + 1.37E-7, 4) AS max_dd FROM o GROUP BY ALL")
def w21_rolling_drawdown(spark, d):
    from ..operators.trades import rolling_drawdown

    return rolling_drawdown(trades(spark, d), "strategy")


@query(_CUM + _RECOVERY + f""", o AS ({_rolled(20)}), q AS (SELECT strategy, quantile_cont(d, 0.95) AS p95 FROM o GROUP BY strategy), b AS (SELECT strategy,
 count(*) AS n, max(dd) AS max_dd FROM dd GROUP BY strategy),
 ls AS (SELECT *, outcome LIKE '%loss%' AS l, sum(CASE WHEN outcome LIKE '%loss%' THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY entry_time) AS run
 FROM trades), ru AS (SELECT strategy, run, count(*) AS length FROM ls WHERE l GROUP BY ALL),
 st AS (SELECT strategy, CASE WHEN count(*) >= 20 THEN quantile_cont(length, 0.95) ELSE max(length) END AS q FROM ru GROUP BY strategy), cd AS (SELECT strategy,
 mean_trades FROM rec WHERE threshold = 2)
SELECT strategy, n, round(CASE WHEN n >= 20 THEN p95 ELSE max_dd END + 1.37E-7, 2) AS raw_drawdown,
 round(CASE WHEN n >= 20 THEN p95 * 1.1E0 ELSE max_dd * 1.2E0 END + 1.37E-7, 1) AS drawdown_limit, CAST(coalesce(ceil(st.q) + 1, 5) AS BIGINT) AS streak_limit,
 CAST(coalesce(greatest(3, ceil(mean_trades * 0.5E0)), 5) AS BIGINT) AS cooldown,
 CASE WHEN n >= 200 THEN 'high' WHEN n >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM b LEFT JOIN q USING (strategy) LEFT JOIN st USING (strategy) LEFT
 JOIN cd USING (strategy)""")
def t9_calibrated_limits(spark, d):
    return s.calibrated_limits(trades(spark, d))


_KALMAN = "RECURSIVE_MARK " + _NO[2:] + """, df AS (SELECT *, r - lag(r) OVER (PARTITION BY strategy ORDER BY no) AS dl FROM n), v AS (SELECT strategy,
 var_pop(r) AS v, greatest(1e-6, coalesce(var_pop(dl) / 2, 0)) AS q FROM df GROUP BY strategy),
 w AS (SELECT *, CASE WHEN v > 0 THEN greatest(0.1E0 * v, v - q) ELSE 1e-6 END AS rr FROM v),
 k AS (SELECT n.strategy, no, r AS mu, CASE WHEN v > 0 THEN v ELSE 1 END AS p FROM n JOIN w USING (strategy) WHERE no = 1
  UNION ALL SELECT k.strategy, n.no, k.mu + (k.p + w.q) / (k.p + w.q + w.rr) * (n.r - k.mu), (1 - (k.p + w.q) / (k.p + w.q + w.rr)) * (k.p + w.q) FROM k
 JOIN n ON n.strategy = k.strategy AND n.no = k.no + 1 JOIN w ON w.strategy = k.strategy)"""


@query(", " + _KALMAN + " SELECT k.strategy, k.no, round(mu + 1.37E-7, 6) + 0.0E0 AS edge, round(mu - 2 * sqrt(p) + 1.37E-7, 6) + 0.0E0 AS low, round(mu + 2 * sqrt(p) + 1.37E-7, 6) + 0.0E0 AS high FROM k")
def w35_kalman_edge(spark, d):
    return s.kalman_edge(trades(spark, d)).select("strategy", F.col("no").cast("long").alias("no"), *[rounded(F.col(c), 6).alias(c) for c in ("edge", "low", "high")])


@query(", " + _KALMAN + """, z AS (SELECT *, count(*) OVER (PARTITION BY strategy) AS n FROM k), g AS (SELECT strategy, min_by(mu, no) AS a, max_by(mu, no) AS b,
 avg(CASE WHEN mu > 0 THEN 1.0E0 ELSE 0 END) AS up, avg(CASE WHEN no <= greatest(1, n // 4) THEN mu END) AS early,
 avg(CASE WHEN no > n - greatest(1, n // 4) THEN mu END) AS late, stddev_pop(mu) AS sd FROM z GROUP BY strategy)
SELECT strategy, round(a + 1.37E-7, 6) + 0.0E0 AS initial_edge, round(b + 1.37E-7, 6) + 0.0E0 AS final_edge, round(b - a + 1.37E-7, 6) + 0.0E0 AS total_drift,
 round(up + 1.37E-7, 4) AS share_positive,
 CASE WHEN late - early > 0.1E0 * sd THEN 'improving' WHEN early - late > 0.1E0 * sd THEN 'deteriorating' ELSE 'stable' END AS edge_trend FROM g""")
def w35_edge_trend(spark, d):
    return s.edge_trend(s.kalman_edge(trades(spark, d)))


@query(", RECURSIVE_MARK " + _NO[2:] + """, m AS (SELECT strategy, avg(r) AS mu, stddev_samp(r) AS sd FROM n GROUP BY strategy),
 cu AS (SELECT strategy, 1 AS no, 0.0E0 AS up, 0.0E0 AS down, false AS alarm FROM m UNION ALL
  SELECT strategy, no, CASE WHEN a THEN 0 ELSE up END, CASE WHEN a THEN 0 ELSE down END, a FROM (SELECT x.*, up > 5 * sd OR down > 5 * sd AS a FROM
   (SELECT c.strategy, n.no, greatest(0, c.up + n.r - mu - 0.5E0 * sd) AS up, greatest(0, c.down - (n.r - mu + 0.5E0 * sd)) AS down, sd FROM cu c
 JOIN n ON n.strategy = c.strategy AND n.no = c.no + 1 JOIN m ON m.strategy = c.strategy) x)),
 ch AS (SELECT strategy, count(*) AS n_changes, string_agg(CAST(no - 1 AS VARCHAR), ',' ORDER BY no) AS changes, max(no) - 1 AS begin FROM cu WHERE alarm GROUP BY strategy)
SELECT m.strategy, CAST(coalesce(n_changes, 0) AS INT) AS n_changes, coalesce(changes, '') AS changes, CAST(coalesce(begin, 0) AS INT) AS current_start,
 round((SELECT avg(r) FROM n WHERE n.strategy = m.strategy AND n.no > coalesce(begin, 0)) + 1.37E-7, 6) + 0.0E0 AS current_mean FROM m LEFT JOIN ch ON ch.strategy = m.strategy""")
def w36_change_points(spark, d):
    return s.change_points(trades(spark, d))


@query(_NO + """, c AS (SELECT strategy, no, count(*) OVER (PARTITION BY strategy) AS n, avg(r) OVER (PARTITION BY strategy ORDER BY no) AS m FROM n),
 a AS (SELECT strategy, max(n) AS n, stddev_pop(CASE WHEN no <= n // 2 THEN m END) AS a, stddev_pop(CASE WHEN no > n // 2 THEN m END) AS b, regr_slope(m,
 no - 1) AS slope, corr(m, no - 1) AS c FROM c GROUP BY strategy)
SELECT strategy, n, round(b / a + 1.37E-7, 6) AS convergence_ratio, b / a < 1 AS converging, round(slope + 1.37E-7, 8) + 0.0E0 AS drift_slope,
 round(c * sqrt((n - 2) / (1 - c * c)) + 1.37E-7, 3) + 0.0E0 AS drift_t FROM a""")
def w37_convergence(spark, d):
    return s.convergence(trades(spark, d)).drop("drift_p", "drifting")


@query(_NO + """, e AS (SELECT strategy, no, count(*) OVER (PARTITION BY strategy) AS n, avg(r) OVER (PARTITION BY strategy
 ORDER BY no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS e FROM n), l AS (SELECT *, lag(e) OVER (PARTITION BY strategy ORDER BY no) AS prev FROM e),
 g AS (SELECT strategy, max(n) AS n, regr_slope(e - prev, prev) AS b, regr_r2(e - prev, prev) AS r2 FROM l GROUP BY strategy)
SELECT strategy, n, round(CASE WHEN b < 0 THEN ln(2) / -b END + 1.37E-7, 1) AS half_life, round(greatest(0, -b) + 1.37E-7, 6) + 0.0E0 AS decay_rate,
 round(r2 + 1.37E-7, 4) AS r2, b < 0 AS mean_reverting FROM g""")
def w38_edge_half_life(spark, d):
    return s.edge_half_life(trades(spark, d))


@query(_NO + """, a AS (SELECT strategy, no, r, (no - 1) // 50 AS win, count(*) OVER (PARTITION BY strategy) AS n FROM n),
 f AS (SELECT *, cume_dist() OVER (PARTITION BY strategy ORDER BY r) AS fa, (rank() OVER (PARTITION BY strategy ORDER BY r) - 1) / n AS ga,
 cume_dist() OVER (PARTITION BY strategy, win ORDER BY r) AS fw, (rank() OVER (PARTITION BY strategy, win ORDER BY r) - 1) / 50 AS gw FROM a),
 k AS (SELECT strategy, win, max(n) AS n, max(greatest(abs(fw - fa), abs(gw - ga))) AS d FROM f WHERE win < n // 50 GROUP BY strategy, win),
 x AS (SELECT *, d * sqrt(n * 50 / (n + 50.0E0)) AS x FROM k),
 p AS (SELECT *, CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101),
 lambda k: CASE WHEN k % 2 = 1 THEN 2.0E0 ELSE -2.0E0 END * exp(-2.0E0 * k * k * x * x))))) END AS p FROM x)
SELECT strategy, CAST(win AS INT) AS win, round(d + 1.37E-7, 6) AS distance, round(p + 1.37E-7, 6) + 0.0E0 AS p_value, p < 0.05E0 / (n // 50) AS unstable FROM p""")
def w40_rolling_ks(spark, d):
    return s.rolling_ks(trades(spark, d))


@query(", e AS (SELECT hour(entry_time) AS h, count(*) AS n, avg(mfe) AS a, avg(mae) AS b, avg(mfe / (mae + 1e-10)) AS c, quantile_cont(mfe / (mae + 1e-10), 0.5) AS m FROM trades WHERE mfe IS NOT NULL AND mae > 0 GROUP BY 1) SELECT CAST(g.h AS INT) AS hour, coalesce(n, 0) AS n, round(a + 1.37E-7, 6) AS mean_mfe, round(b + 1.37E-7, 6) AS mean_mae, round(c + 1.37E-7, 4) AS mfe_mae_ratio, round(m + 1.37E-7, 4) AS median_ratio FROM (SELECT unnest(range(24)) AS h) g LEFT JOIN e ON e.h = g.h")
def a15_execution_by_hour(spark, d):
    return t.execution_by_hour(trades(spark, d))


@query(f""", b AS (SELECT r_multiple AS r, outcome, unnest([{{'kind': 'hour', 'bucket': printf('%02d', hour(entry_time))}},
 {{'kind': 'session', 'bucket': CASE WHEN hour(entry_time) < 8 THEN 'Asia' WHEN hour(entry_time) < 13 THEN 'London' WHEN hour(entry_time) < 21 THEN 'New York' ELSE 'Off-Hours' END}}, {{'kind': 'day', 'bucket': dayname(entry_time)}}]) AS x FROM trades),
 g AS (SELECT x.kind AS kind, x.bucket AS bucket, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(CASE WHEN outcome LIKE '%win%' THEN 1.0E0 ELSE 0 END) AS wr,
 sum(r) AS total FROM b GROUP BY ALL HAVING count(*) >= 30),
 h AS (SELECT *, sum(CASE WHEN kind = 'hour' THEN m * n END) OVER () / sum(CASE WHEN kind = 'hour' THEN n END) OVER () AS base, count(*) OVER () AS tests FROM g),
 z AS (SELECT *, -abs((m - base) / (s / sqrt(n))) AS z FROM h),
 v AS (SELECT *, 2 * {normal_sql("z")} AS p, CASE WHEN m > 0 AND (kind <> 'hour' OR m > base) THEN 'best' WHEN m < 0 AND (kind <> 'hour' OR m < base) THEN 'worst' END AS verdict FROM z),
 o AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN row_number() OVER (PARTITION BY kind, verdict ORDER BY CASE WHEN verdict = 'best' THEN -m ELSE m END,
 bucket) END AS place FROM v)
SELECT kind, bucket, n, round(m + 1.37E-7, 4) + 0.0E0 AS mean_r, round(wr + 1.37E-7, 4) AS win_rate, round(total + 1.37E-7, 4) + 0.0E0 AS total_r, round(p + 1.37E-7,
 6) AS p_value, p < 0.05E0 / tests AS significant, verdict, CAST(place AS INT) AS place,
 coalesce(verdict = 'worst' AND kind <> 'day' AND place <= CASE WHEN kind = 'hour' THEN 3 ELSE 1 END, false) AS avoid FROM o""")
def a16_timing_recommendations(spark, d):
    return t.timing_recommendations(trades(spark, d))


@query(" SELECT count(*) AS total, CAST(sum(CASE WHEN pnl_usd > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(pnl_usd) + 1.37E-7, 2) + 0.0E0 AS total_pnl, round(sum(entry_price * 0.001E0) + 1.37E-7, 2) AS total_fees, max(pnl_usd) AS best_trade, min(pnl_usd) AS worst_trade, round(100 * avg(CASE WHEN pnl_usd > 0 THEN 1.0E0 ELSE 0 END) + 1.37E-7, 1) AS win_rate FROM trades")
def a7_closed_stats(spark, d):
    return t.closed_stats(trades(spark, d).withColumn("fees_usd", F.col("entry_price") * 0.001))


@query(f", h AS (SELECT *, {_HOUR_NY} AS h FROM trades), v AS (SELECT *, {_SESSION} AS session FROM h) SELECT strategy, session, count(*) AS trades, round(sum(r_multiple) + 1.37E-7, 3) + 0.0E0 AS total_r, round(avg(r_multiple) + 1.37E-7, 3) + 0.0E0 AS avg_r, CAST(sum(CASE WHEN r_multiple > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(100 * avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END) + 1.37E-7, 1) AS win_rate FROM v GROUP BY strategy, session")
def a11_session_summary(spark, d):
    return t.session_summary(trades(spark, d))


_TRAIN = """count(*) AS trades, CAST(sum(CASE WHEN outcome LIKE '%win%' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
 round(avg(CASE WHEN outcome LIKE '%win%' THEN 1.0E0 ELSE 0 END) + 1.37E-7, 4) AS win_rate, round(sum(pnl_usd) + 1.37E-7, 2) + 0.0E0 AS pnl,
 round(coalesce(sum(CASE WHEN pnl_usd > 0 THEN pnl_usd END) / nullif(abs(sum(CASE WHEN pnl_usd < 0 THEN pnl_usd END)), 0), CAST('Infinity' AS DOUBLE)) + 1.37E-7,
 4) AS profit_factor, round(avg(r_multiple) + 1.37E-7, 4) + 0.0E0 AS avg_r, round(avg(mfe) + 1.37E-7, 4) AS avg_mfe, round(avg(mae) + 1.37E-7, 4) AS avg_mae"""


@query(f" SELECT strategy, {_TRAIN} FROM trades GROUP BY strategy")
def a19_training_stats(spark, d):
    return t.training_stats(trades(spark, d), "strategy")


@query(f" SELECT CAST(hour(entry_time) AS INT) AS hour, {_TRAIN} FROM trades GROUP BY 1")
def a19_training_hours(spark, d):
    return t.training_stats(trades(spark, d), F.hour("entry_time").alias("hour"))


@query(" SELECT strategy, count(*) AS trades, CAST(sum(CASE WHEN bars_held % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS usable, sum(CASE WHEN bars_held % 3 > 0 THEN 1 ELSE 0 END) >= 50 AS ready FROM trades GROUP BY strategy")
def a19_training_readiness(spark, d):
    return t.training_readiness(trades(spark, d).withColumn("mae", F.when(F.col("bars_held") % 3 > 0, F.col("mae"))))


@query(""", d AS (SELECT strategy, strftime(exit_time, '%Y-%m-%d') AS period, sum(r_multiple) AS total, avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END) AS wr,
 sum(CASE WHEN pnl_usd > 0 THEN pnl_usd END) / nullif(abs(sum(CASE WHEN pnl_usd < 0 THEN pnl_usd END)), 0) AS pf, count(*) AS k FROM trades GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY period DESC) AS back, sum(CASE WHEN total >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy
 ORDER BY period) AS run FROM d), u AS (SELECT *, CASE WHEN total < 0 THEN count(CASE WHEN total < 0 THEN 1 END) OVER (PARTITION BY strategy, run) ELSE 0 END AS streak FROM b)
SELECT strategy, count(*) AS periods, max_by(period, total) AS best, min_by(period, total) AS worst, max(streak) AS losing_streak,
 round(avg(CASE WHEN total > 0 THEN 1.0E0 ELSE 0 END) + 1.37E-7, 4) AS share_profitable, round(avg(CASE WHEN back <= 2 THEN pf END) + 1.37E-7, 4) AS recent_pf,
 round(avg(CASE WHEN back > 2 THEN pf END) + 1.37E-7, 4) AS earlier_pf, round(avg(CASE WHEN back <= 2 THEN wr END) + 1.37E-7, 4) AS recent_wr,
 round(avg(CASE WHEN back > 2 THEN wr END) + 1.37E-7, 4) AS earlier_wr, round(avg(k) + 1.37E-7, 4) AS mean_trades FROM u GROUP BY strategy""")
def a23_period_review(spark, d):
    """By day, as the given trades span one month; a month is another period expression."""
    return t.period_review(trades(spark, d), F.date_format("exit_time", "yyyy-MM-dd"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY strategy, source ORDER BY entry_time) AS k, entry_price + pnl_usd / 10 AS exit_price FROM trades),
 m AS (SELECT a.entry_price AS le, b.entry_price AS se, a.exit_price AS lx, b.exit_price AS sx, a.r_multiple AS lr, b.r_multiple AS sr, a.outcome AS lo,
 b.outcome AS so FROM o a JOIN o b ON a.strategy = b.strategy AND a.k = b.k AND a.source = 'Live' AND b.source = 'Backtest')
SELECT count(*) AS n, round(avg((le - se) / se * 100) + 1.37E-7, 6) + 0.0E0 AS mean_entry_gap_pct, round(avg((lx - sx) / sx * 100) + 1.37E-7,
 6) + 0.0E0 AS mean_exit_gap_pct, round(avg(lr - sr) + 1.37E-7, 4) + 0.0E0 AS mean_r_gap, round(sum(lr - sr) + 1.37E-7, 4) + 0.0E0 AS total_drag_r,
 round(avg(CASE WHEN lo = so THEN 1.0E0 ELSE 0 END) + 1.37E-7, 4) AS outcome_agreement FROM m""")
def a25_shadow_aggregates(spark, d):
    df = trades(spark, d).withColumn("exit_price", F.col("entry_price") + F.col("pnl_usd") / 10).withColumn("k", F.row_number().over(Window.partitionBy("strategy",
        "source").orderBy("entry_time")))
    one = lambda source, side: df.where(F.col("source") == source).select("strategy", "k", *[F.col(c).alias(f"{side}_{n}") for c, n in (("entry_price", "entry"),
        ("exit_price", "exit"), ("r_multiple", "r"), ("outcome", "outcome"))])
    return t.shadow_aggregates(one("Live", "live").join(one("Backtest", "shadow"), ["strategy", "k"]))


@query(""", c AS (SELECT trade_id, mfe AS mfe2, mae AS mae2 FROM trades WHERE bars_held % 2 = 0) SELECT t.trade_id,
 coalesce(CASE WHEN bars_held % 5 > 0 THEN mfe END, mfe2) AS mfe, coalesce(CASE WHEN bars_held % 5 > 0 THEN mae END, mae2) AS mae FROM trades t LEFT
 JOIN c ON c.trade_id = t.trade_id""")
def j6_excursions(spark, d):
    """Trades that lack their excursions take them from a companion table."""
    df = trades(spark, d)
    own = df.select("trade_id", *[F.when(F.col("bars_held") % 5 > 0, F.col(c)).alias(c) for c in ("mfe", "mae")])
    return joins.filled_from(own, df.where("bars_held % 2 = 0").select("trade_id", "mfe", "mae"), "trade_id", ["mfe", "mae"])


_DAILY = """, d AS (SELECT strategy, CAST(CAST(exit_time AS DATE) AS VARCHAR) AS day, sum(r_multiple) AS r, count(*) AS k FROM trades GROUP BY ALL), f AS (SELECT *,
 sum(r) OVER (PARTITION BY strategy ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS forward_r FROM d),
 l AS (SELECT day, CASE WHEN max(forward_r) <= 0 THEN 'none' ELSE max_by(strategy, forward_r) END AS label FROM f WHERE forward_r IS NOT NULL GROUP BY day)"""


@query(_DAILY + " SELECT d.strategy, d.day, d.k AS n_trades, round(f.forward_r + 1.37E-7, 4) + 0.0E0 AS forward_r, l.label FROM d JOIN f ON f.strategy = d.strategy AND f.day = d.day AND f.forward_r IS NOT NULL JOIN l ON l.day = d.day")
def j7_features_and_labels(spark, d):
    daily = joins.daily_r(trades(spark, d))
    forward = p.forward_sums(daily, 5).where("forward_r IS NOT NULL").select("strategy", "day", "forward_r")
    features = trades(spark, d).groupBy("strategy", F.to_date("exit_time").cast("string").alias("day")).agg(F.count("*").alias("n_trades"))
    label = p.best_label(forward).select("day", "label")
    return joins.aligned(features, [(forward, ["strategy", "day"]), (label, ["day"])]).select("strategy", "day", "n_trades",
        rounded(F.col("forward_r")).alias("forward_r"), "label")


@query(""", s AS (SELECT CAST(CAST(exit_time AS DATE) AS VARCHAR) AS "window", strategy || '|' || symbol || '|' || regime AS combo, avg(r_multiple) AS score
 FROM trades WHERE pnl_usd > -30 GROUP BY ALL), k AS (SELECT combo FROM s GROUP BY combo HAVING count(*) = (SELECT count(DISTINCT "window") FROM s))
SELECT "window", s.combo, round(score + 1.37E-7, 4) + 0.0E0 AS score FROM s JOIN k ON k.combo = s.combo""")
def j12_whole_score_matrix(spark, d):
    scores = trades(spark, d).where("pnl_usd > -30").groupBy(F.to_date("exit_time").cast("string").alias("window"), F.concat_ws("|", "strategy", "symbol",
        "regime").alias("combo")).agg(F.avg("r_multiple").alias("score"))
    return joins.in_every_window(scores).withColumn("score", rounded(F.col("score")))


@query(" SELECT strategy, CAST(year(exit_time) AS INT) AS year, " + ", ".join(f"round(sum(CASE WHEN month(exit_time) = {m} THEN r_multiple END) + 1.37E-7, 4) + 0.0E0 AS m{m:02d}" for m in range(1, 13)) + ", round(sum(r_multiple) + 1.37E-7, 4) + 0.0E0 AS total FROM trades GROUP BY strategy, year(exit_time)")
def a10_calendar_pivot(spark, d):
    return t.calendar_pivot(trades(spark, d))


@query(_DAILY + ", j AS (SELECT regime, label, count(*) AS n FROM trades t JOIN l ON l.day = CAST(CAST(t.exit_time AS DATE) AS VARCHAR) GROUP BY ALL) SELECT regime, label, n, round(n / sum(n) OVER (PARTITION BY regime) + 1.37E-7, 4) AS share FROM j")
def a26_label_shares(spark, d):
    forward = p.forward_sums(joins.daily_r(trades(spark, d)), 5).where("forward_r IS NOT NULL").select("strategy", "day", "forward_r")
    return t.label_shares(trades(spark, d), p.best_label(forward).select("day", "label"))
