"""Queries over daily curves and set operations: id_name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import joins
from ..operators import portfolio as p
from .trade_queries import query
from .views import bars, events, trades

_D = ", d AS (SELECT strategy, CAST(CAST(exit_time AS DATE) AS VARCHAR) AS day, sum(r_multiple) AS r FROM trades GROUP BY ALL)"
_CAL = _D + """, s AS (SELECT strategy, min(CAST(day AS DATE)) AS a, max(CAST(day AS DATE)) AS b FROM d GROUP BY strategy), g AS (SELECT strategy,
 CAST(CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM s),
c AS (SELECT g.strategy, g.day, coalesce(d.r, 0) AS r FROM g LEFT JOIN d ON d.strategy = g.strategy AND d.day = g.day), f AS (SELECT *,
 sum(r) OVER (PARTITION BY strategy ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS forward_r FROM c)"""


@query(_CAL + " SELECT strategy, day, round(r + 1.37E-7, 4) + 0.0E0 AS r, round(sum(r) OVER (PARTITION BY strategy ORDER BY day) + 1.37E-7, 4) + 0.0E0 AS cumulative_r FROM c")
def w25_daily_curve(spark, d):
    return p.calendar(joins.daily_r(trades(spark, d))).select("strategy", "day", rounded(F.col("r")).alias("r"), rounded(F.col("cumulative_r")).alias("cumulative_r"))


@query(_CAL + " SELECT strategy, day, round(forward_r + 1.37E-7, 4) + 0.0E0 AS forward_r FROM f")
def w26_forward_sum(spark, d):
    return p.forward_sums(p.calendar(joins.daily_r(trades(spark, d))), 5).select("strategy", "day", rounded(F.col("forward_r")).alias("forward_r"))


@query(_CAL + """, m AS (SELECT day, max(forward_r) AS top FROM f GROUP BY day) SELECT m.day,
 CASE WHEN top IS NULL THEN NULL WHEN top <= 0 THEN 'none' ELSE (SELECT min(strategy) FROM f WHERE f.day = m.day AND f.forward_r = m.top) END AS label,
 round(top + 1.37E-7, 4) + 0.0E0 AS top FROM m""")
def w27_best_label(spark, d):
    return p.best_label(p.forward_sums(p.calendar(joins.daily_r(trades(spark, d))), 5))


@query(_D + """, c AS (SELECT day, sum(r / (SELECT count(DISTINCT strategy) FROM d)) AS r FROM d GROUP BY day), e AS (SELECT *, sum(r) OVER (ORDER BY day) AS equity FROM c)
SELECT day, round(r + 1.37E-7, 4) + 0.0E0 AS r, round(equity + 1.37E-7, 4) + 0.0E0 AS equity, round(greatest(max(equity) OVER (ORDER BY day), 0) - equity + 1.37E-7,
 4) + 0.0E0 AS drawdown FROM e""")
def t8_equal_portfolio(spark, d):
    df = p.combined(joins.daily_r(trades(spark, d)))
    return df.select("day", *[rounded(F.col(c)).alias(c) for c in ("r", "equity", "drawdown")])


@query(_D + """, s AS (SELECT strategy, avg(r * 0.01E0) AS m, stddev_samp(r * 0.01E0) AS sd FROM d GROUP BY strategy), w AS (SELECT *, 1 / sd AS iv,
 greatest(m / (sd * sd), 0) AS k FROM s) SELECT strategy, round(1.0E0 / count(*) OVER () + 1.37E-7, 4) AS equal, round(iv / sum(iv) OVER () + 1.37E-7,
 4) AS inverse_vol, round(coalesce(k / nullif(sum(k) OVER (), 0), 1.0E0 / count(*) OVER ()) + 1.37E-7, 4) AS kelly FROM w""")
def t7_allocation(spark, d):
    return p.allocation(joins.daily_r(trades(spark, d)))


@query(""", n AS (SELECT strategy, entry_time, r_multiple, pnl_usd, row_number() OVER w - 1 AS no, 10000 + sum(pnl_usd) OVER w AS e FROM trades
 WINDOW w AS (PARTITION BY strategy ORDER BY entry_time)), k AS (SELECT *, max(e) OVER (PARTITION BY strategy ORDER BY no) AS peak FROM n), x AS (SELECT *, peak - e AS dd FROM k),
f AS (SELECT strategy, dd, peak, entry_time, row_number() OVER (PARTITION BY strategy ORDER BY dd DESC, no) AS i FROM x),
g AS (SELECT strategy, count(*) AS trades, sum(pnl_usd) AS pnl, avg(r_multiple) AS m, stddev_samp(r_multiple) AS sd, greatest(1, datediff('second', min(entry_time),
 max(entry_time)) // 86400) AS days, regr_r2(e, no) AS r2, regr_slope(CASE WHEN pnl_usd > 0 THEN 1.0E0 ELSE 0 END, no) AS slope FROM x GROUP BY strategy)
SELECT strategy, trades, round(dd + 1.37E-7, 2) + 0.0E0 AS max_dd, round(100 * dd / peak + 1.37E-7, 4) + 0.0E0 AS max_dd_pct, CAST(CAST(entry_time AS DATE) AS VARCHAR) AS max_dd_date,
 round(m / sd * sqrt(trades / (days / 365.25E0)) + 1.37E-7, 4) + 0.0E0 AS sharpe, round(pnl * 365.25E0 / days / dd + 1.37E-7, 4) + 0.0E0 AS calmar,
 round(pnl / dd + 1.37E-7, 4) + 0.0E0 AS recovery_factor, round(r2 + 1.37E-7, 4) + 0.0E0 AS equity_r2, round(slope + 1.37E-7, 8) + 0.0E0 AS win_rate_slope
FROM g JOIN f USING (strategy) WHERE i = 1""")
def w34_equity_line(spark, d):
    return p.equity_line(trades(spark, d))


@query(""", s AS (SELECT CAST(CAST(exit_time AS DATE) AS VARCHAR) AS "row", strategy AS combo, avg(CASE WHEN direction = 'LONG' THEN r_multiple END) AS a,
 avg(CASE WHEN direction = 'SHORT' THEN r_multiple END) AS b FROM trades GROUP BY ALL), k AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY a DESC, combo) AS best,
 (rank() OVER (PARTITION BY "row" ORDER BY b) + (count(*) OVER (PARTITION BY "row", b) - 1) / 2.0E0) / count(*) OVER (PARTITION BY "row") AS share FROM k)
SELECT count(*) AS rows, round(avg(CASE WHEN share <= 0.5 THEN 1.0E0 ELSE 0 END) + 1.37E-7, 4) AS pbo FROM r WHERE best = 1""")
def t6_overfit_probability(spark, d):
    r = F.col("r_multiple")
    s = trades(spark, d).groupBy(F.to_date("exit_time").cast("string").alias("row"), F.col("strategy").alias("combo")).agg(F.avg(F.when(F.col("direction") == "LONG",
        r)).alias("is_score"), F.avg(F.when(F.col("direction") == "SHORT", r)).alias("oos_score"))
    return p.overfit_probability(s.dropna())


_SL = "entry_price * (1 - CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * mae / 100)"


@query(f""" SELECT trade_id, direction, round(CASE WHEN direction = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END / nullif(abs(entry_price - sl), 0) + 1.37E-7, 4) + 0.0E0 AS r,
 round(CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * (exit_price - entry_price) / entry_price * 100 + 1.37E-7, 4) + 0.0E0 AS pnl_pct FROM (SELECT *,
 entry_price + pnl_usd / 10 AS exit_price, {_SL} AS sl FROM trades)""")
def p17_derived_r(spark, d):
    """The stop lies `mae` percent beyond the entry, as in p19."""
    df = trades(spark, d).withColumn("exit_price", F.col("entry_price") + F.col("pnl_usd") / 10).withColumn("sl", F.expr(_SL))
    return p.derived_r(df).select("trade_id", "direction", rounded(F.col("r")).alias("r"), rounded(F.col("pnl_pct")).alias("pnl_pct"))


@query(""" SELECT trade_id, coalesce(CASE direction WHEN 'LONG' THEN 'Long' WHEN 'SHORT' THEN 'Short' END, 'Unknown') AS side,
 coalesce(CASE regime WHEN 'trending_up' THEN 'Up' WHEN 'trending_down' THEN 'Down' WHEN 'ranging' THEN 'Range' END, 'Unknown') AS market FROM trades""")
def j10_lookups(spark, d):
    side = F.create_map(F.lit("LONG"), F.lit("Long"), F.lit("SHORT"), F.lit("Short"))
    market = F.create_map(F.lit("trending_up"), F.lit("Up"), F.lit("trending_down"), F.lit("Down"), F.lit("ranging"), F.lit("Range"))
    return trades(spark, d).select("trade_id", F.coalesce(side[F.col("direction")], F.lit("Unknown")).alias("side"), F.coalesce(market[F.col("regime")],
        F.lit("Unknown")).alias("market"))


@query(" SELECT a.trade_id, a.strategy, round(a.mfe - b.mae + 1.37E-7, 4) + 0.0E0 AS edge FROM trades a JOIN trades b ON a.trade_id = b.trade_id AND b.outcome LIKE 'win%'")
def j5_equi_join(spark, d):
    a = trades(spark, d).select("trade_id", "strategy", "mfe")
    b = trades(spark, d).where(F.col("outcome").startswith("win")).select("trade_id", "mae")
    return a.join(b, "trade_id").select("trade_id", "strategy", rounded(F.col("mfe") - F.col("mae")).alias("edge"))


@query(""" SELECT strategy, direction, trade_id FROM (SELECT *, row_number() OVER (PARTITION BY strategy, direction, date_trunc('day', entry_time)
 ORDER BY entry_time) AS n FROM trades) WHERE n = 1""")
def u3_dedup_first(spark, d):
    w = Window.partitionBy("strategy", "direction", F.date_trunc("day", "entry_time")).orderBy("entry_time")
    return trades(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("strategy", "direction", "trade_id")


@query(""" SELECT DISTINCT strategy, symbol, regime FROM trades WHERE source = 'Live' EXCEPT SELECT strategy, symbol, regime FROM trades
 WHERE source = 'Backtest' AND r_multiple > 0.9""")
def u5_missed(spark, d):
    t = trades(spark, d)
    key = ["strategy", "symbol", "regime"]
    return t.where("source = 'Live'").select(*key).distinct().join(t.where("source = 'Backtest' AND r_multiple > 0.9").select(*key), key, "left_anti")


@query(""" SELECT 'live' AS kind, trade_id, r_multiple FROM trades WHERE source = 'Live' UNION ALL SELECT 'test', trade_id, r_multiple FROM trades
 WHERE source <> 'Live' AND pnl_usd > 0""")
def u1_union(spark, d):
    t = trades(spark, d)
    live = t.where("source = 'Live'").select(F.lit("live").alias("kind"), "trade_id", "r_multiple")
    return live.unionByName(t.where("source <> 'Live' AND pnl_usd > 0").select(F.lit("test").alias("kind"), "trade_id", "r_multiple"))


@query(""", h AS (SELECT *, 1 + pow(bars_held, 3) / 100 AS held FROM trades), m AS (SELECT quantile_cont(held, 0.5) AS median FROM h),
 o AS (SELECT *, sum(CASE WHEN pnl_usd > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, direction ORDER BY entry_time) AS run FROM h), u AS (SELECT *,
 CASE WHEN pnl_usd > 0 THEN 0 ELSE count(CASE WHEN pnl_usd <= 0 THEN 1 END) OVER (PARTITION BY strategy, direction, run) END AS streak FROM o)
SELECT strategy, direction, count(*) AS n, round(avg(r_multiple) + 1.37E-7, 4) + 0.0E0 AS mean_r,
 CAST(sum(CASE WHEN held > 5 * median THEN 1 ELSE 0 END) AS BIGINT) AS long_holds, max(streak) AS losing_streak,
 round(abs(avg(CASE WHEN pnl_usd > 0 THEN pnl_usd END) / nullif(avg(CASE WHEN pnl_usd < 0 THEN pnl_usd END), 0)) + 1.37E-7, 4) AS asymmetry FROM u, m
 GROUP BY strategy, direction""")
def a22_long_short(spark, d):
    return p.long_short(trades(spark, d).withColumn("held", 1 + F.pow("bars_held", F.lit(3)) / 100), "held")


@query(_D + """, m AS (SELECT strategy, stddev_pop(r) / nullif(abs(avg(r)), 0) AS cv FROM d GROUP BY strategy), k AS (SELECT strategy, regime, count(*) AS n
 FROM trades GROUP BY ALL), t AS (SELECT strategy, max(n) / sum(n) AS share FROM k GROUP BY strategy) SELECT m.strategy, round(cv + 1.37E-7, 3) AS cv,
 round(share + 1.37E-7, 4) AS mode_share FROM m JOIN t ON t.strategy = m.strategy""")
def a24_consistency(spark, d):
    t = trades(spark, d)
    cv = joins.daily_r(t).groupBy("strategy").agg(rounded(F.try_divide(F.stddev_pop("r"), F.abs(F.avg("r"))), 3).alias("cv"))
    mode = t.groupBy("strategy", "regime").count().groupBy("strategy").agg(rounded(F.max("count") / F.sum("count")).alias("mode_share"))
    return cv.join(mode, "strategy")


@query(""", g AS (SELECT strategy, i * 0.5E0 / 50 AS f, CASE WHEN min(1 + i * 0.5E0 / 50 * r_multiple) > 0 THEN avg(CASE WHEN 1 + i * 0.5E0 / 50 * r_multiple > 0 THEN ln(1 + i * 0.5E0 / 50 * r_multiple) END) END AS growth FROM trades, (SELECT unnest(range(1, 51)) AS i) GROUP BY strategy, i)
SELECT strategy, round(f + 1.37E-7, 4) AS f, round(growth + 1.37E-7, 6) + 0.0E0 AS growth FROM g""")
def t14_growth_curve(spark, d):
    return p.growth_curve(trades(spark, d)).select("strategy", rounded(F.col("f")).alias("f"), rounded(F.col("growth"), 6).alias("growth"))


@query(""", g AS (SELECT strategy, i * 0.5E0 / 50 AS f, CASE WHEN min(1 + i * 0.5E0 / 50 * r_multiple) > 0 THEN avg(CASE WHEN 1 + i * 0.5E0 / 50 * r_multiple > 0 THEN ln(1 + i * 0.5E0 / 50 * r_multiple) END) END AS growth FROM trades, (SELECT unnest(range(1, 51)) AS i) GROUP BY strategy, i),
u AS (SELECT *, coalesce(growth > 0, false) AS up, coalesce(lag(growth) OVER (PARTITION BY strategy ORDER BY f) > 0, false) AS was FROM g), b AS (SELECT strategy,
 max(growth) AS mg, min(CASE WHEN NOT up AND was THEN f END) AS critical FROM u GROUP BY strategy),
o AS (SELECT g.strategy, min(f) AS f FROM g JOIN b ON b.strategy = g.strategy AND b.mg = g.growth GROUP BY g.strategy), k AS (SELECT strategy,
 avg(CASE WHEN r_multiple > 0 THEN r_multiple END) AS gain, avg(CASE WHEN r_multiple < 0 THEN -r_multiple END) AS loss,
 avg(CASE WHEN r_multiple > 0 THEN 1.0E0 ELSE 0 END) AS wr FROM trades GROUP BY strategy)
SELECT strategy, round(f + 1.37E-7, 4) AS optimal_f, round(mg + 1.37E-7, 8) AS max_growth, mg > 0 AS ergodic, round(critical + 1.37E-7, 4) AS critical_f,
 round(wr - (1 - wr) / (gain / loss) + 1.37E-7, 6) + 0.0E0 AS kelly FROM b JOIN o USING (strategy) JOIN k USING (strategy)""")
def t14_growth_limits(spark, d):
    return p.growth_limits(trades(spark, d))


@query(""", s AS (SELECT strategy, symbol, count(*) AS n, round(avg(r_multiple) + 1.37E-7, 4) AS m, avg(r_multiple) AS mu, stddev_samp(r_multiple) AS sd FROM trades
 GROUP BY strategy, symbol HAVING count(*) >= 5),
g AS (SELECT strategy, symbol, regime, avg(r_multiple) AS m FROM trades GROUP BY ALL), br AS (SELECT strategy, symbol, max_by(regime, m) AS best FROM g
 GROUP BY ALL), ac AS (SELECT strategy, best, count(*) AS c FROM br GROUP BY ALL), ag AS (SELECT strategy, max(c) / sum(c) * 100 AS regime_score FROM ac GROUP BY strategy),
a AS (SELECT strategy, count(*) AS assets, stddev_pop(m) / abs(avg(m)) AS cv, avg(CASE WHEN m > 0 THEN 1.0E0 ELSE 0 END) * 100 AS profit,
 avg(CASE WHEN mu > 0 AND mu / sd * sqrt(n) > 1.647E0 THEN 1.0E0 ELSE 0 END) * 100 AS sig FROM s GROUP BY strategy),
t AS (SELECT a.*, regime_score, greatest(0, least(100, (1 - cv) / 0.85E0 * 100)) AS cons FROM a JOIN ag USING (strategy)), z AS (SELECT *,
 0.3E0 * cons + 0.25E0 * profit + 0.2E0 * sig + 0.15E0 * regime_score + 5 AS score FROM t)
SELECT strategy, assets, round(cons + 1.37E-7, 2) AS consistency, round(profit + 1.37E-7, 2) AS profitability, round(sig + 1.37E-7, 2) AS significance,
 round(regime_score + 1.37E-7, 2) AS regime_stability, round(score + 1.37E-7, 2) AS score,
 CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade FROM z""")
def t19_robustness(spark, d):
    """Its SQL takes 1.647 for the 5 % limit of t, whose exact value at several hundred trades lies within 0.002 of it."""
    return p.robustness(trades(spark, d))


@query(""" SELECT CASE WHEN bars_held % 6 = 0 THEN NULL WHEN bars_held % 7 = 0 THEN 'FIXED' || trade_id ELSE trade_id END AS trade_id, strategy,
 CASE WHEN bars_held % 4 > 0 THEN pnl_usd END AS pnl_usd, CASE WHEN bars_held % 4 > 0 THEN r_multiple END AS r_multiple FROM trades WHERE bars_held % 6 = 0 OR bars_held % 7 > 0""")
def p14_cleaned_trades(spark, d):
    """P2, P14, P15 in one: upper-case names, hand-made ids, and open trades."""
    from ..operators import trades as t

    n = F.col("bars_held")
    raw = trades(spark, d).select(F.when(n % 6 == 0, None).when(n % 7 == 0, F.concat(F.lit("FIXED"), "trade_id")).otherwise(F.col("trade_id")).alias("TRADE_ID"),
        F.col("strategy").alias(" Strategy"), F.col("pnl_usd").alias("PNL_USD"), F.col("r_multiple").alias("R_Multiple"), (n % 4 == 0).alias("is_open"))
    return t.open_fields_cleared(t.without_bogus(t.plain_names(raw))).drop("is_open")


@query(" SELECT trade_id, round(floor(mfe / 0.25E0 + 1e-9) * 0.25E0 + 1.37E-7, 4) AS quantity, round(round(entry_price / 0.4E0) * 0.4E0 + 1.37E-7, 4) AS price FROM trades")
def p18_lot_rounded(spark, d):
    from ..operators import trades as t

    orders = trades(spark, d).select("trade_id", F.col("mfe").alias("quantity"), F.col("entry_price").alias("price"), F.lit(0.25).alias("step"), F.lit(0.4).alias("tick"))
    return t.lot_rounded(orders).select("trade_id", rounded(F.col("quantity")).alias("quantity"), rounded(F.col("price")).alias("price"))


@query(""", m AS (SELECT strategy, min(r_multiple) AS a, max(r_multiple) AS b FROM trades GROUP BY strategy), x AS (SELECT t.strategy,
 CAST(least(floor((r_multiple - a) / (b - a) * 40), 39) AS INT) AS bin, a, (b - a) / 40 AS w FROM trades t JOIN m USING (strategy))
SELECT strategy, bin, round(a + bin * w + 1.37E-7, 4) + 0.0E0 AS low, round(a + (bin + 1) * w + 1.37E-7, 4) + 0.0E0 AS high, count(*) AS n FROM x GROUP BY strategy, bin, a, w""")
def v4_r_histogram(spark, d):
    from ..operators import trades as t

    return t.value_histogram(trades(spark, d), "r_multiple", 40, "strategy")


@query(_D + """, b AS (SELECT symbol, CAST(CAST(bar_ts AS DATE) AS VARCHAR) AS day, max_by(close, bar_ts) + 100 AS bench FROM bars GROUP BY ALL),
v AS (SELECT d.strategy, d.day, 10000 + 100 * sum(r) OVER (PARTITION BY strategy ORDER BY d.day) AS value, bench FROM d JOIN b ON b.symbol = d.strategy AND b.day = d.day),
x AS (SELECT *, greatest(max(value) OVER w, 10000) AS peak, value / lag(value) OVER w - bench / lag(bench) OVER w AS diff FROM v WINDOW w AS (PARTITION BY strategy ORDER BY day)),
a AS (SELECT strategy, count(*) AS days, max_by(value, day) / 10000 - 1 AS total, max_by(bench, day) / min_by(bench, day) - 1 AS held, max((peak - value) / peak) AS dd, avg(diff) AS m, stddev_pop(diff) * sqrt(252) AS te FROM x GROUP BY strategy)
SELECT strategy, days, round((pow(1 + total, 252.0E0 / days) - 1) / dd + 1.37E-7, 4) + 0.0E0 AS calmar, round(dd * 100 + 1.37E-7, 2) AS max_drawdown_pct, round((pow(1 + total, 252.0E0 / days) - 1) * 100 + 1.37E-7, 2) + 0.0E0 AS annual_return_pct,
 round((total - held) * 100 + 1.37E-7, 2) + 0.0E0 AS alpha_pct, round(te + 1.37E-7, 4) AS tracking_error, round(m * 252 / te + 1.37E-7, 4) + 0.0E0 AS information_ratio FROM a""")
def m10_account_ratios(spark, d):
    """An account of 10,000 that risks 100 a trade, against holding the asset of the strategy's name (at its close and 100 more, as closes here come near 0)."""
    w = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bench = bars(spark, d).groupBy(F.col("symbol").alias("strategy"), F.to_date("bar_ts").cast("string").alias("day")).agg((F.max_by("close", "bar_ts") + 100).alias("bench"))
    values = joins.daily_r(trades(spark, d)).join(bench, ["strategy", "day"]).withColumn("value", 10000 + 100 * F.sum("r").over(w))
    return p.account_ratios(values, start=10000.0)


@query(""", n AS (SELECT strategy, entry_time, pnl_usd, row_number() OVER (PARTITION BY strategy ORDER BY entry_time) - 1 AS r, count(*) OVER (PARTITION BY strategy) AS n FROM trades),
i AS (SELECT DISTINCT strategy, CASE WHEN n <= 500 THEN i ELSE (i * (n - 1)) // 499 END AS r FROM (SELECT DISTINCT strategy, n FROM n), (SELECT unnest(range(500)) AS i))
SELECT strategy, entry_time, pnl_usd FROM n JOIN i USING (strategy, r)""")
def l6_spaced_trades(spark, d):
    return p.spaced(trades(spark, d).select("strategy", "entry_time", "pnl_usd"), ["strategy"], "entry_time", 500)


@query(""" SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS written FROM events""")
def f_json_props(spark, d):
    """A JSON column read by its schema, and fields written as JSON."""
    from ..sources.tables import parsed_props

    df = parsed_props(events(spark, d).select("event_id", "event_type", "props"), "props", "k long")
    return df.select("event_id", "k", F.to_json(F.struct("k", F.col("event_type").alias("type"))).alias("written"))


_SPLITS = ", ".join(f"({i}, {g}, '{role}')" for i, parts in enumerate(p.splits(6, 2, 1), 1) for role, part in zip(("train", "test"), parts, strict=True) for g in part)


@query(f""", n AS (SELECT strategy, r_multiple, row_number() OVER (PARTITION BY strategy ORDER BY entry_time) AS no, count(*) OVER (PARTITION BY strategy) AS n FROM trades),
g AS (SELECT strategy, least((no - 1) // (n // 6), 5) AS grp, r_multiple FROM n WHERE n >= 6), s AS (SELECT * FROM (VALUES {_SPLITS}) v(split, grp, role))
SELECT strategy, CAST(split AS INT) AS split, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
 round(avg(r_multiple) FILTER (role = 'train') + 1.37E-7, 4) + 0.0E0 AS train_r, round(avg(r_multiple) FILTER (role = 'test') + 1.37E-7, 4) + 0.0E0 AS test_r
FROM g JOIN s USING (grp) GROUP BY strategy, split""")
def t6_purged_splits(spark, d):
    return p.purged_scores(trades(spark, d))
