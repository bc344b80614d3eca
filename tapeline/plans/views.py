"""The two derived inputs that every query shares: hourly bars and trades, both made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BARS_SQL = """
SELECT event_type AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS bar_ts,
       min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, date_trunc('hour', ts)"""

TRADES_SQL = """
SELECT CAST(event_id AS VARCHAR(20)) AS trade_id, event_type AS strategy,
       CASE user_id % 3 WHEN 0 THEN 'AAA' WHEN 1 THEN 'BBB' ELSE 'CCC' END AS symbol,
       '15m' AS timeframe,
       CASE event_id % 4 WHEN 0 THEN 'Backtest' ELSE 'Live' END AS source,
       CASE event_id % 2 WHEN 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
       ts AS entry_time,
       ts + INTERVAL '15' MINUTE * CAST(event_id % 40 + 1 AS INT) AS exit_time,
       100.0E0 + CAST(user_id % 50 AS DOUBLE) AS entry_price,
       round((value - 50.0E0) / 50.0E0, 4) AS r_multiple,
       round(value - 50.0E0, 2) AS pnl_usd,
       CASE WHEN value > 90.0E0 THEN 'win_tp2' WHEN value > 50.0E0 THEN 'win_tp1'
            WHEN value > 45.0E0 THEN 'breakeven' ELSE 'loss' END AS outcome,
       CAST(event_id % 40 + 1 AS INT) AS bars_held,
       round(greatest((value - 50.0E0) / 50.0E0, 0.0E0) + CAST(event_id % 7 AS DOUBLE) / 10.0E0, 4) AS mfe,
       round(greatest((50.0E0 - value) / 50.0E0, 0.0E0) + CAST(event_id % 5 + 1 AS DOUBLE) / 10.0E0, 4) AS mae,
       CASE event_id % 5 WHEN 0 THEN 'trending_up' WHEN 1 THEN 'trending_down' WHEN 2 THEN 'ranging'
            WHEN 3 THEN 'volatile' ELSE 'unknown' END AS regime
FROM events"""

WITH = f"WITH bars AS ({BARS_SQL}), trades AS ({TRADES_SQL})"


def normal_sql(x: str) -> str:
    """DuckDB: the standard normal distribution function of a column, by its power series."""
    terms = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({x})) - lgamma(2 * k + 2) + k * ln(2.0E0) + lgamma(k + 1))))"
    return f"(CASE WHEN {x} > 8 THEN 1.0E0 WHEN {x} < -8 THEN 0.0E0 WHEN {x} = 0 THEN 0.5E0 ELSE 0.5E0 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} END)"


def chi2_sql(x: str, df: str) -> str:
    """DuckDB: the upper tail of the chi-square distribution, by the series of the lower incomplete gamma function."""
    terms = f"list_sum(list_transform(range(0, 400), lambda k: exp(({df} / 2.0E0 + k) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2.0E0 + k + 1))))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0E0 ELSE greatest(0.0E0, 1 - {terms}) END)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BARS_SQL.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRADES_SQL.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
