"""Schemas and readers of candles, trades and results; files only, so that every executor reads its own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"
INDICATORS = ("atr_14", "ema_50", "ema_100", "ema_200", "rsi_14")
#: The unified trade row, in order.
TRADE_SCHEMA = "trade_id string, strategy string, symbol string, timeframe string, source string, direction string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, pnl_usd double, pnl_pct double, r_multiple double, session string, exit_reason string, duration_minutes double, running_balance double, mfe double, mae double, is_open boolean"
#: Minutes of each timeframe name.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}


def plain_symbol(symbol: Column) -> Column:
    """Without a -USD ending."""
    return F.regexp_replace(symbol, "-USD$", "")


def read_bars(spark: SparkSession, path: str, *, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None,
    indicators: bool = False, required: bool = False) -> DataFrame:
    """Filters on symbol, timeframe and time reach the scan (and prune partitions). A symbol may be given with its -USD ending or without; required: no rows are an error."""
    if timeframe is not None and timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe}; known are {', '.join(TIMEFRAMES)}")
    df = spark.read.parquet(path)
    if symbol is not None:
        plain = symbol.removesuffix("-USD")
        df = df.where(F.col("symbol").isin(plain, f"{plain}-USD")).withColumn("symbol", plain_symbol(F.col("symbol")))
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if start:
        df = df.where(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("bar_ts") <= F.lit(end).cast("timestamp_ntz"))
    base = ["symbol", "timeframe", "bar_ts", "open", "high", "low", "close", "volume"]
    df = df.select(*base, *[c for c in INDICATORS if indicators and c in df.columns])
    if required and df.isEmpty():
        raise ValueError(f"no bars of {symbol} {timeframe} in {path}")
    return df


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest n rows, oldest first; no full sort."""
    return bars.orderBy(F.desc("bar_ts")).limit(n).orderBy("bar_ts")


def read_csv_trades(spark: SparkSession, path: str, schema: str, names: dict[str, str]) -> DataFrame:
    """A CSV with its own names, brought to the unified columns; what it lacks is null."""
    df = spark.read.csv(path, header=True, schema=schema)
    return unified(df.withColumnsRenamed(names))


def unified(df: DataFrame) -> DataFrame:
    """P20: exactly the unified columns, in order and type."""
    empty = df.sparkSession.createDataFrame([], TRADE_SCHEMA)
    return empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per result document, with its file and time of change."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("changed"))


def named_results(results: DataFrame) -> DataFrame:
    """Results with strategy, symbol and timeframe from a file name like strategy_symbol_timeframe.json; null where it has another form."""
    form = r"^(.+)_([^_]+)_([^_]+)\.json$"
    part = lambda i: F.when(F.col("file").rlike(form), F.regexp_extract("file", form, i))
    return results.withColumns({"strategy": part(1), "symbol": part(2), "timeframe": part(3)})


def latest_result(results: DataFrame, *keys: str, time: str = "changed") -> DataFrame:
    """The newest document of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("file"))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coverage(bars: DataFrame) -> DataFrame:
    """S16."""
    return bars.groupBy("symbol", "timeframe").agg(F.count("*").alias("rows"), F.min("bar_ts").alias("first"), F.max("bar_ts").alias("last"))


def equity_rows(results: DataFrame) -> DataFrame:
    """The nested equity points of results as a flat trade table."""
    return results.select("file", F.explode("oos_equity").alias("p")).select("file", "p.*")


def read_dvol(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of (timestamp in ms, dvol) as ts and dvol; `operators.joins.asof` brings it to bars."""
    df = spark.read.option("multiLine", True).schema("timestamp long, dvol double").json(path)
    return df.select(F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("ts"), "dvol")


def result_windows(results: DataFrame) -> DataFrame:
    """V3: the nested windows of result documents as rows, with the document's file."""
    return results.select("file", F.posexplode("windows").alias("window", "w")).select("file", "window", "w.*")


def parsed_props(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column as the fields of a schema; null where the text is no such document."""
    return df.withColumn("_parsed", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_parsed.*")
