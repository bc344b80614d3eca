"""Writers: tables partitioned by their pruning columns; upserts write the touched partitions beside the table and then overwrite them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_KEY = ("symbol", "timeframe", "bar_ts")


def _fs(spark: SparkSession, path: str):
    """The file system of a path, by which whole folders are renamed: Spark's own writers have no rename."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _recovered(spark: SparkSession, path: str):
    """As _fs, after finishing a `replace` that stopped between its two renames: the new table if it is whole, else the old one."""
    fs, p, new = _fs(spark, path)
    side, old = new(path.rstrip("/") + ".next"), new(path.rstrip("/") + ".old")
    if not fs.exists(p):
        if fs.exists(old) and fs.exists(new(side, "_SUCCESS")):
            fs.rename(side, p)
        elif fs.exists(old):
            fs.rename(old, p)
    return fs, p, new


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _recovered(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str, *by: str) -> None:
    """Write beside, then rename twice; df may read from path. A reader between the renames finds no table; a job that stops there is finished by the next call of this module."""
    fs, p, new = _recovered(df.sparkSession, path)
    side, old = new(path.rstrip("/") + ".next"), new(path.rstrip("/") + ".old")
    fs.delete(side, True)
    df.write.partitionBy(*by).parquet(str(side))
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(side, p)
    fs.delete(old, True)


def merged(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...], order: str | None = None) -> DataFrame:
    """K3/K4: new rows win by key; of new rows with one key the last by `order`."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(list(keys))
    return new if old is None else old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(new: DataFrame, path: str, keys: tuple[str, ...] = BAR_KEY, *, by: tuple[str, ...] = ("symbol", "timeframe"), order: str | None = None, drop: tuple[str,
    ...] = ()) -> None:
    """K3-K5: only the partitions that `new` touches are read and written again, each as a whole; after a failure some may be old, and the same call again mends that.

    order: of new rows with one key the last by it stays; drop: columns that are not stored."""
    spark = new.sparkSession
    if not exists(spark, path):
        merged(None, new, keys, order).drop(*drop).write.partitionBy(*by).parquet(path)
        return
    old = spark.read.parquet(path)
    touched = new.select(*by).distinct()
    both = merged(old.join(touched, list(by), "left_semi") if by else old, new, keys, order).drop(*drop)
    fs, _, new_path = _fs(spark, path)
    side = path.rstrip("/") + ".upsert"
    fs.delete(new_path(side), True)
    both.write.partitionBy(*by).parquet(side)
    spark.read.parquet(side).write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)
    fs.delete(new_path(side), True)


def delete_before(spark: SparkSession, path: str, days: int, *, time: str = "bar_ts", by: tuple[str, ...] = ("symbol", "timeframe")) -> None:
    """K6: keep the last `days` days before the newest row."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max(time).alias("_m"))
    replace(df.join(F.broadcast(newest)).where(F.col(time) >= F.col("_m") - F.make_dt_interval(F.lit(days))).drop("_m"), path, *by)


def close_trade(trades: DataFrame, trade_id: str, exit_price: float, exit_time: str) -> DataFrame:
    """K9: one open trade closed, its PnL by direction."""
    hit = (F.col("trade_id") == trade_id) & F.col("is_open")
    sign = F.when(F.lower("direction") == "long", 1.0).otherwise(-1.0)
    pct = sign * (exit_price - F.col("entry_price")) / F.col("entry_price") * 100
    return trades.withColumns({"exit_price": F.when(hit, exit_price).otherwise(F.col("exit_price")), "exit_time": F.when(hit,
        F.lit(exit_time).cast("timestamp_ntz")).otherwise(F.col("exit_time")), "pnl_pct": F.when(hit, pct).otherwise(F.col("pnl_pct")), "is_open": F.when(hit, False).otherwise(F.col("is_open"))})


def create_views(trades: DataFrame) -> None:
    """K2: the three performance views."""
    from ..operators.trades import monthly, performance, session_of

    performance(trades, "strategy", "symbol").createOrReplaceTempView("v_strategy_performance")
    performance(trades.withColumn("session", session_of(F.col("entry_time"))), "strategy", "session").createOrReplaceTempView("v_session_performance")
    monthly(trades).createOrReplaceTempView("v_monthly_performance")


def write_results(results: DataFrame, path: str, *by: str) -> None:
    """K8: result rows as JSON documents, one a line, in folders by their keys; the rows of a key that is written again are replaced."""
    results.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").json(path)
