"""Positions against a window over the whole key."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.operators.ordering import positions


def test_positions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(30_000), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20_000)), rng.random(), 1) for _ in range(900)]
    rows += [("a", None, None, 0.5, 1)]
    df = spark.createDataFrame(rows, "key string, at int, time timestamp_ntz, v double, _n int")
    for order in ("at", "time"):
        got = positions(df, ["key"], order, ("v",)).withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy(order, "v"))).collect()
        assert len(got) == len(rows) and all(r.no == r.want for r in got)


def test_one_key_goes_to_many_tasks(spark):
    """With one key, no task of the numbering holds more than a quarter of the rows."""
    df = spark.range(40_000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("time"))
    out = positions(df.repartition(8, "key", F.to_date("time")), ["key"], "time").groupBy(F.spark_partition_id()).count().collect()
    assert len(out) >= 4 and max(r["count"] for r in out) <= 10_000 * 1.6
