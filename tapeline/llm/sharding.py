"""Contiguous shards of near equal bytes from global prefix sums, with DataFrame functions only.

The law is `bytes`.  Rows are ordered by (md5 of the text, doc_id), so that copies of a text lie side by side and land in one shard
unless a cut falls among them.  A range partitioning on both keys splits even one text that holds a third of all rows.  Each partition adds up
its bytes and rows; a prefix sum over those totals (one row per partition) gives every partition its start; running sums inside
the partitions give each row its global start, and the shard is start * shards / total.  Only keys and sizes are shuffled.
A shard misses its target by at most the size of one row.

Defined results: a null text has size 1 and checksum 0; very long texts are taken whole, so the shard around one may miss its target by its size; null
doc_ids sort first; rows alike in all keys (ties, repeated rows) are interchangeable, so reruns agree; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table


def shard_by_bytes(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = docs.select(F.col("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))
    order = ["mark", "doc_id", "size"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole.orderBy("part")).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum("size").over(inside)).withColumn("_n", F.count("*").over(inside)).join(F.broadcast(sums), "part")  # sums: one row per partition
    placed = placed.withColumn("_start", F.col("bytes_before") + F.col("_end") - F.col("size")).withColumn("_row", F.col("rows_before") + F.col("_n") - 1)
    placed = saved(placed.select("doc_id", "size", "text_crc32", F.expr(f"CAST(_start * {shards}L div total AS INT)").alias("shard"), "_row"), "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    placed = placed.join(F.broadcast(first), "shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_shard_by_bytes(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
