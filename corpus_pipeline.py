"""Five stages that turn raw documents into sharded training data; each works on all that the stage before it kept.

Defined results: rows with a null text go with the quality rules (no words), as do empty ones; very long texts are taken whole; rows that repeat a doc_id stay
once, those without one by their text; ties between copies go to the smallest doc_id; an empty table gives an empty result; every stage but the last
returns the columns of its input, extra ones included, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import bitmap, maybe_among, saved, spent, table
from tapeline.llm.decontaminate import drop_contaminated
from tapeline.llm.mixing import mixed
from tapeline.llm.neardup import near_duplicates
from tapeline.llm.quality_rules import drop_low_quality
from tapeline.llm.sharding import shard_by_bytes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rules or lost too much."""
    return drop_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, once: of rows that repeat a doc_id the one of the smallest text hash. Rows without a doc_id stay, of equal texts one."""
    found = near_duplicates(docs)
    gone = saved(found.where("NOT kept").select("doc_id").distinct(), "gone")
    marks = bitmap(gone, "doc_id")
    left = maybe_among(docs, F.col("doc_id"), marks, among=False).union(maybe_among(docs, F.col("doc_id"), marks).join(gone, "doc_id", "left_anti").select(*docs.columns))
    name = f"again_{uuid.uuid4().hex}"  # a name that no column of docs has
    twice = saved(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), "repeated")
    spent(found)
    if twice.isEmpty():
        return left
    marks = bitmap(twice, name)
    again = maybe_among(left, F.col("doc_id"), marks)
    same = F.col("doc_id").eqNullSafe(F.col(name))
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    order = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = again.join(twice, same, "left_semi").select(F.col("doc_id").alias("id"), mark.alias("mark"), F.struct(*docs.columns).alias("row"))
    rows = rows.groupBy("id", F.when(F.col("id").isNull(), F.col("mark")).alias("text")).agg(F.min_by("row", F.struct("mark", *[F.col("row").getField(c) for c in order])).alias("row"))
    first = rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return maybe_among(left, F.col("doc_id"), marks, among=False).union(again.join(twice, same, "left_anti")).union(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark phrase go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return shard_by_bytes(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: None: the stages' results depend on a minhash join and repeated rows that SQL gives too slowly; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
