"""Where intermediate results of iterative operators go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The checkpoint folder, set from the session's spark.checkpoint.dir where it is not yet; a temporary one in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tapeline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the folder that the session's spark.checkpoint.dir names, so that a lost executor costs its tasks only."""
    shared(df.sparkSession)
    return df.checkpoint()
