"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only in local mode where the session names none (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tapeline-")
        sc.setCheckpointDir(where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors, and gives Spark true sizes.

    The tables are managed ones of a database in that folder, so that `spent` can drop them with their files."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/tapeline-tables"
    base = "tapeline_" + hashlib.md5(where.encode()).hexdigest()[:12]
    place = where.replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{place}'")
    full = f"{base}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").saveAsTable(full)
    out = spark.table(full)
    out._tapeline_table = full
    return out


def spent(*tables: DataFrame | None) -> None:
    """Drop tables of `saved` that nothing will read any more; what else is given stays as it is."""
    for df in tables:
        full = getattr(df, "_tapeline_table", None)
        if full:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {full}")


#: A bitmap of ids that is broadcast has between these powers of two bits: 128 KB to 32 MB, whatever the number of ids.
FEWEST_BITS, MOST_BITS = 20, 28
_CELL = 32768  # bits of one row of the bitmap


def bitmap(ids: DataFrame, column: str, *, several: bool = False) -> tuple[DataFrame, int]:
    """The hashes of the ids as a table of bits, and its number of bits: about sixteen for each id, MOST_BITS at most. Ids are dealt by cell first, so a task makes only its own cells.

    several: ids may repeat; `_several` has the bits that more than one row has set, and `_top` the most rows of one bit in a cell."""
    bits = 1 << min(MOST_BITS, max(FEWEST_BITS, (16 * ids.count()).bit_length()))
    rows = ids.select(_place(F.col(column), bits).alias("_p")).select(F.shiftright("_p", 15).alias("_cell"), F.col("_p").bitwiseAND(_CELL - 1).alias("_bit")).repartition("_cell")
    if not several:
        return rows.groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_b")).select("_cell", _numbers("_b").alias("_bits")), bits
    rows = rows.groupBy("_cell", "_bit").agg(F.count("*").alias("_n"))
    cells = rows.groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_b"), F.bitmap_construct_agg(F.when(F.col("_n") > 1, F.col("_bit"))).alias("_c"), F.max("_n").alias("_top"))
    return cells.select("_cell", _numbers("_b").alias("_bits"), _numbers("_c").alias("_several"), "_top"), bits


def _numbers(column: str) -> Column:
    """A bitmap's bytes as numbers of 32 bits, which are cheap to look up."""
    whole = f"transform(sequence(0, {_CELL // 32 - 1}), i -> CAST(conv(hex(substring({column}, 4 * i + 1, 4)), 16, 10) AS BIGINT))"
    return F.expr(f"transform({whole}, v -> CAST(IF(v >= 2147483648, v - 4294967296, v) AS INT))")


def _place(column: Column, bits: int) -> Column:
    return F.xxhash64(column, F.lit(77)).bitwiseAND(F.lit(bits - 1).cast("long"))


def maybe_among(df: DataFrame, column: Column, marks: tuple[DataFrame, int], *, among: bool = True, several: Column | None = None) -> DataFrame:
    """The rows of df whose column may be one of the ids of `marks` (or, among=False, is none of them); where `several` holds, one of those that stand there twice.

    Nothing but the bitmap of bounded size moves.  It only spares an exact join rows that it cannot need: a full bitmap lets all rows pass."""
    rows, bits = marks
    own = uuid.uuid4().hex  # names that no column of df has
    rows, place = rows.withColumnsRenamed({c: f"{c}_{own}" for c in rows.columns}), f"_place_{own}"
    df = df.withColumn(place, _place(column, bits))
    word = lambda c: F.expr(f"{c}_{own}[CAST(shiftright({place}, 5) & 1023 AS INT)]")
    found = word("_bits") if several is None else F.when(several, word("_several")).otherwise(word("_bits"))
    bit = F.expr(f"shiftleft(1, CAST(24 - ({place} & 24) + ({place} & 7) AS INT))")  # bytes are in order, bits in a byte from the lowest
    hit = found.bitwiseAND(bit) != 0
    return df.join(F.broadcast(rows), (F.shiftright(place, 15) == F.col(f"_cell_{own}")) & hit, "left_semi" if among else "left_anti").drop(place)


def lowered(text):
    """A-Z to a-z and nothing else (lower() would also change other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    """The words of a text column as an array; null has none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))  # nothing to split off at the ends, so no empty parts
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def n_words(text):
    """Count of words."""
    return F.size(words(text)).cast("long")
