"""Positions in a series without a window over the whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096  # whole numbers of one bucket


def positions(df: DataFrame, by: list[str], order: str, ties: tuple[str, ...] = (), *, name: str = "no") -> DataFrame:
    """df with `name`, from 1 along `order` within `by`: the rows of earlier days (or spans of whole numbers), plus the place within the day.

    A key's rows go to as many tasks as it has days; only one count a day is added up along the key."""
    kind = dict(df.dtypes)[order]
    cell = F.to_date(order) if kind.startswith("timestamp") else F.col(order) if kind == "date" else F.floor(F.col(order) / SPAN)
    df = df.withColumn("_cell", cell)
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_cell").alias("_kc"), "_before")
    same = F.col("_cell").eqNullSafe(F.col("_kc"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order, *ties))
    return df.withColumn("_inside", inside).join(counts, same).withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_inside", "_before", "_cell", "_kc", *[f"_k{i}" for i in range(len(by))])


def ranked(df: DataFrame, by: list[str], order: str, sums: dict[str, str] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `no`, from 1 along any sortable `order` within `by`, and running sums (column: name) up to each row.

    Rows are dealt by ranges of (by, order, ties), so one key goes to many tasks; only a count and sums per range are added up along the key."""
    from ..functions.storage import cut

    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df.repartitionByRange(parts, *by, order, *ties).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_kp")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    totals = totals.select("_kp", *[f"_k{i}" for i in range(len(by))], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", *[f"_t{i}" for i in range(len(sums))])])
    same = F.col("_part") == F.col("_kp")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*by, "_part").orderBy(order, *ties)
    made = {"_no": F.row_number().over(w), **{f"_r{i}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i, c in enumerate(sums)}}
    out = df.withColumns(made).join(totals, same).withColumn("no", F.col("_no") + F.col("_n_before"))
    out = out.withColumns({name: F.col(f"_r{i}") + F.col(f"_t{i}_before") for i, name in enumerate(sums.values())})
    return out.select(*[c for c in df.columns if c != "_part"], "no", *sums.values())


def in_blocks(df: DataFrame, by: list[str], back: int, *, no: str = "no", block: int = 4096) -> DataFrame:
    """df with `_block` and `_halo`: each block of numbered rows, and before it the `back` rows that windows over (by, _block) look back to (drop those where _halo)."""
    df = df.withColumn("_block", F.floor((F.col(no) - 1) / block)).withColumn("_halo", F.lit(False))
    steps = max(1, -(-back // block))
    near = df.withColumn("_shift", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_block", F.col("_block") + F.col("_shift")).withColumn("_halo", F.lit(True))
    near = near.where(F.col(no) > F.col("_block") * block - back).drop("_shift")
    return df.union(near)


def greatest_before(df: DataFrame, by: list[str], value: str, *, no: str = "no", block: int = 4096, name: str = "before") -> DataFrame:
    """df with the greatest `value` of all rows with a smaller `no` within `by`; blocks of whole numbers carry one value each."""
    df = df.withColumn("_gb", F.floor(F.col(no) / block))
    up = Window.partitionBy(*by).orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*by, "_gb").agg(F.max(value).alias("_top")).select(*by, "_gb", F.max("_top").over(up).alias("_carried"))
    inside = Window.partitionBy(*by, "_gb").orderBy(no).rangeBetween(Window.unboundedPreceding, -1)
    return df.join(tops, [*by, "_gb"]).withColumn(name, F.greatest(F.max(value).over(inside), F.col("_carried"))).drop("_gb", "_carried")


def cooled(df: DataFrame, by: list[str], least: int, *, no: str = "no", block: int = 4096) -> DataFrame:
    """Of rows with whole numbers the first, and then each that lies `least` or more after the one taken before it.

    All that a stretch of numbers needs to know of what came before is how long it still has to wait, one of `least` values: a block is walked once for each of them, blocks
    are composed by these few numbers, and the walk that holds is kept.  Rows of one number stay or go together."""
    start = F.floor(F.col(no) / block) * block
    blocks = df.groupBy(*by, start.alias("_start")).agg(F.array_sort(F.collect_set(F.col(no).cast("long"))).alias("_nos"))

    def walk(wait: Column) -> Column:
        begin = F.struct((F.col("_start") + wait).alias("free"), F.array().cast("array<bigint>").alias("taken"))

        def step(s: Column, x: Column) -> Column:
            return F.when(x >= s["free"], F.struct((x + least).alias("free"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)

        return F.aggregate("_nos", begin, step)

    blocks = blocks.withColumn("_walks", F.array(*[walk(F.lit(w).cast("long")) for w in range(least)]))
    ends = F.sort_array(F.collect_list(F.struct("_start", F.transform("_walks", lambda x: x["free"]).alias("free"))))
    wait = lambda free, at: F.greatest(F.lit(0).cast("long"), free - at)
    first = F.struct(F.lit(None).cast("bigint").alias("free"), F.array().cast("array<bigint>").alias("waits"))

    def on(s: Column, x: Column) -> Column:
        w = F.coalesce(wait(s["free"], x["_start"]), F.lit(0).cast("long"))
        return F.struct(F.element_at(x["free"], (w + 1).cast("int")).alias("free"), F.array_append(s["waits"], w).alias("waits"))

    keys = blocks.groupBy(*by).agg(ends.alias("_ends")).withColumn("_waits", F.aggregate("_ends", first, on, lambda s: s["waits"]))
    chosen = keys.select(*by, F.explode(F.arrays_zip(F.transform("_ends", lambda x: x["_start"]).alias("s"), F.col("_waits").alias("w"))).alias("_z")).select(*by, F.col("_z")["s"].alias("_start"), F.col("_z")["w"].alias("_w"))
    kept = blocks.join(chosen, [*by, "_start"]).select(*by, F.explode(F.element_at("_walks", (F.col("_w") + 1).cast("int"))["taken"]).alias(no))
    return df.join(kept.withColumn(no, F.col(no).cast(dict(df.dtypes)[no])), [*by, no], "left_semi")
