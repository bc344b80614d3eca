"""Mixing of sources to target weights by hash-threshold histograms, with DataFrame functions only.

Sources in code point order, null last, get the weights in turn; the targets share out all words by weight, and no source gets more than
`most` times what it has: the excess is shared out again by weight (a water level found with one pass over the sorted sources).
A source with target / size = k + f gives every document k times and, once more, the documents whose hash lies below a threshold.  The
threshold comes from sums by source and hash bucket: the first `coarse` hex digits of the hash find the boundary bucket, only
that bucket is summed again by `fine` further digits.  Nothing is sorted by document; the thresholds of the same
hash are nested, so a smaller budget takes a subset.  The extra words miss the budget by at most half a fine bucket.

Defined results: a null text has size 0; very long texts are taken whole; a null source is a source of its own, sorted last; the hash is of doc_id and
text, so repeated rows are taken alike, while different texts of one doc_id (or of none) are not; an empty table gives an empty result; sources of
size 0 have target 0; other columns are kept by `mixed` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, saved, table


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """From (source, source_size) to (source, source_size, target). One row per source, so one task sorts them."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(rest))
    df = df.withColumn("open", F.col("cap") * F.col("ws") >= F.col("left") * F.col("w"))  # the level at this source does not pass its cap
    df = df.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "source", "left", "ws"))).over(whole))
    share = F.col("w") * F.col("level.left") / F.col("level.ws")
    return df.select("source", "source_size", F.when(F.col("cap") * F.col("level.ws") >= F.col("level.left") * F.col("w"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mixing_plan(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, coarse: int = 3, fine: int = 5) -> DataFrame:
    """A row per source: source_size, target, times (whole repeats), high and low (the threshold: hashes below it are taken once more). sized: source, size, hash."""
    digits = lambda a, n: F.conv(F.substring("hash", a, n), 16, 10).cast("long")
    hist = saved(sized.groupBy("source", digits(1, coarse).alias("b")).agg(F.sum("size").alias("s")), "histogram")
    plan = targets(hist.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = saved(plan.withColumn("extra", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long")), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = plan.select(F.col("source").alias("_s"), "extra")
    edge = hist.join(p, F.col("source").eqNullSafe(F.col("_s"))).withColumn("c", F.sum("s").over(run)).where("c > extra")
    edge = saved(edge.groupBy(F.col("source").alias("_s")).agg(F.min_by(F.struct("b", (F.col("extra") - F.col("c") + F.col("s")).alias("room")), "b").alias("e")).select("_s", F.col("e.b").alias("high"), F.col("e.room").alias("room")), "boundary")
    inner = sized.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (digits(1, coarse) == F.col("high"))).groupBy("_s", "room", digits(coarse + 1, fine).alias("b")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("_s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearer = (2 * (F.col("c") - F.col("room")) < F.col("s")).cast("long")  # with the bucket that crosses the budget, or without
    low = inner.withColumn("c", F.sum("s").over(run)).where("c > room").groupBy("_s").agg(F.min_by(F.col("b") + nearer, "b").alias("low"))
    out = plan.join(edge.select(F.col("_s").alias("_e"), "high"), F.col("source").eqNullSafe(F.col("_e")), "left").join(low, F.col("source").eqNullSafe(F.col("_s")), "left")
    return saved(out.select(F.col("source").alias("_source"), "source_size", "target", "times", F.coalesce("high", F.lit(16**coarse)).alias("high"), F.coalesce("low", F.lit(16**fine)).alias("low")), "plan")


def _hash() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))


def _taken(docs: DataFrame, slim: DataFrame, coarse: int = 3, fine: int = 5, **options) -> DataFrame:
    """docs (with _src, _hash), its source's plan, and n_taken, the times the mix takes the row. slim: _src, _size, _hash of all rows."""
    plan = mixing_plan(slim.select(F.col("_src").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash")), coarse=coarse, fine=fine, **options)
    df = docs.join(plan, F.col("_src").eqNullSafe(F.col("_source")))
    b, c = F.conv(F.substring("_hash", 1, coarse), 16, 10).cast("long"), F.conv(F.substring("_hash", coarse + 1, fine), 16, 10).cast("long")
    return df.withColumn("n_taken", F.col("times") + ((b < F.col("high")) | ((b == F.col("high")) & (c < F.col("low")))).cast("long"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    slim = saved(docs.select("doc_id", F.col("source").alias("_src"), n_words(F.col("text")).alias("_size"), _hash().alias("_hash")), "sizes")
    return _taken(slim, slim, **options).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("n_taken") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs, each row as often as it is taken."""
    mark = _hash()
    slim = saved(docs.select(F.col("source").alias("_src"), n_words(F.col("text")).alias("_size"), mark.alias("_hash")), "sizes")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_src"), mark.alias("_hash"))
    taken = _taken(rows, slim, **options).where("n_taken > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_taken"))))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 8) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
a AS (SELECT *, 3 * n AS cap, CAST(sum(n) OVER () AS BIGINT) - CAST(coalesce(sum(3 * n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM s),
l AS (SELECT rest, ws FROM a WHERE cap * ws >= rest * w ORDER BY n / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, n, CASE WHEN cap * l.ws >= l.rest * w THEN CAST(w * l.rest AS DOUBLE) / CAST(l.ws AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target FROM a, l),
k AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS times FROM t),
x AS (SELECT *, CAST(floor(target - times * n) AS BIGINT) AS extra FROM k),
c AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, x.n AS source_size, x.target, CAST(d.size * (x.times + CASE WHEN c.upto <= x.extra OR c.upto - c.s <= x.extra AND 2 * (c.upto - x.extra) < c.s THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
