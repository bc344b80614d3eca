"""Spelling variant grouping by asymmetric chunks and grams.

Words are counted per task and summed.  Two words are near if one inserted, deleted or replaced code point parts them.  A word of L letters contributes
two disjoint chunks of L // 2 letters (at 0 and at L // 2); the other word, of L or L + 1 letters, contributes its grams of that size.  One edit leaves at
least one of the two chunks whole, and moves it by at most one place: not at all in a word of the same length, by none or one in a longer one, so only grams
within that shift are looked up.  Words met in a join row are verified there.

A chunk that more than `hot` words share is not joined as it is: its key is extended by what one edit can leave of the rest (the rest without its i-th letter
for words of one length; the rest of the shorter word, and each rest of the longer one without one letter), so that even a chunk that a third of all words
share gives groups whose size is bounded by the alphabet.  Such keys are told apart by a bitmap of bounded size; the extended key is exact for any chunk.

A word's form is its near word of largest count, if that is at least `ratio` times its own (ties: first by code points); its root is reached by following
forms, found by pointer doubling: counts double at each step, so some six rounds reach the end.

Joins of words with words are merge joins by a hint: the size of a saved table is that of its compressed files, from which Spark would take one that comes out
many times larger for small enough to broadcast, and the driver would hold it.

Defined results: null texts have no words, a null doc_id reads as '' where edits are drawn; empty texts have none; very long texts and words are taken whole;
repeated rows count again; a text of a doc_id that stands twice draws the same edits; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_among, saved, spent, table

#: In Latin-1: A-Z become a-z, a-z and U+00C0 to U+00FF stay, everything else parts runs.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _edited(run: bytes, prefix: int, every: int) -> bytes:
    """The run as it is counted: where `every` divides its checksum in this document, one letter is missing."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def _runs(batches: Iterator[pa.RecordBatch], every: int | None, least: int, held: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of Latin-1 runs, summed over the task in slices of about `held` words."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = text.encode("latin-1", "replace").translate(_RUNS).split()
            if every is None:
                counts.update([r for r in runs if len(r) >= least])
            else:
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs).items():
                    if len(run) >= least:
                        word = _edited(run, prefix, every)
                        if len(word) >= least:
                            counts[word] += n
            if len(counts) >= held:
                yield out()
    if counts:
        yield out()


def word_counts(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, drop_every: int | None = None, held: int = 500_000) -> DataFrame:
    """word, n: the words of at least min_chars letters that stand min_count times or more. drop_every: see `_edited`."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL")
    counted = rows.mapInArrow(lambda b: _runs(b, drop_every, max(1, min_chars), held), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- near words


def _key(size: Column, chunk: Column, gram: Column) -> Column:
    return F.xxhash64(size, chunk, gram)


def _without(value: str, at: str) -> str:
    return f"concat(substring({value}, 1, {at}), substring({value}, {at} + 2))"


def _chunks(words: DataFrame) -> DataFrame:
    """key, rest of each word's two chunks."""
    rows = words.withColumn("size", F.length("word")).withColumn("q", F.expr("size div 2")).withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.col("chunk") * F.col("q")
    gram = F.col("word").substr(at + 1, F.col("q"))
    rest = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + F.col("q") + 1, F.col("size")))
    return rows.select(_key(F.col("size"), F.col("chunk"), gram).alias("key"), F.col("word").alias("x"), F.col("n").alias("xn"), rest.alias("rest"))


def _grams(words: DataFrame) -> DataFrame:
    """key, rest, longer of each word's grams that can be a chunk of a word of its own length (shift 0) or of one letter less (shift 0 or 1)."""
    spots = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(c).alias("chunk"), F.lit(s).alias("shift")) for d, c, s in ((0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1))])
    rows = words.withColumn("size", F.length("word")).withColumn("spot", F.explode(spots)).select("word", "n", "size", "spot.*")
    rows = rows.withColumn("q", F.expr("(size - longer) div 2")).withColumn("at", F.expr("chunk * q + shift")).where("at + q <= size")
    gram = F.col("word").substr(F.col("at") + 1, F.col("q"))
    rest = F.concat(F.col("word").substr(F.lit(1), F.col("at")), F.col("word").substr(F.col("at") + F.col("q") + 1, F.col("size")))
    return rows.select(_key(F.col("size") - F.col("longer"), F.col("chunk"), gram).alias("key"), F.col("word").alias("y"), F.col("n").alias("yn"), rest.alias("rest"), (F.col("longer") == 1).alias("longer"))


def _extended(rows: DataFrame, index: bool) -> DataFrame:
    """Rows of crowded keys once for each thing that one edit can leave of the rest."""
    places = "CASE WHEN length(rest) = 0 THEN CAST(array() AS array<int>) ELSE sequence(0, length(rest) - 1) END"
    gaps = f"transform({places}, i -> xxhash64(key, i, {_without('rest', 'i')}))"  # alike but for the i-th letter
    if index:
        keys = f"concat({gaps}, array(xxhash64(key, -1, rest)))"
    else:
        keys = f"IF(longer, array_distinct(transform({places}, i -> xxhash64(key, -1, {_without('rest', 'i')}))), {gaps})"
    return rows.withColumn("key", F.explode(F.expr(keys)))


def near_words(words: DataFrame, *, hot: int = 512) -> DataFrame:
    """x, xn, y, yn: each pair of words (word, n) that one edit parts, once."""
    index, grams = _chunks(words), _grams(words)
    crowded = saved(index.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded-chunks")

    def met(index: DataFrame, grams: DataFrame) -> DataFrame:
        pairs = index.drop("rest").hint("merge").join(grams.drop("rest"), "key").where("(longer OR x < y) AND levenshtein(x, y, 1) = 1")
        return pairs.select("x", "xn", "y", "yn")

    if crowded.isEmpty():
        return met(index, grams).distinct()
    marks, key = bitmap(crowded, "key"), F.col("key")
    plain = met(maybe_among(index, key, marks, among=False), maybe_among(grams, key, marks, among=False))
    return plain.union(met(_extended(maybe_among(index, key, marks), True), _extended(maybe_among(grams, key, marks), False))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) ends. Forms must not go in circles."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # only roots that are words with a form of their own can move; words that share a final root stay where they are
        marks = bitmap(now, "word")
        onward = now.select(F.col("word").alias("_word"), F.col("root").alias("_onward"))
        moving = maybe_among(now, F.col("root"), marks).hint("merge").join(onward, F.col("root") == F.col("_word"), "left")
        moved = saved(moving.select("word", F.coalesce("_onward", "root").alias("root"), F.col("_onward").isNotNull().alias("moved")), "moving-roots")
        if moved.where("moved").isEmpty():
            return now
        step = saved(maybe_among(now, F.col("root"), marks, among=False).union(moved.drop("moved")), "roots")
        spent(now, moved)
        now = step


def spelling_variants(docs: DataFrame, *, ratio: int = 2, hot: int = 512, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see `word_counts` for the options of counting)."""
    words = saved(word_counts(docs, **counting), "words")
    pairs = saved(near_words(words, hot=hot), "near-words")
    sides = pairs.toDF("word", "n", "near", "near_n").union(pairs.select("y", "yn", "x", "xn"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near.hint("merge"), "word", "left").withColumn("best", F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")))
    near = saved(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")), "word-forms")
    spent(pairs)
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), drop_every=97)
