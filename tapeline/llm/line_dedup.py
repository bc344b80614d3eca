"""Line dedup by a segment-partition edit join.

Lines are split at newlines and trimmed of ASCII white space; blank lines are left alone.  Equal lines are one node.  Lines of at least
`min_chars` letters are linked within edit distance `distance`: an indexed line is cut into distance + 1 even segments, of which one must stand
unchanged in any line that near; a probing line looks up, for each possible length, only those substrings that can be that segment (length-aware
multi-match windows).  A probe whose key no other line has in the index, by a bitmap of bounded size, is not sent.  A join row also carries 64 parity
bits over the line's bigrams, of which an edit flips at most four; pairs that differ in more cannot be near and never leave the join, so a
segment that thousands of lines share does not give all their pairs.  A key that more than `hot` index lines share is not joined as it is: what is left of its
lines without the segment lies within the same distance, so the key is extended by a segment of the rest in the same way, again and again until no key is crowded or the
rest is too short to be cut.  Keys that stay crowded even then are dealt to as many tasks as they have `hot` lines, and their probes go to each.  The remaining pairs are verified by a banded bit-parallel edit distance.  Classes are the connected
components; of a class the occurrence first by (doc_id, line number) stays, all others are removed.

Defined results: null and blank texts have no lines; lines of fewer than `min_chars` letters (by default distance + 1, as shorter ones are within the
distance of any other) link only when equal; very long texts and lines are taken whole; rows of one doc_id are one document (give them one text; rows
that repeat a document whole count as copies, and lines of the same place are the same line); a null doc_id takes no part and keeps its text; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_among, saved, spent, table
from .neardup import components

_PLACES = 1 << 31  # more lines than an array of them can have
TRIM = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- edit distance


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: common ends are cut off, then a band of 64 diagonals runs over the rest (k up to 31)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    while end > start and a[end + len(a) - len(b) - 1] == b[end - 1]:
        end -= 1
    a, b = a[start : end + len(a) - len(b)], b[start:end]
    if not b or len(a) <= k:
        return len(a) <= k
    full = (1 << 64) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    vp, vn, now, shift, across = full << (63 - k) & full, 0, k, k + 1 - 64, 1 << 62
    most = k + len(b) - (len(a) - k)
    for i, c in enumerate(b):
        bits = at.get(c, 0)
        x = (bits >> shift if shift >= 0 else bits << -shift) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if i < len(a) - k:
            now += not d0 >> 63
            if now > most:
                return False
        else:
            now += bool(hp & across)
            now -= bool(hn & across)
            across >>= 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        shift += 1
    return now <= k


# ---------------------------------------------------------------- segments


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 even segments of a line of n letters."""
    out, start, small = [], 0, (k + 1) - n % (k + 1)
    for i in range(k + 1):
        size = n // (k + 1) + (i >= small)
        out.append((start, size))
        start += size
    return out


def probes(n: int, k: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, length, whether it is the line's own segment) that a line of n letters must look up to meet all lines of n - k to n letters."""
    out = []
    for m in range(max(k + 1, n - k), n + 1):
        gap = n - m
        for i, (p, size) in enumerate(segments(m, k)):
            low = max(0, p - i, p + gap - (k - i))
            high = min(n - size, p + i, p + gap + (k - i))
            out += [(m, i, s, size, not gap and s == p) for s in range(low, high + 1)]
    return out


def parities(lines: list[str]) -> np.ndarray:
    """Of each line 64 parity bits of its bigrams."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    bits = np.zeros(len(codes) + 1, np.uint64)
    if len(codes) > 1:
        h = (codes[:-1] * np.uint64(0x9E3779B1) ^ codes[1:] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F)
        bits[: len(codes) - 1] = np.uint64(1) << (h >> np.uint64(58))
        bits[ends[size > 0] - 1] = 0  # a pair across two lines
    out = np.zeros(len(lines), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(bits[: len(codes)], (ends - size)[some])
    return out.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` lines and, but for single longer lines, about `size` bytes of them."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = size + (int(ends[at - 1]) if at else 0)
            upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(at, upto - at)
            at = upto


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parities(batch.column(0).to_pylist()))], ["line", "doc", "pos", "n", "sig"])


def _cut(batches: Iterator[pa.RecordBatch], k: int, probing: bool) -> Iterator[pa.RecordBatch]:
    """Index or probe rows (key, doc, pos, sig, own) of distinct lines."""
    plan: dict[int, list] = {}
    for batch in _slices(batches):
        keys, own, times = [], [], np.zeros(batch.num_rows, np.int64)
        for row, line in enumerate(batch.column(0).to_pylist()):
            n = len(line)
            if n not in plan:
                if len(plan) > 5000:
                    plan.clear()
                plan[n] = probes(n, k) if probing else [(n, i, p, s, True) for i, (p, s) in enumerate(segments(n, k))]
            keys += [xxhash.xxh3_64_intdigest(line[p : p + s].encode("utf-8", "surrogatepass"), m * (k + 1) + i) for m, i, p, s, _ in plan[n]]
            own += [x[4] for x in plan[n]]
            times[row] = len(plan[n])
        again = pa.array(np.repeat(np.arange(batch.num_rows), times))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *(batch.column(c).take(again) for c in (1, 2, 3)), pa.array(own, pa.bool_())], ["key", "doc", "pos", "sig", "own"])


def _recut(batches: Iterator[pa.RecordBatch], k: int, probing: bool) -> Iterator[pa.RecordBatch]:
    """Index or probe rows (rest, key, doc, pos, sig, ended) of lines or rests with a key: the key extended by a segment, and what is left without it.

    Rests that are too short to be cut have one key, which probes of up to twice the distance share with them."""
    plan: dict[int, list] = {}
    for batch in _slices(batches, rows=500):
        rests, keys, ended, times = [], [], [], np.zeros(batch.num_rows, np.int64)
        for row, (text, old) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            n, salt = len(text), b"" if old is None else old.to_bytes(8, "little", signed=True)
            if n not in plan:
                if len(plan) > 5000:
                    plan.clear()
                plan[n] = [x[:4] for x in probes(n, k)] if probing else [(n, i, p, s) for i, (p, s) in enumerate(segments(n, k))] if n > k else []
            out = plan[n]
            keys += [xxhash.xxh3_64_intdigest(text[p : p + s].encode("utf-8", "surrogatepass") + salt, m * (k + 1) + i) for m, i, p, s in out]
            rests += [text[:p] + text[p + s :] for _, _, p, s in out]
            short = n <= (2 * k if probing else k)
            if short:
                keys.append(xxhash.xxh3_64_intdigest(salt, (1 << 40) + k))
                rests.append("")
            ended += [False] * len(out) + [True] * short
            times[row] = len(out) + short
        again = pa.array(np.repeat(np.arange(batch.num_rows), times))
        yield pa.RecordBatch.from_arrays([pa.array(rests, pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64)), *(batch.column(c).take(again) for c in (2, 3, 4)), pa.array(ended, pa.bool_())],
            ["rest", "key", "doc", "pos", "sig", "ended"])


def _dealt(probe: DataFrame, index: DataFrame, hot: int) -> DataFrame:
    """probe join index by key; keys with more than `hot` index rows are dealt to several tasks."""
    often = saved(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("s")), "hot-segments")
    if often.isEmpty():
        return probe.join(index, "key")
    parts = probe.join(often, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))).drop("s")
    dealt = index.join(often, "key", "left").withColumn("part", F.pmod(F.xxhash64("xd", "xp"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
    return parts.join(dealt, ["key", "part"])


def _crowded(long: DataFrame, index: DataFrame, probe: DataFrame, often: DataFrame, k: int, hot: int, near_bits: Column, levels: int = 12) -> DataFrame:
    """Pairs that meet in crowded keys, by keys extended with segments of the rest until none is crowded."""
    key, kind = F.col("key"), "rest string, key long, doc long, pos int, sig long, ended boolean"
    marks = bitmap(often, "key")
    place = F.struct("doc", "pos")
    ids = maybe_among(index, key, marks).select(F.col("xd").alias("doc"), F.col("xp").alias("pos")).union(maybe_among(probe, key, marks).select("yd", "yp")).distinct()
    some = maybe_among(long, place, bitmap(saved(ids.select(place.alias("id")), "crowded-lines"), "id"))
    start = some.select(F.col("line").alias("rest"), F.lit(None).cast("long").alias("key"), "doc", "pos", "sig")
    xs, ys = (maybe_among(start.mapInArrow(lambda b, p=p: _recut(b, k, p), kind), key, marks) for p in (False, True))
    found = None
    for level in range(levels):
        columns = ("rest", "key", "doc", "pos", "sig")
        xs = saved(xs.select(*columns).mapInArrow(lambda b: _recut(b, k, False), kind), "extended-segments")
        ys = saved(maybe_among(ys.select(*columns).mapInArrow(lambda b: _recut(b, k, True), kind), key, bitmap(xs, "key")), "extended-probes")
        full = saved(xs.where("NOT ended").groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded-keys")
        last = full.isEmpty() or level == levels - 1
        marks = bitmap(full, "key")
        plain = [df if last else df.where("ended").union(maybe_among(df.where("NOT ended"), key, marks, among=False)) for df in (xs, ys)]
        x = plain[0].select("key", F.col("doc").alias("xd"), F.col("pos").alias("xp"), F.col("sig").alias("xs"))
        y = plain[1].select("key", F.col("doc").alias("yd"), F.col("pos").alias("yp"), F.col("sig").alias("ys"))
        met = _dealt(y, x, hot).where(near_bits).select("xd", "xp", "xs", "yd", "yp", "ys")
        found = met if found is None else found.union(met)
        if last:
            return found
        xs, ys = (maybe_among(df.where("NOT ended"), key, marks) for df in (xs, ys))
    return found


def _near(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select([0, 1]).filter(pa.array([within(a, b, k) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_()))


def _trimmed(line: Column) -> Column:
    """The line without ASCII white space at its ends. Most lines have none, and Spark's trim lays out every letter, so it is only called where an end asks for it."""
    ends = F.lit(False)
    for c in TRIM:
        ends = ends | line.startswith(c) | line.endswith(c)
    return F.when(ends, F.trim(line, F.lit(TRIM))).otherwise(line)


def line_classes(docs: DataFrame, *, distance: int = 2, min_chars: int | None = None, hot: int = 4096) -> DataFrame:
    """A row per distinct line: line, n (occurrences), first and class (both struct(doc, pos): first occurrence of the line, of its class), n_links (to other lines)."""
    if not 0 <= distance <= 31:
        raise ValueError("distance must be from 0 to 31: the verification's band has 64 diagonals")
    trimmed = _trimmed(F.col("line"))
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc", "pos", trimmed.alias("line")).where("line <> ''")
    place = F.col("doc").cast("decimal(38,0)") * F.lit(_PLACES).cast("decimal(18,0)") + F.col("pos")  # doc and pos as one number, which a hash aggregation can hold
    distinct = lines.groupBy("line").agg(F.min(place.cast("decimal(38,0)")).alias("first"), F.count("*").alias("n"))
    doc = F.floor(F.col("first") / F.lit(_PLACES).cast("decimal(18,0)")).cast("long")
    distinct = distinct.select("line", doc.alias("doc"), (F.col("first") - doc.cast("decimal(38,0)") * F.lit(_PLACES).cast("decimal(18,0)")).cast("int").alias("pos"), "n").mapInArrow(_signed, "line string, doc long, pos int, n long, sig long")
    distinct = saved(distinct, "lines")
    long = distinct.where(F.length("line") >= max(min_chars or 0, distance + 1)).select("line", "doc", "pos", "sig")
    kind = "key long, doc long, pos int, sig long, own boolean"
    every = saved(long.mapInArrow(lambda b: _cut(b, distance, False), kind).drop("own").toDF("key", "xd", "xp", "xs"), "all-segments")
    # a probe must find its key in the index, and a line's own segment must find one that several lines have
    rows, bits = bitmap(every, "key", several=True)
    marks = saved(rows, "segment-marks")
    probe = maybe_among(long.mapInArrow(lambda b: _cut(b, distance, True), kind), F.col("key"), (marks, bits), several=F.col("own"))
    probe = saved(probe.select("key", F.col("doc").alias("yd"), F.col("pos").alias("yp"), F.col("sig").alias("ys")), "probes")
    index = saved(maybe_among(every, F.col("key"), bitmap(probe, "key")), "segments")
    crowded = not marks.where(F.col("_top") > hot).isEmpty()
    near_bits = (F.bit_count(F.col("xs").bitwiseXOR(F.col("ys"))) <= 4 * distance) & ((F.col("xd") != F.col("yd")) | (F.col("xp") != F.col("yp")))
    often = saved(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot-segments") if crowded else None
    spent(every, marks)
    if often is None or often.isEmpty():
        met = probe.join(index, "key")
    else:
        hot_keys = bitmap(often, "key")
        plain = maybe_among(probe, F.col("key"), hot_keys, among=False).join(maybe_among(index, F.col("key"), hot_keys, among=False), "key")
        met = plain.select("xd", "xp", "xs", "yd", "yp", "ys").union(_crowded(long, index, probe, often, distance, hot, near_bits))
    x, y = F.struct(F.col("xd").alias("doc"), F.col("xp").alias("pos")), F.struct(F.col("yd").alias("doc"), F.col("yp").alias("pos"))
    pairs = saved(met.where(near_bits).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct(), "line-pairs")
    spent(probe, index, often)
    distinct = distinct.select("line", "n", F.struct("doc", "pos").alias("first"))
    # only lines of a pair are fetched and joined any further
    members = saved(pairs.select(F.col("x").alias("first")).union(pairs.select("y")).distinct(), "line-members")
    marks = bitmap(members, "first")
    some = saved(maybe_among(distinct, F.col("first"), marks), "lines-of-pairs")
    text = some.select("first", "line")
    both = pairs.join(text.toDF("x", "a"), "x").join(text.toDF("y", "b"), "y").select("x", "y", "a", "b")
    node = "struct<doc: bigint, pos: int>"
    links = saved(both.mapInArrow(lambda b: _near(b, distance), f"x {node}, y {node}"), "line-links")
    labels = components(links)
    spent(pairs)
    degree = links.select(F.col("x").alias("first")).union(links.select("y")).groupBy("first").agg(F.count("*").alias("n_links"))
    linked = some.join(labels.withColumnRenamed("node", "first"), "first", "left").join(degree, "first", "left").select("line", "n", "first", F.coalesce("label", "first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return linked.union(maybe_among(distinct, F.col("first"), marks, among=False).select("line", "n", "first", F.col("first").alias("class"), F.lit(0).cast("long").alias("n_links")))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, n_lines (not blank), n_removed, class_id (smallest doc_id that its lines' classes begin in), n_links (of its lines to other lines), removed (line numbers taken out)."""
    classes = saved(line_classes(docs, **options).where("n > 1 OR n_links > 0").select(F.md5(F.col("line").cast("binary")).alias("h"), "class", "n_links", F.xxhash64("line").alias("_x")), "line-classes")
    trimmed = _trimmed(F.col("line"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # only lines of classes with several occurrences travel; their hash stands for the text until both sides meet
    occ = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", trimmed.alias("line"))
    occ = maybe_among(occ, F.xxhash64("line"), bitmap(classes, "_x")).select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("h"))
    hit = occ.join(classes.drop("_x"), "h")
    per = hit.groupBy("doc_id").agg(F.min("class.doc").alias("class_id"), F.sum("n_links").alias("n_links"), F.sort_array(F.collect_set(F.when((F.col("class.doc") != F.col("doc_id")) | (F.col("class.pos") != F.col("pos")), F.col("pos")))).alias("removed"))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _trimmed(x) != ""))
    out = docs.select("doc_id", n_lines.cast("long").alias("n_lines")).join(per, "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("removed", F.expr("CAST(array() AS array<int>)")).alias("removed"))


def without_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the removed lines taken out of text; other columns stay as they are."""
    gone = dedup_lines(docs, **options).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed")).dropDuplicates(["_id"])
    left = docs.join(gone, docs["doc_id"] == gone["_id"], "left")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_removed"), i)), "\n"))
    return left.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "class_id", "n_links", F.sha2(F.array_join(F.col("removed").cast("array<string>"), ",").cast("binary"), 256).alias("removed_sha256"))
