"""Near-duplicate documents by MinHash with tensored banding, confirmed on the full shingle sets.

A document's set is its distinct `shingle`-word shingles (A-Z lower-cased, split at ASCII white space).  Equal sets are folded into
one node first, so that copies cost nothing further.  Each set gets one sketch of 2 * `groups` * `keys` * `rows` minima (each element goes to a
random place per round until all places are taken, so a sketch costs about one pass over the set).  They form `groups` pairs of
collections of `keys` short keys of `rows` minima; a table key is a pair (A_i, B_j) from the two collections of a group, so
groups * keys ** 2 tables come from the hashing of 2 * groups * keys short keys.

Only short keys that two sets share are paired up.  In each table every member is compared, by sketch, with one leader (the member with most keys),
so a group of copies costs its size, not its square.  Tables whose members are then still in several parts are compared inside bounded blocks:
what is not in the largest part against all, and only a spanning forest of alike sketches leaves the task.  The components of all this are
clusters.  Inside a cluster links are confirmed on the whole sets.  A cluster of more than `block` members is first held against single
hubs (the members with most alike sketches), whose set goes to every block and every member's text to one; what the hubs leave in several
parts is then compared in blocks as above, each member outside the largest part with all others.  Small clusters are one block.
Components come from repeated contraction of the links; nothing of them goes to the driver.

Chances: with 4 rows, 6 keys and 4 groups a pair of similarity exactly 0.8 shares no table with a chance of 5e-5; sketches leave out only pairs
over `margin` standard errors below the threshold, which a pair of exactly 0.8 is with a chance of about 1e-5 at 4.5.  Pairs that a third copy joins have more ways.

Texts of cluster members are fetched by a join that a bitmap of their ids (at most 32 MB, `common.maybe_among`) spares most other texts; it decides nothing.

Defined results: a text that is null, empty or only white space has an empty set and links with nothing; fewer words than a shingle
make one shingle; very long texts are taken whole, and a block holds fewer of them; equal sets (repeated rows among them) are one class; rows of one
doc_id are one document, which has the links of all its texts; rows with a null doc_id are kept and link with nothing (component_id null); an empty
table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_among, saved, spent, table

_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_C = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = min(n, k)
    h = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        h = h * _C + w[i : n - m + 1 + i]
    return np.unique(_mix(h))


def sketches(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Row i: the low 16 bits of the minima of set i. Round r < places deals each element to a random place, round r >= places to place r - places; only places still empty before a round take part in it."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    item, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), size)
    best = np.full(n * places, _FULL)
    for r in range(2 * places):
        if not len(item):
            break
        h = _mix(item ^ np.uint64((r + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        h = _mix(h * _C)
        at = owner * places + ((h >> np.uint64(40)).astype(np.int64) % places if r < places else r - places)
        free = best[at] == _FULL
        np.minimum.at(best, at[free], h[free] >> np.uint64(1))
        open_ = (best == _FULL).reshape(n, places).any(axis=1)
        go = open_[owner]
        item, owner = item[go], owner[go]
    return best.reshape(n, places).astype(np.uint16)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch], k: int, places: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            rows = sketches(sets, places)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, rows, strict=True)], pa.binary()),
                ],
                schema=_SETS,
            )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (x, y). Every round each node points to the smallest node around it, pointers are followed to their roots, and the links are contracted to links of roots; both loops take logarithmically many steps."""
    edges = edges.where("x != y").select("x", "y")
    labels = None
    while True:
        both = saved(edges.union(edges.select("y", "x")).distinct(), "links")
        step = saved(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("to")), "step")
        if step.isEmpty():
            spent(both)
            return labels if labels is not None else step.select(F.col("x").alias("node"), F.col("to").alias("label"))
        while True:  # follow the pointers to their roots: each join doubles the reach
            far = saved(step.join(step.select(F.col("x").alias("to"), F.col("to").alias("next")), "to").select("x", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "step")
            spent(step)
            step = far
            if far.where("moved").isEmpty():
                break
        to = step.select(F.col("x").alias("label"), "to")
        before = labels
        found = step.select(F.col("x").alias("node"), F.col("to").alias("label")) if before is None else before.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = saved(found, "labels")
        a, b = step.select("x", F.col("to").alias("x2")), step.select(F.col("x").alias("y"), F.col("to").alias("y2"))
        edges = saved(both.where("x < y").join(a, "x").join(b, "y").where("x2 != y2").select(F.col("x2").alias("x"), F.col("y2").alias("y")), "contracted")
        spent(both, step, before)
        if edges.isEmpty():
            spent(edges)
            return labels


def _alike(batches: Iterator[pa.RecordBatch], places: int, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, sketch of x, sketch of y) whose sketches agree in enough places."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, places) for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= least))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from sorted batches; holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(c).to_pylist() for c in range(keys)), strict=True))
        begin = 0
        for k, mark in enumerate(marks):
            if mark != last:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], k, mark
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


_HELD = 16_000_000  # shingles that a task keeps of the sets it has made of texts


def _tied(batches: Iterator[pa.RecordBatch], places: int, least: float, percent: int, shingle: int | None) -> Iterator[pa.RecordBatch]:
    """Of each group (k, p, q, role, set_id, label, n_shingles, sketch[, text]) links that join its labels, a spanning forest of them.

    Rows of role 0 meet those of role 1, or each other where there is no role 1.  A link: labels not yet joined, sketches alike, sizes that
    allow it; with a shingle length also: confirmed on the whole sets."""
    for group in _groups(batches, 3):
        role = group.column("role").to_numpy()
        rows = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, places)
        ids, size = group.column("set_id").to_numpy(), group.column("n_shingles").to_numpy()
        part = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
        one, two = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        alone = not len(two)
        texts = group.column("text") if shingle else None
        sets: dict[int, np.ndarray] = {}
        held, xs, ys = 0, [], []

        def full(i: int, texts=texts, sets=sets) -> np.ndarray:
            nonlocal held
            if i not in sets:
                if held > _HELD:
                    sets.clear()
                    held = 0
                sets[i] = shingle_set(texts[i].as_py(), shingle)
                held += len(sets[i])
            return sets[i]

        for at in range(0, len(one), 64):
            found = []
            for n, i in enumerate(one[at : at + 64], at):
                js = one[n + 1 :] if alone else two
                js = js[(part[js] != part[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
                if len(js):
                    s = (rows[js] == rows[i]).sum(axis=1)
                    ok = s >= least * places
                    found.append(np.column_stack([places - s[ok], np.full(int(ok.sum()), i), js[ok]]))
            if not found:
                continue
            pairs = np.concatenate(found)
            for i, j in pairs[np.argsort(pairs[:, 0], kind="stable"), 1:].tolist():
                if part[i] == part[j]:
                    continue
                if shingle:
                    a, b = full(i), full(j)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both < percent * (len(a) + len(b) - both):
                        continue
                part[part == part[j]] = part[i]
                xs.append(int(ids[i]))
                ys.append(int(ids[j]))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])


def _sided(rows: DataFrame) -> DataFrame:
    """rows (k, label, n_shingles, ...) of the k that have several labels, with n and w (rows and shingles of the k), m and v (of those outside its largest label) and b (outside it)."""
    per = rows.groupBy("k", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    per = per.groupBy("k").agg(F.max(F.struct("c", "s", "label")).alias("top"), F.sum("c").alias("n"), F.sum("s").alias("w")).where("top.c < n")
    per = per.select("k", "n", "w", (F.col("n") - F.col("top.c")).alias("m"), (F.col("w") - F.col("top.s")).alias("v"), F.col("top.label").alias("_top"))
    return rows.join(per, "k").withColumn("b", F.col("label") != F.col("_top")).drop("_top")


def _dealt(rows: DataFrame, block: int, heavy: int, columns: list[str], *, sides: bool = False) -> DataFrame:
    """rows (k, n, w, m, v, b, set_id, ...) dealt to groups (k, p, q) of about `block` rows and `heavy` shingles a side: each row with b meets every other row of its k in one of them.

    A row lies in one of the n / block rows of groups (role 0), and those with b also in one of the m / block columns (role 1). A k that fits
    one group needs no role 1. sides: those with b have role 1 only, always."""
    p_count = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / heavy), F.lit(1)).cast("int")
    q_count = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("v") / heavy), F.lit(1)).cast("int")
    at = rows.withColumn("_pn", p_count).withColumn("_qn", F.when(p_count == 1, 1).otherwise(q_count))
    at = at.withColumn("_p", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("_pn")).cast("int")).withColumn("_q", F.pmod(F.xxhash64("set_id", F.lit(8)), F.col("_qn")).cast("int"))
    across = F.expr("transform(sequence(0, _qn - 1), j -> struct(_p AS p, j AS q, 0 AS role))")
    down = F.expr(f"IF(b AND ({str(sides).lower()} OR _pn > 1), transform(sequence(0, _pn - 1), i -> struct(i AS p, _q AS q, 1 AS role)), array())")
    at = at.withColumn("_at", F.explode(F.concat(F.when(F.lit(sides) & F.col("b"), F.array()).otherwise(across), down))).select("k", "_at.p", "_at.q", "_at.role", *columns)
    return at.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, percent: int = 80, rows: int = 4, keys: int = 6, groups: int = 4, block: int = 2048, heavy: int = 2_000_000, hubs: int = 3, margin: float = 4.5) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links of 100 * intersection >= percent * union), kept."""
    half = keys * groups  # short keys of A; as many of B
    places = 2 * half * rows
    least = percent / 100 - margin * (percent / 100 * (1 - percent / 100) / places) ** 0.5
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = saved(docs.mapInArrow(lambda b: _sketched(b, shingle, places), "doc_id long, n_shingles long, fp binary, sketch binary"), "sketches")
    folded = sketched.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("set_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = saved(folded, "nodes")
    sets = saved(sketched.select("doc_id", "n_shingles", "fp"), "sets")
    spent(sketched)

    # the short keys that another set has too, then the table keys made of them: A_i with B_j of the same group of collections
    short = nodes.select("set_id", F.expr(f"posexplode(transform(sequence(0, {2 * half - 1}), i -> xxhash64(substring(sketch, i * {2 * rows} + 1, {2 * rows}), i))) AS (i, k)"))
    twice = short.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    own = short.join(twice, "k").groupBy("set_id").agg(F.collect_list(F.struct(F.pmod("i", F.lit(groups)).alias("g"), (F.col("i") < half).alias("a"), "k")).alias("ks"))
    tabled = own.select("set_id", F.expr("array_distinct(flatten(transform(filter(ks, x -> x.a), x -> transform(filter(ks, y -> NOT y.a AND y.g = x.g), y -> xxhash64(x.k, y.k))))) AS ts"))
    member = saved(tabled.select("set_id", F.size("ts").alias("weight"), F.explode("ts").alias("k")), "tables")
    heads = saved(member.groupBy("k").agg(F.count("*").alias("n"), F.max(F.struct("weight", "set_id")).alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("mark")).where("n > 1").select("k", "n", F.col("m.set_id").alias("leader"), "mark"), "heads")

    # clusters: what the sketches call alike, by leaders first and then within the tables that leaders leave in parts
    star = saved(member.join(heads.select("k", "leader"), "k").where("set_id != leader").select(F.least("set_id", "leader").alias("x"), F.greatest("set_id", "leader").alias("y")).distinct(), "stars")
    some = saved(star.select(F.col("x").alias("set_id")).union(star.select("y")).distinct(), "in-tables")
    cand = saved(maybe_among(nodes, F.col("set_id"), bitmap(some, "set_id")), "candidates")
    sketch = cand.select("set_id", "sketch")
    pairs = star.join(sketch.toDF("x", "sx"), "x").join(sketch.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
    near = saved(pairs.mapInArrow(lambda b: _alike(b, places, least), "x long, y long"), "alike")
    part = components(near)
    wide = heads.where("n > 2").groupBy("n", "leader", "mark").agg(F.min("k").alias("k"))  # tables with the same members are one; a table of two is settled
    left = saved(member.join(wide.select("k", "leader"), "k").where("set_id != leader").join(part.withColumnRenamed("node", "set_id"), "set_id", "left").select("k", "set_id", F.coalesce("label", "set_id").alias("label")), "left")
    spent(member, heads, star, some)
    several = left.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("k")
    split = saved(left.join(several, "k").join(cand.select("set_id", "n_shingles", "sketch"), "set_id"), "split")
    parts = _dealt(_sided(split), block, heavy, ["set_id", "label", "n_shingles", "sketch"])
    more = saved(parts.mapInArrow(lambda b: _tied(b, places, least, percent, None), "x long, y long"), "alike-within")
    cluster = components(near.union(more))
    spent(left, split)

    # inside each cluster the links, confirmed on whole sets
    size = cluster.join(cand.select("set_id", "n_shingles"), cluster["node"] == cand["set_id"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sized = saved(cluster.join(size, "label").select(F.col("label").alias("k"), "n", "w", F.col("node").alias("set_id")), "clusters")
    inside = sized.join(cand.select("set_id", "n_shingles", "sketch"), "set_id")
    fetched = maybe_among(docs, F.col("doc_id"), bitmap(sized, "set_id")).withColumnRenamed("doc_id", "set_id")
    columns = ["set_id", "label", "n_shingles", "sketch", "text"]

    def confirmed(dealt: DataFrame, name: str) -> DataFrame:
        return saved(dealt.mapInArrow(lambda b: _tied(b, places, least, percent, shingle), "x long, y long"), name)

    few = fetched.join(inside.where(F.col("n") <= block), "set_id").withColumns({"label": F.col("set_id"), "m": F.col("n"), "v": F.col("w"), "b": F.lit(True)})
    links = [confirmed(_dealt(few, block, heavy, columns), "confirmed")]
    if not sized.where(F.col("n") > block).isEmpty():
        links += _large_clusters(saved(fetched.join(inside.where(F.col("n") > block).drop("w"), "set_id").drop("n"), "large"), near.union(more), confirmed, block, heavy, hubs, columns)
    found = links[0]
    for one in links[1:]:
        found = found.union(one)
    labels = components(found)
    out = sets.join(nodes.select("fp", "set_id"), "fp", "left").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "set_id", "doc_id"))
    out = saved(out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "classes")
    spent(sets, nodes, cand, near, part, more, cluster, sized, labels, *links)
    return out


def _large_clusters(texts: DataFrame, alike: DataFrame, confirmed, block: int, heavy: int, hubs: int, columns: list[str]) -> list[DataFrame]:
    """Tables of confirmed links (x, y) that join all that is joined in clusters (k, set_id, n_shingles, sketch, text) of any size."""
    degree = alike.select(F.col("x").alias("set_id")).union(alike.select("y")).groupBy("set_id").agg(F.count("*").alias("degree"))
    rest = saved(texts.select("k", "set_id", "n_shingles").distinct().join(degree, "set_id", "left"), "not-tied")
    links: list[DataFrame] = []
    for _ in range(hubs):
        per = rest.groupBy("k").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.max(F.struct("degree", "set_id", "n_shingles")).alias("hub")).where("n > 1")
        per = per.select("k", "n", "w", F.lit(1).alias("m"), F.col("hub.n_shingles").alias("v"), F.col("hub.set_id").alias("hub"))
        rows = texts.join(rest.select("k", "set_id"), ["k", "set_id"]).join(per, "k").withColumns({"b": F.col("set_id") == F.col("hub"), "label": F.col("set_id")})
        links.append(confirmed(_dealt(rows, block, heavy, columns, sides=True), "confirmed-by-hubs"))
        tied = links[-1].select(F.col("x").alias("set_id")).union(links[-1].select("y")).union(per.select("hub")).distinct()
        before, rest = rest, saved(rest.join(tied, "set_id", "left_anti"), "not-tied")
        spent(before)
        if rest.isEmpty():
            break
    spent(rest)
    found = links[0]
    for one in links[1:]:
        found = found.union(one)
    own = components(found)
    labelled = texts.join(own.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    links.append(confirmed(_dealt(_sided(labelled), block, heavy, columns), "confirmed-across"))
    spent(texts, own)
    return links


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
