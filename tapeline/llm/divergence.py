"""Source divergence audit by Gustavson row accumulation.

Each task counts terms and the documents that hold them per (lang, source) and gives its sums in slices; terms in enough documents of their lang are kept.
A group's share of a term is p = 1 + floor(scale * (count + 5) / (N + 5 V)), so a group without the term has a baseline share of its own, not zero.

Distances of all sources of a lang: kept terms are dealt by hash to blocks of a tenth of `block` to `block` postings (a posting: a source that has the
term), more where there are many sources and so many sums, so a hot lang or term set goes to as many tasks as it needs.  A block holds its postings twice, by term (the index) and by source.  For each source the task
goes through its terms, takes each term's list from the term-major index and scatters the differences into one dense accumulator over all
peers; no pair of postings leaves the task, only sums per pair of sources.  What the lists lack is corrected: of terms that only one side has, the
difference to the other's baseline comes from sorted shares and prefix sums; terms that neither has give the difference of the baselines times
their number.  Where a lang has very many sources, a block's rows are dealt to tiles of at most `pairs` sums.  Sums stay below 2^53 (shares add up to about
2 * scale), so they are exact in doubles too.

Defined results: null text, lang and source are ''; very long texts are taken whole; repeated rows count again; ties rank by the item's UTF-8 bytes; a
lang whose V is 0 has distances of 0 and no terms, and one with a single source has no pairs; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, maybe_among, saved, spent, table

#: Letters and all non-ASCII signs stay, A-Z become a-z, everything else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed over the task in slices of about `held` terms."""
    names, kinds = ["lang", "source", "term", "n", "docs"], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            counts = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()).cast(kinds[2]), *counts], names)
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode("utf-8", "surrogatepass").translate(_TERMS).split()
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size >= held:
                yield from out()
                size = 0
    yield from out()


def _share(count: Column, total: Column, terms: Column, scale: int, plus: int) -> Column:
    """1 + floor(scale * (count + plus) / (total + plus * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (wide(count) + plus).cast("decimal(19,0)"), wide(wide(total) + F.lit(plus).cast("decimal(2,0)") * wide(terms)))


def _tile(held: pa.Table, n_tiles: int, tile: int) -> pa.Table:
    """Partial distances (lang, source, item, value) of the tile's sources to all of their lang, over one block of terms."""
    base = held.filter(pc.is_null(held["term"])).sort_by("source")
    lang, first = base["lang"][0], base["first"][0].as_py()
    names, baseline, unseen = base["source"].combine_chunks(), base["baseline"].to_numpy(), base["terms"][0].as_py() if first else 0
    posts = held.filter(pc.is_valid(held["term"]))
    who = pc.index_in(posts["source"], value_set=names).to_numpy().astype(np.int64)
    term = posts["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    share, peers = posts["share"].to_numpy(), len(names)
    # the term-major index, and each source's postings in it
    by_term = np.argsort(term, kind="stable")
    who, share, term = who[by_term], share[by_term], term[by_term]
    begins = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1))])
    by_source = np.argsort(who, kind="stable")
    rows = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=peers))])
    mine = np.arange(tile, peers, n_tiles)

    def to_baselines(s: int, others: np.ndarray) -> np.ndarray:
        """Sum over the source's terms of its distance to each of the baselines, less that of its own baseline."""
        p = np.sort(share[by_source[rows[s] : rows[s + 1]]])
        sums = np.concatenate([[0], np.cumsum(p)])
        below = np.searchsorted(p, others)
        return others * (2 * below - len(p)) + sums[-1] - 2 * sums[below] - len(p) * np.abs(baseline[s] - others)

    theirs = np.stack([to_baselines(s, baseline[mine]) for s in range(peers)])  # at most `pairs` numbers
    out = []
    for k, s in enumerate(mine):
        own = by_source[rows[s] : rows[s + 1]]
        lists = begins[term[own]]
        sizes = begins[term[own] + 1] - lists
        at = np.repeat(lists - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(own) else own
        p, q, peer = np.repeat(share[own], sizes), share[at], who[at]
        b, mine_b = baseline[peer], baseline[s]
        both = np.abs(p - q) - np.abs(p - b) - np.abs(q - mine_b) + np.abs(mine_b - b)
        row = np.bincount(peer, weights=both, minlength=peers).astype(np.int64)  # the dense accumulator
        row += to_baselines(s, baseline) + theirs[:, k] + unseen * np.abs(mine_b - baseline)
        rest = np.flatnonzero(np.arange(peers) != s)
        out.append((np.full(len(rest), s), rest, row[rest]))
    a, b, v = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    a, b = (names.take(pa.array(x, pa.int64())) for x in (a, b))
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "source": a, "item": b, "value": pa.array(v, pa.int64())})


def audit(docs: DataFrame, *, min_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, plus: int = 5, block: int = 1_000_000, pairs: int = 1_000_000, held: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to its lang's others (`pair`), and the terms it has most in excess (`term`)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    counted = saved(docs.mapInArrow(lambda b: _counted(b, held), "lang string, source string, term string, n long, docs long"), "counted-terms")
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    terms = saved(terms.select("lang", "term", "lang_n", F.xxhash64("lang", "term").alias("mark")), "kept-terms")
    some = maybe_among(counted, F.xxhash64("lang", "term"), bitmap(terms, "mark")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    postings = saved(some.join(terms.drop("mark"), ["lang", "term"]), "term-postings")
    spent(counted)
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("postings"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    per_lang = groups.groupBy("lang").agg(F.sum("postings").alias("lang_postings"), F.count("*").alias("sources"))
    none = F.col("terms") == 0
    share = lambda n, total: F.when(none, F.lit(0)).otherwise(_share(n, F.col(total), F.greatest("terms", F.lit(1)), scale, plus))
    groups = groups.join(per_lang, "lang").withColumn("baseline", share(F.lit(0), "total"))
    per_block = F.least(F.lit(block), F.greatest(F.lit(block // 10), F.col("sources") * F.col("sources")))  # no more sums than postings where that can be
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_postings") / per_block)).cast("int"))
    tiles = F.least(F.col("sources"), F.ceil(F.col("sources") * F.col("sources") / pairs)).cast("int")
    groups = saved(groups.select("lang", "source", "total", "terms", "lang_total", "baseline", "blocks", tiles.alias("tiles")), "groups")  # a row per source of a lang

    rows = postings.join(groups, ["lang", "source"]).withColumn("share", share(F.col("n"), "total"))
    excess = F.col("share") - share(F.col("lang_n"), "lang_total")
    over = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")

    place = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    columns = ["lang", "source", "term", "share", "baseline", "terms", "first", "block", "tiles"]
    inner = rows.withColumn("block", place).withColumn("first", F.lit(False)).select(*columns)
    frame = groups.withColumns({"term": F.lit(None).cast("string"), "share": F.lit(0).cast("long")}).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.col("block") == 0).select(*columns)
    dealt = inner.union(frame).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    kind = "lang string, source string, item string, value long"
    partial = dealt.groupBy("lang", "block", "tile").applyInArrow(lambda t: _tile(t, t["tiles"][0].as_py(), t["tile"][0].as_py()), kind)
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(sums).union(ranked(over).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_OP12 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) t USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_shares AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (any_value(t.total) + 5 * any_value(v.v)) AS BIGINT) AS q
  FROM counts JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) t USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
  ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
), rows AS (
  SELECT * FROM pairs UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - q FROM shares s JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
