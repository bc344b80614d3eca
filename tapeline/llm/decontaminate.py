"""Benchmark decontamination by an FM-index over each shard of the corpus.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` in the text with A-Z lower-cased.  The phrases are all windows of
`window` consecutive words of a benchmark item; a shorter item is one phrase.  Each task cuts its documents into shards, keeps the
runs of words that the benchmark knows and that are long enough to hold a phrase (no other words can be hit), builds
suffix array, Burrows-Wheeler transform and wavelet matrix over them, finds every phrase by backward search, locates the
occurrences by walking to sampled suffix positions, and merges the spans.

The benchmark is cut into blocks of at most about `block_words` words; tasks make their phrase tables.  A benchmark of one block is judged in one pass
without a shuffle.  With more, blocks are searched `pass_words` words at a time: the index of a shard is built once over the words that any block of the pass
knows, and the blocks, pickled in one broadcast of that bounded size, are opened and searched one after another.  A pass writes its hits alone, then the
hits of a document are merged; only hits and the documents that a bitmap of theirs lets pass are shuffled.

Defined results: a null or empty text has no words and no hit; very long texts are taken whole, as a shard of their own if need be; a null or empty item
has no phrase; a null item_id counts as the empty string; repeated documents are judged one by one; repeated items count once by item_id, and a
phrase that several items share counts for each of them; an empty benchmark hits nothing; an empty table gives an empty result; columns
other than doc_id, text, item_id are ignored (and kept by `drop_contaminated`), whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_among, saved, spent, table

_TO_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SAMPLE = 8  # every 8th suffix position is kept


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


# ---------------------------------------------------------------- phrases


class Phrases:
    """One block of the benchmark: word ids, distinct phrases as rows of a padded matrix, and the items of each."""

    def __init__(self, pieces: Iterable[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for item, words in pieces:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                n = found.setdefault(tuple(ids[i : i + window]), len(found))
                if n == len(owners):
                    owners.append(set())
                owners[n].add(item)
        self.items = [sorted(x) for x in owners]
        self.length = np.array([len(p) for p in found], np.int64)
        self.matrix = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.matrix[k, : len(p)] = p
        self.shortest = int(self.length.min()) if len(found) else 0


class Group:
    """Blocks that are searched in one pass: one vocabulary for all, and the blocks in its ids, pickled but for a single one."""

    def __init__(self, blocks: Iterable[Phrases]):
        self.vocab: dict[bytes, int] = {}
        self.shortest, self.top, self.held = 0, 0, []
        for one in blocks:
            if len(one.length):
                ids = np.zeros(len(one.vocab) + 1, np.int32)
                for word, k in one.vocab.items():
                    ids[k] = self.vocab.setdefault(word, len(self.vocab) + 1)
                one.matrix, one.vocab = ids[one.matrix], {}
                self.top = max(self.top, int(one.matrix.max()))
                self.shortest = min(self.shortest or one.shortest, one.shortest)
                self.held.append(pickle.dumps(one, 5))
        if len(self.held) == 1:
            self.held = [pickle.loads(self.held[0])]

    def blocks(self) -> Iterator[Phrases]:
        for one in self.held:
            yield pickle.loads(one) if isinstance(one, bytes) else one


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Item words in pieces of at most `most` that overlap by window - 1, so that each phrase lies whole in one."""
    for batch in batches:
        items, texts = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _split(text)
            for i in range(0, max(1, len(words) - window + 1) if words else 0, most - window + 1):
                items.append(item or "")
                texts.append(b" ".join(words[i : i + most]))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "words"])


def _tables(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """A row per block of at most about `most` words: its phrase tables, pickled."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Phrases(held, window), 5)], pa.binary())], ["phrases"])

    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.split()
            if held and size + len(words) > most:
                yield row()
                held, size = [], 0
            held.append((item, words))
            size += len(words)
    if held:
        yield row()


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """The benchmark as a table of blocks (no, phrases), made in as many tasks as it has blocks' worth of words."""
    pieces = saved(benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(lambda b: _pieces(b, window, max(block_words // 4, 2 * window)), "item string, words binary"), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // (6 * block_words)))  # a word and its space have about six bytes; a part of more words makes more blocks
    made = pieces.repartition(parts).mapInArrow(lambda b: _tables(b, window, block_words), "phrases binary")
    out = saved(made.select(F.monotonically_increasing_id().alias("no"), "phrases"), "blocks")
    spent(pieces)
    return out


# ---------------------------------------------------------------- the index


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the separators in seq are all different, so comparing ends at the next one."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Over runs of word ids (1 and up), each closed by a separator (0)."""

    def __init__(self, seq: np.ndarray, top: int):
        n, gap = len(seq), seq == 0
        n_gap = int(gap.sum())
        whole = seq + n_gap
        whole[gap] = np.arange(n_gap)
        self.sa = suffix_array(whole)
        before = np.where(self.sa > 0, self.sa - 1, n - 1)
        bwt = seq[before]
        counts = np.bincount(seq, minlength=top + 2)
        self.start = np.concatenate([[0], np.cumsum(counts)])[: top + 2]
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros, row = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        self.kept = (self.sa % _SAMPLE == 0) | (bwt == 0)
        self.n = n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the transform before i, by the wavelet matrix."""
        low = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][i]
            low = np.where(one, self.zeros[k] + a, low - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases.length), np.int64), np.full(len(phrases.length), self.n, np.int64)
        for t in range(phrases.matrix.shape[1]):
            on = np.flatnonzero((phrases.length > t) & (high > low))
            c = phrases.matrix[on, phrases.length[on] - 1 - t]
            low[on], high[on] = self.start[c] + self.rank(c, low[on]), self.start[c] + self.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: step back until a sampled one, and add the steps."""
        at, steps, on = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(on := on[~self.kept[at[on]]]):
            c = self.bwt[at[on]]
            at[on] = self.start[c] + self.rank(c, at[on])
            steps[on] += 1
        return self.sa[at] + steps


def _indexed(ids: np.ndarray, doc_of: np.ndarray, shortest: int, top: int) -> tuple[FMIndex, np.ndarray] | None:
    """ids: the pass's id of each word of the shard (0: not in the benchmark). The index over the runs of known words that can hold a phrase, and the words' places."""
    edge = np.concatenate([[True], (doc_of[1:] != doc_of[:-1]) | ((ids[1:] > 0) != (ids[:-1] > 0)), [True]])
    cut = np.flatnonzero(edge)
    begin, end = cut[:-1], cut[1:]
    long = (ids[begin] > 0) & (end - begin >= shortest)
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return None
    start = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.full(start[-1], -1, np.int64)
    inside = np.ones(start[-1], bool)
    inside[start[1:] - 1] = False
    place[inside] = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    seq = np.where(inside, ids[place], 0).astype(np.int64)
    return FMIndex(seq, top), place


def _search(index: FMIndex, place: np.ndarray, doc_of: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, first word, length and document of each hit of a block."""
    none = np.zeros(0, np.int64)
    low, high = index.find(phrases)
    some = np.flatnonzero(high > low)
    n = (high - low)[some]
    if not len(some):
        return none, none, none, none
    which = np.repeat(some, n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
    first = place[index.locate(rows)]
    return which, first, phrases.length[which], doc_of[first]


def _judge(texts: list[str | None], group: Group) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """Of each text of a shard: words, item ids, and the merged spans in words."""
    ids, size = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = _split(text)
        size[k] = len(words)
        ids.append(np.fromiter((group.vocab.get(w, 0) for w in words), np.int32, len(words)))
    doc_of, start = np.repeat(np.arange(len(texts)), size), np.concatenate([[0], np.cumsum(size)])
    depth, items = np.zeros(int(start[-1]) + 1, np.int32), [set() for _ in texts]
    found = _indexed(np.concatenate(ids), doc_of, group.shortest, group.top) if len(doc_of) and group.held else None
    for phrases in group.blocks() if found else ():
        which, first, length, doc = _search(*found, doc_of, phrases)
        np.add.at(depth, first, 1)
        np.add.at(depth, first + length, -1)
        for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d].update(phrases.items[p])
    hit = np.cumsum(depth[:-1]) > 0
    out = []
    for k in range(len(texts)):
        spans = []
        if items[k]:
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit[start[k] : start[k + 1]].astype(np.int8), [0]])))
            spans = [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True)]
        out.append((int(size[k]), sorted(items[k]), spans))
    return out


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    """Spans of several blocks without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Cuts of a batch after about `most` bytes."""
    begin = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the spans (in words), each from its first word's start to its last word's end."""
    at = [m.span() for m in _WORD.finditer(text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)}))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("clean_text", pa.string())])


def _row(doc_id, text: str | None, n: int, items: list[str], spans: list, with_text: bool) -> tuple:
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return doc_id, n, sum(b - a for a, b in spans), items, digest, spans, (without_spans(text, spans) if spans else text) if with_text else None


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


_KIND = "doc_id long, n_words long, n_hit long, items array<string>, items_sha256 string, spans array<array<long>>, clean_text string"


def _one_block(docs: DataFrame, blocks: DataFrame):
    """The phrases of a benchmark of at most one block, broadcast."""
    row = blocks.first()
    return docs.sparkSession.sparkContext.broadcast(Group([pickle.loads(bytes(row["phrases"]))] if row else []))


def _marked(docs: DataFrame) -> DataFrame:
    """docs with _mark, equal for rows of equal doc_id and text (whose hits are equal too)."""
    return docs.withColumn("_mark", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary")))


def _block_hits(docs: DataFrame, blocks: DataFrame, at_once: int, shard_chars: int) -> DataFrame:
    """(_mark, items, spans) of the documents that any block hits: one pass over the corpus for each `at_once` blocks, of which only its hits are written."""
    texts, spark, tables = _marked(docs).select("_mark", "text"), docs.sparkSession, []
    numbers = sorted(no for (no,) in blocks.select("no").collect())  # numbers only
    for i in range(0, len(numbers), at_once):
        some = (pickle.loads(bytes(blocks.where(F.col("no") == no).first()["phrases"])) for no in numbers[i : i + at_once])
        shared = spark.sparkContext.broadcast(Group(some))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in _shards(texts, shard_chars):
                    rows = [(m, items, spans) for m, (_, items, spans) in zip(marks[a:b], _judge(texts[a:b], shared.value), strict=True) if items]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64())))], ["_mark", "items", "spans"])

        tables.append(saved(texts.mapInArrow(run, "_mark string, items array<string>, spans array<array<long>>"), "block-hits"))
        shared.destroy()
    hits = tables[0]
    for one in tables[1:]:
        hits = hits.union(one)
    merged = saved(hits.groupBy("_mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "hits")
    spent(*tables)
    return merged


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000, pass_words: int = 2_000_000, shard_chars: int = 8_000_000,
                       with_text: bool = True) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items, items_sha256, spans (pairs of word offsets), clean_text (spans cut out; null unless with_text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = phrase_blocks(benchmark, window, block_words)
    if blocks.count() <= 1:
        shared = _one_block(docs, blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in _shards(texts, shard_chars):
                    yield _record([_row(d, t, *x, with_text) for d, t, x in zip(doc_ids[a:b], texts[a:b], _judge(texts[a:b], shared.value), strict=True)])

        return docs.mapInArrow(run, _KIND)
    hits = _block_hits(docs, blocks, max(1, pass_words // block_words), shard_chars)
    marks = bitmap(hits.select("_mark"), "_mark")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, t, len(_split(t)), sorted(i or []), _merged(s or []), with_text) for d, t, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _record(rows)

    none = [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<array<bigint>>").alias("spans")]
    clean = maybe_among(_marked(docs), F.col("_mark"), marks, among=False).select("doc_id", "text", *none)
    rest = maybe_among(_marked(docs), F.col("_mark"), marks).join(hits, "_mark", "left").select("doc_id", "text", "items", "spans")
    return clean.union(rest).mapInArrow(finish, _KIND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000, pass_words: int = 2_000_000, shard_chars: int = 8_000_000) -> DataFrame:
    """The documents without a hit, with all their columns."""
    blocks = phrase_blocks(benchmark, window, block_words)
    if blocks.count() <= 1:
        shared, at = _one_block(docs, blocks), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                clean = [not x[1] for a, b in _shards(texts, shard_chars) for x in _judge(texts[a:b], shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    hits = _block_hits(docs, blocks, max(1, pass_words // block_words), shard_chars).select("_mark")
    marks = bitmap(hits, "_mark")
    rows = _marked(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"))
    left = maybe_among(rows, F.col("_mark"), marks, among=False).select("_row").union(maybe_among(rows, F.col("_mark"), marks).join(hits, "_mark", "left_anti").select("_row"))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM p),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM d, n WHERE len(w) >= n),
h AS (SELECT rid, i, dw.n, p.item FROM dw JOIN p ON dw.phrase = p.phrase AND dw.n = p.n),
k AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
