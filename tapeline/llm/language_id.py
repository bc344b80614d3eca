"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  Each language has a probability for each piece; the probability of a word is the sum over
all ways to cut it into pieces, by a forward pass; a text's score is the product over its words.  The probabilities come from
expectation-maximisation: forward and backward passes give the expected piece counts of the training words.

Training reads documents whose crc32(doc_id) mod 4 is not 2, about `train_docs` of them per language, chosen by hash (the bound is that parameter).
Their words are counted in Spark by (language, word); each round sums expected counts in Spark, and the driver gets one row per language and piece
of the vocabulary.  Scoring is one pass over all whole texts without a shuffle; words that come again are looked up.

Words are runs of letters (`str.isalpha`: no digits, number signs or marks), lower-cased, of any length; the passes are rescaled every few letters, so
that no product leaves the range of a double.  A letter that is no piece has a small fixed probability in every language.

Defined results: null texts and texts without a letter are `und` with score 0; very long texts and words are taken whole; equal scores go to the first
language by name; null languages do not train; without any training row all is `und`; repeated rows are alike; an empty table gives an empty result;
extra columns are ignored, whatever their names.  The vocabulary file must be at the path given on the driver; its pieces travel from there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_LETTERS = re.compile(r"[^\W\d_]+")  # letters, and the number signs that `_words` takes out
_STEP = 16  # letters between two rescalings
_BASE = np.uint64(0x100000001B3)
_UNKNOWN = 1e-8
_MARK = "▁"


def pieces_of(path: str) -> list[str]:
    """The normal pieces of the vocabulary that can cover letters: an optional leading mark, then letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in plain if p and (p == _MARK or p.removeprefix(_MARK).isalpha())})


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Row k: the hashes of the first k letters of the words in the rows of a matrix of code points."""
    out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
    for k in range(codes.shape[1]):
        out[k + 1] = out[k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return out


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


class Pieces:
    def __init__(self, pieces: list[str]):
        h = np.zeros(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            h[k] = _hashes(_codes([p], len(p)))[-1][0]
        self.row = np.argsort(h)
        self.hash = h[self.row]
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.hash, h), max(self.n - 1, 0))
        return np.where(self.hash[at] == h, self.row[at], -1) if self.n else np.full(len(h), -1)

    def edges(self, words: list[str], *, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: (from, to, words that have a piece there, the piece; -1: an unknown letter), `to` rising, or falling with back."""
        n = len(words[0])
        pre = _hashes(_codes(words, n))
        every = np.arange(len(words))
        for j in range(n, 0, -1) if back else range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                piece = self.find(pre[j] - pre[i] * self.power[j - i])
                who = every if i == j - 1 else np.flatnonzero(piece >= 0)
                if len(who):
                    yield i, j, who, piece[who]


def log_total(edges: Iterator, n: int, m: int, theta: np.ndarray, longest: int) -> np.ndarray:
    """words x languages: log of the summed probability of all ways to cut the n letters. theta's last row is the unknown letter's."""
    alpha: dict[int, np.ndarray] = {0: np.ones((m, theta.shape[1]))}
    off = np.zeros((m, theta.shape[1]))
    for i, j, who, piece in edges:
        if j not in alpha:
            if j > _STEP and j % _STEP == 1:
                off += np.log(alpha[j - 1])
                alpha = {k: alpha[k] / alpha[j - 1] for k in range(max(0, j - longest), j)}
            alpha[j] = np.zeros_like(off)
        alpha[j][who] += alpha[i][who] * theta[piece]
    return np.log(alpha[n]) + off


def expected_counts(pieces: Pieces, words: list[str], weight: np.ndarray, own: np.ndarray, theta: np.ndarray, total: np.ndarray) -> None:
    """Add to total (pieces x languages) how often each piece is expected in the words, each by its weight, in the language `own`."""
    n, m = len(words[0]), len(words)
    alpha, beta = np.zeros((n + 1, m)), np.zeros((n + 1, m))
    up, down = np.zeros((n + 1, m)), np.zeros((n + 1, m))  # logs of what the rows were divided by
    alpha[0], beta[n] = 1, 1
    at = 0
    for i, j, who, piece in pieces.edges(words):
        if j != at:
            if j > _STEP and j % _STEP == 1:
                k, f = max(0, j - pieces.longest), alpha[j - 1].copy()
                alpha[k:j] /= f
                up[k:j] += np.log(f)
            at, up[j] = j, up[j - 1]
        alpha[j, who] += alpha[i, who] * theta[piece, own[who]]
    whole = np.log(alpha[n]) + up[n]
    at = 0
    for i, j, who, piece in pieces.edges(words, back=True):
        if j != at:
            k = max(0, j - pieces.longest)
            if j < n and (n - j) % _STEP == 0:
                f = beta[j].copy()
                beta[k : j + 1] /= f
                down[k : j + 1] += np.log(f)
            at, down[k] = j, down[j]
        step = theta[piece, own[who]] * beta[j, who]
        beta[i, who] += step
        np.add.at(total, (piece, own[who]), alpha[i, who] * step * np.exp(up[i, who] + down[j, who] - whole[who]) * weight[who])


def by_length(words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, at in groups.items():
        size = max(1, min(4000, 500_000 // n))
        for s in range(0, len(at), size):
            yield [words[k] for k in at[s : s + size]], at[s : s + size]


def word_logs(words: list[str], pieces: Pieces, theta: np.ndarray) -> np.ndarray:
    """Words x languages: log of the summed probability."""
    out = np.zeros((len(words), theta.shape[1]))
    for group, at in by_length(words):
        out[at] = log_total(pieces.edges(group), len(group[0]), len(group), theta, pieces.longest)
    return out


def _words(text: str | None) -> list[str]:
    found = _LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return [_MARK + w for w in found]


def train(docs: DataFrame, pieces: list[str], *, train_docs: int, rounds: int) -> tuple[list[str], np.ndarray] | None:
    """(languages, theta): docs has doc_id, text, lang of training rows only."""
    spark = docs.sparkSession
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    if not n:
        return None
    langs, place = sorted(n), 1 << 40
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / v)))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(place)) < share[F.col("lang")] * place)

    def counted(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in _words(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    counts = saved(chosen.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    known, where = Pieces(pieces), {k: i for i, k in enumerate(langs)}
    theta = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    theta[-1] = _UNKNOWN
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, theta))

        def expected(batches, shared=shared):
            known, theta = shared.value
            total = np.zeros(theta.shape)
            for batch in batches:
                words, weight, lang = batch.column(1).to_pylist(), batch.column(2).to_numpy(), np.array([where[x] for x in batch.column(0).to_pylist()], np.int64)
                for group, at in by_length(words):
                    expected_counts(known, group, weight[at], lang[at], theta, total)
            p, k = np.nonzero(total[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(total[p, k])], ["p", "k", "c"])

        rows = counts.mapInArrow(expected, "p int, k int, c double").groupBy("p", "k").agg(F.sum("c").alias("c")).toPandas()  # at most pieces x languages
        count = np.full((len(pieces), len(langs)), 0.05)
        count[rows["p"], rows["k"]] += rows["c"]
        theta = np.vstack([count / count.sum(axis=0) * (1 - _UNKNOWN), np.full((1, len(langs)), _UNKNOWN)])
    return langs, theta


def identify(docs: DataFrame, *, vocabulary: str = VOCABULARY, train_docs: int = 3000, rounds: int = 2, remembered: int = 300_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred, languages being equally likely before)."""
    pieces = pieces_of(vocabulary)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    fitted = train(docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), pieces, train_docs=train_docs, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast((Pieces(pieces), fitted))  # pieces x languages

    def scored(batches):
        known, fitted = shared.value
        langs, theta = fitted or ([], None)
        cache: dict[str, int] = {}
        logs, letters = np.zeros((0, len(langs))), 0
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                names, best = [], []
                texts = [_words(t) if langs else [] for t in batch.column(2).to_pylist()]
                if len(cache) > remembered or letters > 20 * remembered:
                    cache, logs, letters = {}, np.zeros((0, len(langs))), 0
                fresh = list(dict.fromkeys(w for ws in texts for w in ws if w not in cache))
                if fresh:
                    letters += sum(map(len, fresh))
                    cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True))
                    logs = np.vstack([logs, word_logs(fresh, known, theta)])
                for ws in texts:
                    if not ws:
                        names.append("und")
                        best.append(0.0)
                        continue
                    total = logs[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    k = int(total.argmax())
                    names.append(langs[k])
                    best.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 2).alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
