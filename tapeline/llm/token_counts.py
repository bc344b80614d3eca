"""Token counts by a count-only Viterbi over a unigram vocabulary.

The vocabulary is the normal pieces of a fixed public model; a piece's score falls with the log of its rank, in steps of 1/1024, so that sums are
exact in doubles and do not depend on where in a text a word stands.  An Aho-Corasick automaton enumerates all pieces that end at a letter,
longest first; dynamic programming keeps the best score and its number of pieces, no back pointers.

Ties follow the public unigram tokenizers: at one end the piece that begins first stands until a strictly better one comes.  A letter that is no
piece costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).  Words are split at ASCII white space and begin with the
mark; since pieces hold the mark only at their start, words can be cut one by one and words that come again are looked up (at most
`remembered` of them per task; then the memory begins anew, which changes no result).

Defined results: null, empty and blank texts have 0 words, 0 tokens, score 0; very long texts and words are taken whole; repeated rows are alike; an
empty table gives an empty result; other columns are ignored, whatever their names.  The vocabulary file must be at the path given on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the model's normal pieces in their order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    plain = [p for p in plain if _MARK not in p[1:]]
    return [(p, -round(1024 * math.log(k + 10)) / 1024) for k, p in enumerate(plain)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], remembered: int):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), score))
        if vocabulary:
            self.trie.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.known: dict[str, tuple[int, float]] = {}
        self.remembered = remembered

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best cut of the marked word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            found = self.known[word] = self.viterbi(_MARK + word)
        return found

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        single, done = self.single, 0
        ends = self.trie.iter(text) if len(self.trie) else ()

        def close(upto: int) -> None:
            """Letters that are no piece, at the ends that the automaton has passed."""
            nonlocal done
            while done < upto:
                done += 1
                c = text[done - 1]
                if c not in single and score[done - 1] + self.unknown > score[done]:
                    score[done], count[done] = score[done - 1] + self.unknown, count[done - 1] + len(c.encode("utf-8", "surrogatepass"))

        for last, (size, value) in ends:
            if done < last:
                close(last)
            s = score[last + 1 - size] + value
            if s > score[last + 1]:
                score[last + 1], count[last + 1] = s, count[last + 1 - size] + 1
        close(n)
        return count[n], score[n]


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, remembered: int = 300_000) -> DataFrame:
    """doc_id, n_words, n_tokens, score (summed over the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(unigram_vocabulary(vocabulary))  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, remembered)
        for batch in batches:
            n, tokens, scores = [], [], []
            for text in batch.column(1).to_pylist():
                words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []
                found = [counter.word(w) for w in words]
                n.append(len(words))
                tokens.append(sum(c for c, _ in found))
                scores.append(sum(s for _, s in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
