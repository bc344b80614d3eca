"""Spelling variants against all pairs of words by plain Python, with and without crowded chunks."""

import random
import re
import zlib
from collections import Counter

import pytest

from tapeline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(docs, every, min_chars=5, min_count=3):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            if every and (h := zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())) % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def brute(words, ratio=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    letters = "abÀÿé"
    vocab = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(250)]
    for w in list(vocab):  # one edit away, at either end too
        k, c = rng.randint(0, len(w)), rng.choice(letters)
        vocab += [w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[: max(0, k - 1)] + c + w[k:], c + w, w + c, w[1:], w[:-1]]
    vocab += ["prefixed" + "".join(rng.choices("xyz", k=rng.randint(3, 8))) for _ in range(200)]  # chunks that many share
    vocab += ["a", "b", "ab", "é", "ÿa"]
    vocab += ["chain", "chaim", "chaime", "chaimed", "chaimedd"]
    rows = [(k % 90, rng.choice([" ", "\n", ", ", "1", "ā", "😀"]).join(rng.choices(vocab, weights=[1 / (1 + i % 40) for i in range(len(vocab))], k=60))) for k in range(220)]
    rows += [(500, " ".join(["chain"] * 3 + ["chaim"] * 6 + ["chaime"] * 12 + ["chaimed"] * 24 + ["chaimedd"] * 48 + ["CHAIN"] * 100 + ["chainz"] * 400))]
    rows += [(None, "prefixed aabaa"), (None, None), (7, ""), (8, None), (9, "x" * 50_000 + " aabaa"), (10, "×÷×÷× " * 4)]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3).cache()


@pytest.mark.parametrize("options", [{"drop_every": 97}, {"drop_every": 3, "held": 50}, {"drop_every": None, "min_chars": 1, "min_count": 2}, {"drop_every": 97, "hot": 1}, {"drop_every": 5, "hot": 8}])
def test_variants(frame, docs, options):
    got = sorted(map(tuple, spelling.spelling_variants(frame, **options).collect()))
    counting = {k: v for k, v in options.items() if k in ("min_chars", "min_count")}
    want = brute(brute_counts(docs, options["drop_every"], **counting))
    assert got == want
    if options == {"drop_every": 97}:
        assert len(want) > 300 and sum(r[1] is not None for r in want) > 50 and any(r[2] not in (r[0], r[1]) for r in want)


def test_crowded_chunk_gives_no_square(spark):
    """Eight thousand words with one half in common: with the extended key the join makes a few rows a word."""
    rng = random.Random(2)
    words = {"common" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(8000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    rows, grams = spelling._chunks(df), spelling._grams(df)
    met = spelling._extended(rows, True).join(spelling._extended(grams, False), "key").count()
    assert met < 40 * len(words)
    found = {tuple(sorted((r.x, r.y))) for r in spelling.near_words(df, hot=100).collect()}
    some = sorted(words)[:150]
    assert found >= {(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if one_edit(a, b)}
    assert all(one_edit(*p) for p in found) and found == {tuple(sorted((r.x, r.y))) for r in spelling.near_words(df, hot=10**6).collect()}


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(70)] + [(f"v{k}", "w000") for k in range(50)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert len(got) == 120 and set(got.values()) == {"w070"}


def test_empty_table(frame):
    assert spelling.spelling_variants(frame.limit(0), drop_every=97).collect() == []
