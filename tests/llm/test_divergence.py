"""Divergence audit against plain arithmetic, in one block and in many blocks and tiles."""

import random
import re
from collections import Counter

import pytest

from tapeline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, min_docs, top, scale=1_000_000_000, plus=5):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held, count, groups = Counter(), {}, Counter()
        for own, source, words in docs:
            if own == lang:
                held.update(set(words))
                groups.update(words)
                count.setdefault(source, Counter()).update(words)
        kept = [t for t in held if held[t] >= min_docs]
        shares = {}
        for s, c in [*count.items(), (None, groups)]:
            n = sum(c[t] for t in kept)
            shares[s] = {t: 1 + scale * (c[t] + plus) // (n + plus * len(kept)) for t in kept}
        for s in count:
            p = shares[s]
            far = sorted(((-sum(abs(p[t] - shares[o][t]) for t in kept), o) for o in count if o != s), key=lambda x: (x[0], x[1].encode()))
            over = sorted(((shares[None][t] - p[t], t) for t in kept if count[s][t] and p[t] > shares[None][t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, k) for part, rows in (("pair", far), ("term", over)) for k, (v, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghijk" for b in ("", "ü", "Xy", "ß", "ﬀ", "日本")]
    rows = []
    for _ in range(700):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "é", None, ""])
        mine = words[: 20 + 9 * (len(source or "") + ord((source or "x")[-1]) % 5)]
        rows.append((rng.choice([" ", "\n", "1", "-", "."]).join(rng.choices(mine, k=rng.randint(0, 12))), rng.choice(["en", "en", "de", None]), source))
    rows += [("rare words only here", "fr", "a"), (None, "fr", "b"), ("", "fr", None), ("alone", "it", "x"), ("A " * 20_000, "en", "s1"), ("﻿ A-Z a–z", "en", "s2")]
    return rows + rows[:30]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 7, True) for d in docs], "text string, lang string, source string, term string, n int, first boolean").repartition(4).cache()


@pytest.mark.parametrize("options", [{}, {"block": 50, "pairs": 6, "held": 40}, {"block": 20, "top": 3, "min_docs": 2}])
def test_audit(frame, docs, options):
    options = {"min_docs": 10, "top": 7} | options
    got = sorted(map(tuple, divergence.audit(frame, **options).collect()))
    want = brute(docs, options["min_docs"], options["top"])
    assert got == want and {r[0] for r in got} >= {"", "en", "de", "fr"} and any(r[4] == 0 for r in got if r[0] == "fr")


def test_many_sources_have_many_tiles(spark):
    rows = [(f"w{chr(97 + k % 26)} w{chr(97 + k % 7)} common", "en", f"s{k % 40:02d}") for k in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(df, min_docs=5, block=30, pairs=100).collect()))
    assert got == brute(rows, 5, 50)


def test_shares_of_huge_counts_are_exact(spark):
    n, total, terms = 987_654_321_987, 12_345_678_912_345, 7_654_321
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    assert df.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"), 10**9, 5)).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_empty_table(frame):
    assert divergence.audit(frame.limit(0)).collect() == []
