"""run() against brute force of all its stages on a small table."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from tapeline.llm import quality_rules as rules

from .test_operators import brute_hits, shingles, split


def brute_quality(text):
    """The cleaned text, or None for a rejected document."""
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {x for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for x in range(i, i + 3)}
    if len(w) < 50 or 100 * len(hit) > 50 * len(w):
        return None
    left = []
    for line in text.split("\n"):
        n, stray, bars = len(split(line)), len(re.findall(r"[#*$%&|<>]|!!", line)), len(re.findall("[|»›•>]", line))
        bad = n >= 5 and not re.search("[.!?:;…。！？]", line) or n >= 3 and 2 * stray >= n or bars >= 2 and 3 * bars >= n or n <= 20 and re.search(rules.STOCK, line)
        if not bad:
            left.append(line)
    clean = "\n".join(left)
    chars = lambda t: sum(map(len, split(t)))
    return clean if 100 * (chars(text) - chars(clean)) <= 50 * chars(text) else None


def brute_mix(rows):
    """(doc_id, text, source) as often as the mix takes each."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(split(text))
    names = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(size.values())
    while full := {s for s in open_ if 3 * size[s] * sum(weight[x] for x in open_) < rest * weight[s]}:
        target |= {s: 3 * size[s] for s in full}
        open_ -= full
        rest -= sum(3 * size[s] for s in full)
    target |= {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
    out = []
    for s in names:
        times = math.floor(target[s] / size[s])
        extra = math.floor(target[s] - times * size[s])
        groups = {}
        for r in rows:
            if r[2] == s:
                groups.setdefault(hashlib.md5(f"{r[0]}\n{r[1]}".encode()).hexdigest()[:8], []).append(r)
        taken, more = 0, set()
        for h in sorted(groups):
            n = sum(len(split(r[1])) for r in groups[h])
            if taken + n <= extra or 2 * (taken + n - extra) < n:
                more.add(h)
            taken += n
            if taken > extra:
                break
        out += [r for h, g in groups.items() for r in g for _ in range(times + (h in more))]
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = [". ".join(" ".join(rng.choices(vocab, k=12)) for _ in range(8)) + "." for _ in range(60)]
    bench = " ".join(rng.choices(vocab, k=15))
    texts[3] += " " + bench + "."
    texts[9] += "\nHome | About | Contact | Login\nRead more"
    texts += [texts[5], texts[6].replace(" ", "  ", 1), " ".join(texts[7].split()[:-1]), "short", "x " * 400, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", i, "clash") for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row long, _place string"
    spark.createDataFrame([*rows, rows[8], (None, texts[20] + " more words.", *rows[20][2:]), (None, texts[21], *rows[21][2:])], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    left = {r[0]: c for r in rows if r[1] and (c := brute_quality(r[1])) is not None}
    assert {r.doc_id: r.text for r in good.where("doc_id IS NOT NULL").collect()} == left and len(left[9]) < len(texts[9])
    kept = []
    for d in sorted(left):
        s = shingles(left[d])
        if not any(100 * len(s & t) >= 80 * len(s | t) for t in (shingles(left[k]) for k in kept)):
            kept.append(d)
    deduped = corpus_pipeline.near_dedup(spark, good, str(tmp_path))
    assert deduped.columns == docs.columns and sorted(r.doc_id for r in deduped.where("doc_id IS NOT NULL").collect()) == kept
    assert deduped.where("doc_id IS NULL").count() == 2  # link with nothing
    clean = [d for d in kept if not brute_hits([left[d]], [(1, bench)])[0][1]]
    assert 3 in kept and 3 not in clean
    nulls = [(None, r.text, r.source) for r in deduped.where("doc_id IS NULL").collect()]
    mixed = brute_mix([(d, left[d], f"s{d % 3}") for d in clean] + [("" if d is None else d, t, s) for d, t, s in nulls])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((None if d == "" else d, len(t.encode()) + 1) for d, t, _ in mixed) == Counter((r.doc_id, r.size) for r in got) and {r.law for r in got} == {"bytes"}
    order = sorted((hashlib.md5(t.encode()).hexdigest(), -1 if d == "" else d, len(t.encode()) + 1) for d, t, _ in mixed)
    total, start, want = sum(o[2] for o in order), 0, Counter()
    for _, d, size in order:
        want[None if d == -1 else d, size, start * 16 // total] += 1
        start += size
    assert Counter((r.doc_id, r.size, r.shard) for r in got) == want


def test_empty_pipeline(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
