"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import common
from tapeline.llm import decontaminate as dc
from tapeline.llm import language_id, line_dedup, mixing, neardup, pii, quality_model, quality_rules, sharding, token_counts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["The", "of", "é", "naïve", "the,"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 90))) + "." for _ in range(n)]
    for i in range(0, n, 5):  # near copies, exact copies, line ends
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i])
        texts.append(texts[i].replace(" ", "\n", 3))
    return texts + [None, "", " \n\t ", "x", "one two", "One TWO", "spam " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"l{i % 2}", [None, "a", "b", "a", "ü"][i % 5], 7, "clash") for i, t in enumerate(corpus())]
    rows += [rows[3], rows[4], (None, "no id here at all", "en", "a", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, kept string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bitmap_passes_all_ids_and_few_others(spark, monkeypatch):
    df = spark.range(20_000).toDF("doc_id")
    for few, most in ((10, 28), (3, 5)):  # five bits are all set: everything passes
        monkeypatch.setattr(common, "FEWEST_BITS", few)
        monkeypatch.setattr(common, "MOST_BITS", most)
        marks = common.bitmap(df.where("doc_id % 7 = 0"), "doc_id")
        hit, rest = (common.maybe_among(df, df["doc_id"], marks, among=a) for a in (True, False))
        assert hit.count() + rest.count() == 20_000 and rest.where("doc_id % 7 = 0").count() == 0
        assert hit.count() < 5000 if most == 28 else hit.count() == 20_000


# ------------------------------------------------------------------ 1


def brute_hits(texts, items, window=10):
    phrases = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(AZ))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(AZ))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_decontaminate(spark, docs, block_words):
    texts = {r.doc_id: r.text for r in docs.collect()}
    a, b = texts[0].split(), texts[7].split()
    items = [(3, " ".join(a[:14])), (11, " ".join(b[2:16]).upper()), (2, "one, TWO"), (5, None), (6, " . "), (7, "spam spam"), (11, " ".join(b[2:16]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_contamination(docs, bench, block_words=block_words, shard_chars=5000).collect()
    assert len(got) == docs.count()
    for r in got:
        n, hit, found = brute_hits([texts[r.doc_id]], items)[0]
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert sum(y - x for x, y in r.spans) == hit
        assert len(WORD.findall((r.clean_text or "").translate(AZ))) == n - hit
    clean = dc.drop_contaminated(docs, bench, block_words=block_words).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in docs.collect() if not brute_hits([r.text], items)[0][1])


@pytest.mark.parametrize("pass_words, passes", [(2_000_000, 1), (250, 12)])
def test_blocks_share_an_index(spark, monkeypatch, pass_words, passes):
    """A benchmark of some twenty blocks is searched in as few passes as `pass_words` asks for, with the hits of one block."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(40)]
    texts = [" ".join([*rng.choices(words, k=20), *items[i % 40][1].split()[3:16], *rng.choices(words, k=5)]) if i % 3 else "nothing here" for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, _mark string, _row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    made, real = [], dc.saved
    monkeypatch.setattr(dc, "saved", lambda frame, name: made.append(name) or real(frame, name))
    options = dict(block_words=50, pass_words=pass_words)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in dc.find_contamination(df, bench, **options).collect()}
    assert got == dict(enumerate(brute_hits(texts, items)))
    assert min(passes, 2) <= made.count("block-hits") <= passes
    clean = dc.drop_contaminated(df, bench, **options)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, g in got.items() if not g[1]}
    assert all(tuple(r)[2:] == ("clash", 1) for r in clean.collect())


def test_blocks_are_bounded(spark):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(30)], "item_id long, text string")
    blocks = [pickle.loads(bytes(r.phrases)) for r in dc.phrase_blocks(bench, 10, 1000).collect()]
    assert len(blocks) > 3 and all(len(b.vocab) <= 1000 for b in blocks) and {i for b in blocks for p in b.items for i in p} == {str(i) for i in range(30)}
    assert sum(len(b.length) for b in blocks) == 30 * 191


def test_decontaminate_empty(docs, none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in dc.find_contamination(docs, bench).collect()} == {0}
    assert dc.find_contamination(none, bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text("ab ", max_size=60), st.text("ab ", max_size=8))
def test_index_finds_all(text, item):
    n, found, spans = dc._judge([text], dc.Group([dc.Phrases([("i", dc._split(item))], 3)]))[0]
    assert (n, sum(b - a for a, b in spans), found) == brute_hits([text], [("i", item)], 3)[0]


# ------------------------------------------------------------------ 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=90), st.text("abc", max_size=90), st.integers(0, 3), st.lists(st.tuples(st.integers(0, 80), st.sampled_from("abc-")), max_size=4))
def test_edit_distance_and_segments(a, b, k, changes):
    near = list(a)
    for i, c in changes:
        if c == "-" and near:
            near.pop(i % len(near))
        else:
            near.insert(i % (len(near) + 1), c)
    for x, y in ((a, b), (a, "".join(near))):
        d = edits(x, y)
        assert line_dedup.within(x, y, k) == (d <= k)
        if d <= k and min(len(x), len(y)) > k:
            s, t = sorted((x, y), key=len)
            cuts = line_dedup.segments(len(s), k)
            assert any(m == len(s) and s[cuts[i][0] :][:n] == t[p : p + n] for m, i, p, n, _ in line_dedup.probes(len(t), k))
        if d <= k:
            one, none, two = line_dedup.parities([x, "", y]).tolist()
            assert ((one ^ two) & (1 << 64) - 1).bit_count() <= 4 * k and none == 0


def brute_lines(rows, k, least):
    first, lines = {}, {}
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(line_dedup.TRIM)
            if line and doc is not None:
                lines.setdefault((doc, pos), line)
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    up = {x: x for x in first.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(first)
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= k and edits(a, b) <= k:
                x, y = sorted((root(first[a]), root(first[b])))
                up[y] = x
    removed = {}
    for at, line in lines.items():
        if root(first[line]) != at:
            removed.setdefault(at[0], []).append(at[1])
    return {d: sorted(p) for d, p in removed.items()}


def test_short_lines_and_hot_segments(spark):
    rng = random.Random(8)
    lines = ["a", "b", "ab", "abc", "abd", "xyz", "é", "ok!!", "ok!", "", "yes", "no"] + ["".join(rng.choices("ab", k=rng.randint(3, 7))) for _ in range(30)]
    lines += ["a common beginning of every line here " + "".join(rng.choices("0123456789", k=5)) for _ in range(60)]
    rows = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = sorted({x for x in lines if x})
    near = {(a, b) for a in distinct for b in distinct if a != b and min(len(a), len(b)) >= 3 and edits(a, b) <= 2}
    for hot in (5, 4096):
        assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(df, hot=hot).collect() if r.removed} == brute_lines(rows, 2, 3)
        assert {r.line: r.n_links for r in line_dedup.line_classes(df, hot=hot).collect()} == {x: sum(a == x for a, _ in near) for x in distinct}
    with pytest.raises(ValueError):
        line_dedup.line_classes(df, distance=32)


def test_crowded_segments_give_no_square(spark, monkeypatch):
    """Lines that share most of their letters: keys are extended until few lines share one, and no link is lost."""
    rng = random.Random(3)
    head = "all of these lines begin in the very same way and go on like that for long "
    tails = ["".join(rng.choices("abcdefghij", k=14)) for _ in range(700)]
    tails += [t[:5] + "X" + t[6:] for t in tails[:40]] + [t[1:] + "Y" for t in tails[40:60]]
    lines = [head + t for t in tails] + [f"page {i} of a book with very many pages" for i in range(30)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    met = []
    real = line_dedup._dealt

    def counted(probe, index, hot):
        met.append(probe.join(index, "key").count())
        return real(probe, index, hot)

    monkeypatch.setattr(line_dedup, "_dealt", counted)
    got = {r.line: r.n_links for r in line_dedup.line_classes(df, hot=50).collect()}
    assert len(met) > 2 and sum(met) < 150 * len(lines)  # all pairs of the two segments that all share would be 1,400 a line
    near = Counter()
    for a, x in enumerate(lines):
        for y in lines[:a]:
            if abs(len(x) - len(y)) <= 2 and line_dedup.within(x, y, 2):
                near.update((x, y))
    assert got == {x: near[x] for x in lines} and sum(near.values()) > 100


def test_line_dedup(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcde ", k=rng.randint(18, 40))) + "." for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for x in rng.choices(base, k=rng.randint(1, 5)):
            x = list(x)
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice("abcxyz")
            lines.append("".join(x) if rng.random() < 0.9 else " ")
        rows.append((i, "\n".join([*lines, "tiny"])))
    rows += [(100, None), (101, ""), (102, "z" * 100_000), (103, "z" * 100_000 + "y"), (None, base[0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, line string")
    got = line_dedup.dedup_lines(df).collect()
    want = brute_lines([r for r in rows if r[0] not in (102, 103)], 2, 3) | {103: [0]}
    assert {r.doc_id: r.removed for r in got if r.removed} == want
    assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(df, hot=2).collect() if r.removed} == want  # every shared segment dealt to parts
    assert len(got) == len(rows)
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(df, distance=2).collect()}
    assert kept[103] == "" and kept[102] == "z" * 100_000 and kept[100] is None
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 3


def test_tokens_match_the_public_unigram(spark, docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.unigram_vocabulary(token_counts.VOCABULARY)
    low = min(s for _, s in vocab)
    tok = Tokenizer(models.Unigram([("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *vocab], unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    extra = spark.createDataFrame([(900, "日本語 text 😀 ok"), (901, "aaaaaaaaaaaa" * 20), (902, "ﷺ ꙮ𐍈")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in token_counts.count_tokens(rows, remembered=50).collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        assert r.n_words == len(words)
        assert r.n_tokens == (len(tok.encode(" ".join(words)).ids) if words else 0)
    assert token_counts.count_tokens(none).count() == 0


def test_viterbi_ties():
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], 10)
    assert counter.viterbi("▁ab") == (2, -3.0)  # the piece that begins first stands


# ------------------------------------------------------------------ 4


def shingles(text, k=4):
    w = split((text or "").translate(AZ))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = {d: shingles(t) for d, t in rows.items()}
    up = {d: d for d in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = neardup.near_duplicates(docs, block=8).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicate_group_of_many_parts(spark):
    """One template, edits from few to many: the group falls into several components."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=32).collect()}
    assert got == {i: root(i) for i in range(150)}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(300, 400)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: root(x) for e in links for x in e if any(a != b and x in (a, b) for a, b in links)}


# ------------------------------------------------------------------ 5


def test_shards(docs, none):
    rows = docs.collect()
    got = sharding.shard_by_bytes(docs, shards=4).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    total, largest = sum(sizes.values()), max(r.size for r in got)
    assert all(abs(sizes[s] - total / 4) <= largest for s in range(4))
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(((hashlib.md5((r.text or "").encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 1, r.doc_id) for r in rows), key=lambda r: r[:3])
    start, slots, placed = 0, Counter(), []
    for _, _, size, doc_id in order:
        shard = start * 4 // total
        placed.append((doc_id, size, shard, slots[shard]))
        start, slots[shard] = start + size, slots[shard] + 1
    assert Counter(placed) == Counter((r.doc_id, r.size, r.shard, r.slot) for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_by_bytes(docs, shards=4).collect()), key=str)
    assert sharding.shard_by_bytes(none).count() == 0


# ------------------------------------------------------------------ 6


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def test_pii(spark, docs, none):
    rng = random.Random(4)
    bits = ["a.b@x-y.co.uk", "a@b.c+d@e.f", "@", "me@host", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "4539 1488 0343 6467", "4539148803436467", "4539148803436468", "+1 (275) 555-4805", "+12", "+49 30 123456--7", "+1234567890123456", "é😀ü", "\n", "tel 030 1234567", 'token = "8b7b7ebadd0a6c91de76426360a1"', "Dr. Anna Smith", "x" * 30, "1-2 3", "--"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "é "]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [None, "", "1" * 2000, "a" * 2000 + "@", "+1" + " " * 2000, "1.1.1.1 " * 200]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.find_pii(df).select("doc_id", pii.F.expr(pii._written("base")).alias("base"), pii.F.expr(pii._written("concat(base, added)")).alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, texts[r.doc_id] or "") if ok(m.group())]
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) or not want
    assert any("secret" in r.spans for r in got)
    assert pii.find_pii(none).count() == 0
    long = spark.createDataFrame([(i, t) for i, t in enumerate(["1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1 " * 50_000, "1 " * 100_000, "-._%" * 50_000])], "doc_id long, text string")
    assert {len(r.base) for r in pii.find_pii(long).collect()} == {0}


def test_em_finds_the_reliable_labeler():
    counts = {("secret", 1, 1, 1, 0): 100, ("secret", -1, -1, 1, 0): 100, ("secret", 1, 1, -1, 0): 90, ("secret", -1, -1, -1, 0): 110}
    post = pii.em(counts)
    assert min(post["secret", 1, 1, 1, 0], post["secret", 1, 1, -1, 0]) > 0.9 and max(post["secret", -1, -1, 1, 0], post["secret", -1, -1, -1, 0]) < 0.1
    features = (2, 1, 2, 1, 0)
    w = pii.span_classifier({k + features: n for k, n in counts.items()}, post)
    assert w["shape", 1] > 0 > w["shape", -1] and ("left", 1) in w


def test_added_spans(spark):
    """Which wider candidates are added and which are not, by what was planted."""
    rng = random.Random(9)
    token = lambda n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choices(chars, k=n - 2)) + "7q"
    rows, want, never = [], {}, {}

    def put(text, mark, kind, yes=True):
        i = len(rows)
        rows.append((i, text))
        start = text.index(mark)
        (want if yes else never)[i] = f"{kind}:{start}:{start + len(mark)}"

    for _ in range(60):
        put(f"set api_key={(t := token(rng.choice((24, 40, 300, 5000))))} in the file", t, "secret")
        put(f'token: "{(t := "ghp_" + token(36))}" leaked', t, "secret")
        put(f"password={(t := token(20) + '-' + token(22) + '_' + token(9))}; done", t, "secret")
        put(f"she met {(t := 'Dr. ' + rng.choice(pii.NAMES) + ' ' + rng.choice(pii.NAMES))} there, name", t, "name")
        put(f"see covid-19-vaccination-rates-{rng.choice(['north', 'south'])} and more", "covid-19-vaccination-rates", "secret", False)
        put(f"part no {(t := 'section-' + str(rng.randint(1, 9)) + '-of-the-manual')} says", t, "secret", False)
    rows += [(len(rows), None), (len(rows) + 1, "")]
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.F.expr(pii._written("added")).alias("spans")).collect()}
    assert all(x in got[i] for i, x in want.items() if x.startswith("secret")), [(rows[i], got[i]) for i, x in want.items() if x not in got[i]][:3]
    assert all(x in got[i] for i, x in want.items()), [(rows[i], got[i]) for i, x in want.items() if x not in got[i]][:3]
    assert not any(any(y.startswith("secret") for y in got[i]) for i in never), [(rows[i], got[i]) for i in never if got[i] != {""}][:3]


# ------------------------------------------------------------------ 7


def test_quality_rules(docs, none):
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    got = quality_rules.judge_quality(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == rows
    for r in got:
        text = r.text or ""
        w = split(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {x for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for x in range(i, i + 3)}
        lines = [x for x in text.split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    left = quality_rules.drop_low_quality(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)
    assert quality_rules.judge_quality(none).count() == 0


def test_quality_filter_stands_above_its_arrays(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, _w string")
    plan = quality_rules.drop_low_quality(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (isnotnull(kept") < plan.index("sort_array")
    judged = quality_rules.judge_quality(df)
    assert judged.columns[:3] == ["doc_id", "text", "_w"] and judged.first()["_w"] == "x"


def test_line_rules(spark):
    prose = " ".join(f"Sentence number {i} has word{i}, thing{i} and more{i}." for i in range(12))  # no three words come twice
    rows = [(1, prose + "\nHome | About | Contact | Login\nRead more"), (2, "\n".join(["a b c d e f g h i j k"] * 3 + [f"nav {i} | x | y | z" for i in range(30)]) + "\nok then."), (3, "###" * 5 + " hi there")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose and not got[2].kept and not got[3].kept


# ------------------------------------------------------------------ 8


def test_quality_model(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:9]) * 4, "clash"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(5000, None, "c"), (5001, "", "c"), rows[0]]
    labels += [(1, None), (3, labels[1][1]), (None, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_model.score_quality(df, lab, features=64).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth, held = dict(labels), [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held if truth.get(r.doc_id) is not None]
    assert sum(right) / len(right) > 0.95
    assert {r.score for r in quality_model.score_quality(df, lab.limit(0)).collect()} == {0.5}
    assert quality_model.score_quality(none, lab, features=16).count() == 0


def test_quality_scores_against_plain_arithmetic(spark):
    """The same scores from one matrix of all labelled rows, a plain solve and the minimax form of isotonic regression."""
    import numpy as np

    rng = random.Random(16)
    rows = [(i, " ".join("".join(rng.choices("abcdeXYZ.!", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 60)))) for i in range(400)] + [(400, None)]
    labels = {i: int(rng.random() < 0.5 + 0.4 * ("X" not in t)) for i, t in rows[:300]}
    got = {r.doc_id: r.score for r in quality_model.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), features=32).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    x = {i: quality_model.statistics(t) for i, t in rows}
    fit, cal = [i for i in labels if fold[i] in (1, 2, 3)], [i for i in labels if fold[i] == 4]
    a = np.array([x[i] for i in fit])
    model = quality_model.Fourier(a.mean(axis=0), np.maximum(a.std(axis=0), 1e-3), 32, 0.03, 7)
    z = model(a)
    w = np.linalg.solve(z.T @ z + np.eye(32), z.T @ np.array([labels[i] for i in fit], float))
    at = np.clip((model(np.array([x[i] for i in cal])) @ w + 0.5) / 2 * 200, 0, 199).astype(int)
    bins = sorted(set(at.tolist()))
    n = [sum(at == b) + 1 for b in bins]
    y = [(sum(labels[i] for i, k in zip(cal, at, strict=True) if k == b) + 0.5) / m for b, m in zip(bins, n, strict=True)]
    mean = lambda i, j: sum(v * m for v, m in zip(y[i : j + 1], n[i : j + 1], strict=True)) / sum(n[i : j + 1])
    level = [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    for i in x:
        want = float(np.clip(np.interp((model(x[i][None]) @ w)[0], [(b + 0.5) / 200 * 2 - 0.5 for b in bins], level), 0, 1))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_pool_adjacent():
    assert quality_model.pool_adjacent([1, 3, 2, 2, 5], [1, 1, 1, 1, 1]) == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


# ------------------------------------------------------------------ 9


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        ws = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * weight[s] > most * sizes[s] * ws]
        if not over:
            return {s: capped.get(s, left * weight[s] / ws if ws else 0.0) for s in names}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 40), rng.choices(["big", "mid", "small", "ü", None, "blank"], [60, 20, 4, 3, 2, 1])[0], "clash") for i in range(3000)]
    rows = [(i, "" if s == "blank" else t, s, c) for i, t, s, c in rows] + [(1, None, "big", "c"), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        assert r.taken <= 3 * r.size
    want = brute_targets(dict(sizes))
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in got)
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    out = Counter(r.source for r in mixing.mixed(df).collect() for _ in (r.text or "").split())
    assert all(out[s] == taken[s] for s in want)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(docs).columns == docs.columns


# ------------------------------------------------------------------ 10


def test_languages(spark, none):
    rng = random.Random(9)
    parts = {"en": ["the", "tion", "ing", "wh", "and"], "de": ["sch", "ung", "keit", "der", "ü"], "fr": ["eau", "tion", "é", "ou", "le"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 4))) for _ in range(30)) + ".", k) for i in range(600) for k in [rng.choice(list(parts))]]
    rows += [(9000, None, "en"), (9001, "", "en"), (9002, "12 34 !", "de"), (9003, "日本", None), (9004, "a" * 5000, "en"), (9005, "² ½ Ⅻ ٣", "en"), rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df, train_docs=100).collect()}
    assert [got[k].lang_pred for k in (9000, 9001, 9002, 9005)] == ["und"] * 4 and got[9004].lang_pred != "und" and got[9000].score == 0
    held = [r for r in rows[:600] if got[r[0]].held_out]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(none).count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["a", "ab", "b", "▁", "▁a"]
    known, theta = language_id.Pieces(pieces), np.array([[0.1], [0.2], [0.3], [0.15], [0.25], [1e-8]])
    p = dict(zip(pieces, theta[:-1, 0], strict=True))
    want = p["▁"] * (p["a"] * p["b"] + p["ab"]) + p["▁a"] * p["b"]
    assert np.exp(language_id.word_logs(["▁ab"], known, theta))[0, 0] == pytest.approx(want)
    assert np.exp(language_id.word_logs(["▁z"], known, theta))[0, 0] == pytest.approx(p["▁"] * 1e-8)


def cuts(word, pieces, longest=16):
    """All ways to cut a word into pieces; a letter that is no piece is None."""
    if not word:
        return [[]]
    out = [[word[:1] if word[:1] in pieces else None] + rest for rest in cuts(word[1:], pieces)]
    return out + [[word[:k]] + rest for k in range(2, min(longest, len(word)) + 1) if word[:k] in pieces for rest in cuts(word[k:], pieces)]


def test_languages_against_all_cuts(spark, monkeypatch):
    """Training and scores by enumeration of every segmentation."""
    import math

    pieces = sorted(["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "ca"])
    monkeypatch.setattr(language_id, "pieces_of", lambda path: pieces)
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcz" if i % 2 else "aabc", k=rng.randint(1, 6))) for _ in range(6)) + " 1²", ["x", "y"][i % 2]) for i in range(60)]
    rows += [(60, "Abc, ABC", None), (61, "cab½bac", "x")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    words = {i: ["▁" + w for w in re.findall("[a-z]+", t.lower())] for i, t, _ in rows}
    theta = {k: dict.fromkeys(pieces, 1 / (len(pieces) + 1)) | {None: 1e-8} for k in "xy"}
    for _ in range(2):
        new = {k: dict.fromkeys(pieces, 0.05) for k in "xy"}
        for i, _, lang in rows:
            if lang and zlib.crc32(str(i).encode()) % 4 != 2:
                for w in words[i]:
                    ways = [(math.prod(theta[lang][p] for p in c), c) for c in cuts(w, pieces)]
                    for p, c in ways:
                        for x in c:
                            if x is not None:
                                new[lang][x] += p / sum(q for q, _ in ways)
        theta = {k: {p: v / sum(new[k].values()) * (1 - 1e-8) for p, v in new[k].items()} | {None: 1e-8} for k in "xy"}
    for i, _, _ in rows:
        log = {k: sum(math.log(sum(math.prod(theta[k][p] for p in c) for c in cuts(w, pieces))) for w in words[i]) for k in "xy"}
        best = max(log, key=log.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()))


def test_long_words_do_not_underflow():
    import numpy as np

    pieces = ["a", "ab", "b", "▁"]
    known = language_id.Pieces(pieces)
    theta = np.array([[0.3, 0.1], [0.2, 0.3], [0.2, 0.2], [0.1, 0.1], [1e-8, 1e-8]])
    for word in ("▁" + "ab" * 9, "▁" + "z" * 30, "▁" + "abz" * 2000):
        logs = []
        for k in (0, 1):
            a, off, prob = [1.0], 0.0, dict(zip(pieces, theta[:-1, k], strict=True))
            for j in range(1, len(word) + 1):
                v = a[-1] * prob.get(word[j - 1], 1e-8) + (a[-2] * prob.get(word[j - 2 : j], 0.0) if j > 1 else 0.0)
                off += np.log(v)
                a = [a[-1] / v, 1.0]
            logs.append(off)
        assert language_id.word_logs([word, word], known, theta)[1] == pytest.approx(logs)
        total, one = np.zeros(theta.shape), np.array([1.0])
        language_id.expected_counts(known, [word], one, np.array([0]), theta, total)
        assert sum(total[known_row, 0] * len(p) for known_row, p in enumerate([*pieces, "z"])) == pytest.approx(len(word))
