"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from four patterns with their checks and always stay.  Wider candidate patterns (unprefixed phones, long digit groups, spelled-out
addresses, secrets, titled names) propose further spans.  Every candidate gets votes from four labelers: strict shape (regex), gazetteer,
context words before it, and composition.  Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is (two classes, votes independent given the class); its posteriors are the soft labels of a logistic span
classifier over the kind, the votes and features of the span itself: length, share of digits, letter case, and the characters beside it.  A candidate is
added when that classifier gives it `threshold` or more and it overlaps no base span.  The pattern table is bounded by kinds times votes times feature
classes (under 70,000 rows, whatever the corpus); only it is read by the driver.

Positions are code points.  They follow from the text between the matches (split) and the matches themselves, in order.  Quantifiers are
possessive where no character could be given back, and a match may not start inside a run that was already tried, so that
long runs take linear time and no stack.  No candidate has an upper length but those that a phone or card number has by its digits.

Defined results: a null text counts as an empty one, with no spans; very long texts and tokens are taken whole; repeated rows are treated alike; an
added span never overlaps a base span, while added spans of two kinds may overlap each other and then both stay; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base patterns, in the order in which they are tried at a place.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]{16})(?=[A-Za-z_.-]*+[0-9])(?=[0-9_.-]*+[A-Za-z])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Don)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?+(?!\p{L})",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4})[ /-]?[0-9]{3,8}+(?:[ -][0-9]{2,6}+){0,3}+(?![0-9])",
    "card": r"(?<![0-9.+-])[0-9]{4,6}(?:[ -]?[0-9]{4,6}){2}(?:[ -]?[0-9]{1,5})?+(?![0-9])",
}
#: Fixed word lists of the gazetteer and context labelers.
NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Walker Young King Wright "
    "Hans Peter Klaus Wolfgang Jürgen Dieter Stefan Andreas Anna Maria Ursula Monika Petra Sabine Claudia Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann "
    "Jean Pierre Michel André Philippe Alain Marie Jeanne Françoise Monique Catherine Nathalie Dupont Martin Bernard Dubois Petit Durand Leroy Moreau Simon Laurent "
    "José Juan Antonio Manuel Francisco Luis Carlos Miguel Carmen Josefa Isabel Ana Dolores Pilar García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz"
).split()
MAIL_HOSTS = "gmail googlemail yahoo hotmail outlook live icloud aol proton gmx web.de t-online orange wanadoo laposte free.fr telefonica terra mail example".split()
GAZETTEER = {
    "email": "(?i)(?:" + "|".join(h.replace(".", r"\.") for h in MAIL_HOSTS) + ")",
    "secret": r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk[-_]|pk[-_]|rk[-_]|xox[a-z]-|eyJ)",
    "name": r"(?<!\p{L})(?:" + "|".join(NAMES) + r")(?!\p{L})",
    "phone": r"^\(?0(?:800|900|30|40|89|20|15|16|17)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach)",
    "secret": r"(?i)(?:token|secret|passw(?:or[dt])?|pwd|api.?key|key|auth)[\"']?\s*[=:]?\s*[\"']?$",
    "name": r"(?i)(?:name|dear|signed|author|contact|by)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|handy)\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|konto|carte|tarjeta)\W*$",
}


_NONE = "CAST(array() AS array<struct<kind: string, start: int, end: int, hit: string, before: string, after: string>>)"


def _placed(text: str, pattern: str, kind: str) -> str:
    """SQL: all matches as structs (kind, start, end, hit, before, after), from the texts between them."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"""CASE WHEN regexp_like({text}, {p}) THEN aggregate(
        arrays_zip(slice(split({text}, {p}), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), slice(split({text}, {p}), 2, size(regexp_extract_all({text}, {p}, 0)))),
        named_struct('at', 0, 'out', {_NONE}),
        (a, x) -> named_struct('at', a.at + length(x['0']) + length(x['1']),
            'out', array_append(a.out, named_struct('kind', '{kind}', 'start', a.at + length(x['0']), 'end', a.at + length(x['0']) + length(x['1']), 'hit', x['1'], 'before', right(x['0'], 30), 'after', left(x['2'], 1)))),
        a -> a.out) END"""


def _luhn(digits: str) -> str:
    """SQL: whether a string of at most 19 digits passes; other lengths must be ruled out before."""
    return f"aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substring(reverse({digits}), i, 1)) ELSE (2 * int(substring(reverse({digits}), i, 1))) div 10 + (2 * int(substring(reverse({digits}), i, 1))) % 10 END) % 10 = 0"


_DIGITS = r"regexp_replace(x.hit, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": f"x.hit RLIKE '^{_BYTE}(?:\\\\.{_BYTE}){{3}}$'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_luhn(_DIGITS)} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_kind(cases: dict[str, str], rest: str) -> str:
    return "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {rest} END"


_SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?[\[(]dot[\])] ?[A-Za-z]{2,}$",
    "secret": r"^(?:[0-9a-f]{16,}|[A-Za-z0-9]{24,}|[A-Za-z0-9_.-]*[A-Za-z0-9]{16,}[A-Za-z0-9_.-]*|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)$",
    "name": r"\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
    "phone": r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|0[0-9]{2,4}[ /-][0-9 -]{5,})$",
    "card": r"^[0-9]{4}(?:[ -][0-9]{4}){3}$",
}
VOTES = {
    "shape": "IF(" + _by_kind({k: f"x.hit RLIKE {_q(v)}" for k, v in _SHAPE.items()}, "false") + ", 1, -1)",
    "gazetteer": "IF(" + _by_kind({k: f"x.hit RLIKE {_q(v)}" for k, v in GAZETTEER.items()}, "false") + ", 1, 0)",
    "context": "IF(" + _by_kind({k: f"x.before RLIKE {_q(v)}" for k, v in CONTEXT.items()}, "false") + ", 1, -1)",
    "composition": _by_kind({"secret": "IF(length(regexp_replace(x.hit, '[^0-9]', '')) * 5 BETWEEN length(x.hit) AND 4 * length(x.hit), 1, -1)", "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN IF({_luhn(_DIGITS)}, 1, -1) ELSE -1 END", "phone": f"IF(length({_DIGITS}) BETWEEN 9 AND 13, 0, -1)"}, "0"),
}


#: Classes of the span itself, as small numbers.
FEATURES = {
    "size": "CASE WHEN length(x.hit) < 12 THEN 0 WHEN length(x.hit) < 20 THEN 1 WHEN length(x.hit) < 40 THEN 2 ELSE 3 END",
    "digits": "least(3, (4 * length(regexp_replace(x.hit, '[^0-9]', ''))) div length(x.hit))",
    "letters": "IF(x.hit RLIKE '[A-Z]', IF(x.hit RLIKE '[a-z]', 2, 1), 0)",
    "left": "CASE WHEN x.before = '' OR x.before RLIKE '[ \\\\n]$' THEN 0 WHEN x.before RLIKE '[=:]$' THEN 1 WHEN x.before RLIKE '[\"\\'(<\\\\[]$' THEN 2 ELSE 3 END",
    "right": "CASE WHEN x.after = '' OR x.after RLIKE '[ \\\\n.,;]' THEN 0 WHEN x.after RLIKE '[\"\\')>\\\\]]' THEN 1 ELSE 2 END",
}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end) and wide (array of kind, start, end, the four votes and the features); one pass over the texts, no shuffle."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        guard = {"email": "contains(text, '@') AND ", "phone": "contains(text, '+') AND "}.get(kind, "")
        df = df.withColumn(f"_{kind}", F.expr(_placed("text", PATTERNS[kind], kind).replace("CASE WHEN ", f"CASE WHEN {guard}", 1)))
    base = "concat(" + ", ".join(f"transform(filter(coalesce(_{k}, {_NONE}), x -> {_VALID[k]}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))" for k in KINDS) + ")"
    df = df.withColumn("base", F.expr(base))
    for kind, pattern in WIDER.items():
        df = df.withColumn(f"_wide_{kind}", F.expr(_placed("text", pattern, kind)))
    wide = "concat(" + ", ".join(f"coalesce(_wide_{k}, {_NONE})" for k in WIDER) + ")"
    free = f"filter({wide}, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
    more = ", ".join(f"'{n}', CAST({v} AS INT)" for n, v in {**VOTES, **FEATURES}.items())
    return df.select("doc_id", "base", F.expr(f"transform({free}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, {more}))").alias("wide"))


def em(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of 'personal' for each vote pattern (kind, votes...). counts: bounded by kinds and votes. Votes are smoothed; the class prior is each kind's own."""
    kinds = sorted({k[0] for k in counts})
    n = len(next(iter(counts))) - 1 if counts else 0
    post = {k: min(0.95, max(0.05, 0.5 + 0.2 * sum(k[1:]))) for k in counts}
    for _ in range(rounds):
        prior, like = {}, {}
        for kind in kinds:
            own = [k for k in counts if k[0] == kind]
            prior[kind] = (1 + sum(counts[k] * post[k] for k in own)) / (2 + sum(counts[k] for k in own))
        for j in range(n):
            for c in (0, 1):
                w = {v: 1.0 for v in (-1, 0, 1)}
                for k, m in counts.items():
                    w[k[1 + j]] += m * (post[k] if c else 1 - post[k])
                total = sum(w.values())
                for v in w:
                    like[j, c, v] = w[v] / total
        for k in counts:
            yes, no = math.log(prior[k[0]]), math.log(1 - prior[k[0]])
            for j in range(n):
                yes += math.log(like[j, 1, k[1 + j]])
                no += math.log(like[j, 0, k[1 + j]])
            post[k] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
    return post


def span_classifier(counts: dict[tuple, int], post: dict[tuple, float], rounds: int = 400, ridge: float = 0.01) -> dict[tuple, float]:
    """Weights of a logistic model over indicators (kind, votes, features), fitted to the soft labels by gradient steps, each pattern by its count.

    counts: by (kind, votes..., features...); post: by (kind, votes...)."""
    import numpy as np

    columns = ["kind", *VOTES, *FEATURES]
    names = sorted({(c, v) for k in counts for c, v in zip(columns, k, strict=True) if c not in VOTES or v}, key=str)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    for row, k in enumerate(counts):
        x[row, [at[f] for f in zip(columns, k, strict=True) if f in at]] = 1
    y = np.array([post[k[: 1 + len(VOTES)]] for k in counts])
    share = np.array(list(counts.values()), float) / (sum(counts.values()) or 1)
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w += x.T @ (share * (y - p)) - ridge * w
    return dict(zip(names, w.tolist(), strict=True))


def find_pii(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end)."""
    found = saved(candidates(docs), "candidates")
    x = found.select(F.explode("wide").alias("x")).select("x.kind", *(f"x.{v}" for v in (*VOTES, *FEATURES)))
    counts = {tuple(r)[:-1]: r["count"] for r in x.groupBy("kind", *VOTES, *FEATURES).count().orderBy("kind", *VOTES, *FEATURES).collect()}  # bounded, see above
    votes: dict[tuple, int] = {}
    for k, m in counts.items():
        votes[k[: 1 + len(VOTES)]] = votes.get(k[: 1 + len(VOTES)], 0) + m
    w = span_classifier(counts, em(votes))
    logit = " + ".join(["0.0D", *(f"IF(x.{c} = {repr(v)}, {weight!r}D, 0.0D)" for (c, v), weight in w.items())])
    cut = math.log(threshold / (1 - threshold))
    added = F.expr(f"transform(filter(wide, x -> {logit} >= {cut!r}D), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    return found.select("doc_id", "base", added.alias("added"))


def _written(spans: str) -> str:
    """SQL: spans as kind:start:end by kind as listed (others after them by name), then start."""
    key = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind)"
    return f"array_join(transform(sort_array(transform({spans}, x -> named_struct('k', IF({key} = 0, 9L, {key}), 'kind', x.kind, 'start', x.start, 'end', x.end))), x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(_written("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_written("concat(base, added)")).alias("spans"), F.expr("CAST(size(base) + size(added) AS BIGINT)").alias("n_spans"))
