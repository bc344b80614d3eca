"""Line-first quality rules with DataFrame functions only.

Base measures of the whole text, then a verdict on every line: punctuation (five words or more without any sentence mark, or stray marks
for half of the words), navigation (separators for a third of the words) and boilerplate (a short line with a stock phrase).
Failing lines are taken out; a document is rejected when it fails the base rules or loses more than half of its word characters.
All work on a document stays in its own row, so there is no shuffle; repeated windows are found by sorting
(hash, place) pairs in the row.

Defined results: a null text counts as an empty one; no words means base_failed (fewer than `min_words`); very long texts are taken whole; repeated rows
are judged alike; an empty table gives an empty result; columns of the input that share a name with a result are overwritten in `judge_quality` (any
other name is safe) and kept as they are by `drop_low_quality`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table, words

#: Fixed values of the line rules.
SENTENCE = r"[.!?:;…。！？]"
STRAY = r"[#*$%&|<>]|!!"
SEPARATOR = r"[|»›•>]"
STOCK_PHRASES = {
    "en": "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|click here|read more|sign up|log in|subscribe to|enable javascript|powered by|lorem ipsum|back to top|share this",
    "de": "cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|weiterlesen|mehr lesen|jetzt anmelden|newsletter abonnieren|javascript aktivieren|nach oben|teilen auf",
    "fr": "politique de confidentialité|politique de cookies|conditions d'utilisation|tous droits réservés|cliquez ici|lire la suite|se connecter|s'inscrire|abonnez-vous|activer javascript|haut de page|partager sur",
    "es": "política de privacidad|política de cookies|términos de uso|todos los derechos reservados|haga clic aquí|leer más|iniciar sesión|regístrate|suscríbete|activar javascript|volver arriba|compartir en",
}
STOCK = "(?i)(" + "|".join(STOCK_PHRASES.values()) + ")"
#: A word, for counting: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _line_fails(line, n):
    """Whether a line of n words fails; the dearer patterns are only tried where a cheap one has met."""
    stray, bars = F.regexp_count(line, F.lit(STRAY)), F.regexp_count(line, F.lit(SEPARATOR))
    return (
        F.when((n >= 5) & ~line.rlike(SENTENCE), True)
        .when(line.rlike(f"{STRAY}|{SEPARATOR}") & (((n >= 3) & (2 * stray >= n)) | ((bars >= 2) & (3 * bars >= n))), True)
        .otherwise((n <= 20) & line.rlike(STOCK))
    )


def judge_quality(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept and clean_text."""
    out = _judged(docs, min_words, max_repeat_percent, max_lost_percent)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return out.select(*kept, *RESULTS)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")


def _judged(docs: DataFrame, min_words: int, max_repeat_percent: int, max_lost_percent: int) -> DataFrame:
    """_row (the input's row) and the results."""
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("_l", F.split("_t", "\n"))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) ELSE array() END"))
    # only texts in which a window comes again need the sorting
    df = df.withColumn("_g", F.expr("CASE WHEN size(array_distinct(_h)) = size(_h) THEN array() ELSE sort_array(transform(_h, (h, i) -> struct(h AS h, i AS p))) END"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_g, (x, i) -> coalesce(x.h = get(_g, i - 1).h, false) OR coalesce(x.h = get(_g, i + 1).h, false)), x -> x.p))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, (a, x) -> a + x)"))
    # each line once with its number of words: rules, copies and losses all start from it
    df = df.withColumn("_l", F.transform("_l", lambda x: F.struct(x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("n"))))
    return (
        df.withColumn("_s", F.transform(F.filter("_l", lambda x: x["n"] > 0), lambda x: x["x"]))
        .withColumn("clean_text", F.array_join(F.transform(F.filter("_l", lambda x: ~_line_fails(x["x"], x["n"])), lambda x: x["x"]), "\n"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_s") - F.size(F.array_distinct("_s"))).cast("long"))
        .withColumn("lost_chars", F.col("word_chars") - F.length(F.regexp_replace("clean_text", SPACE, "")))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))
        .drop("_t", "_w", "_l", "_h", "_g", "_p", "_s")
    )


def drop_low_quality(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """The accepted documents with their columns; text (and n_chars, if there) is the cleaned one."""
    judged = _judged(docs, min_words, max_repeat_percent, max_lost_percent)
    # A filter that moved below the projections would evaluate the arrays anew inside their own lambdas. Spark moves none below a projection with a
    # nondeterministic column, which this true term makes of `kept`; tests/llm looks at the plan.
    judged = judged.withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return judged.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_STOCK = STOCK.replace("'", "''")
_FAILS = f"""(len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda v: v <> '')) >= 5 AND NOT regexp_matches(x, '{SENTENCE}')
 OR len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda v: v <> '')) >= 3 AND 2 * len(regexp_extract_all(x, '{STRAY}')) >= len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda v: v <> ''))
 OR len(regexp_extract_all(x, '{SEPARATOR}')) >= 2 AND 3 * len(regexp_extract_all(x, '{SEPARATOR}')) >= len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda v: v <> ''))
 OR len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda v: v <> '')) <= 20 AND regexp_matches(x, '{_SQL_STOCK}'))"""

ORACLE_OP7 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS s FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(s) - len(list_distinct(s)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(s, lambda x: {_FAILS}), lambda x: length(regexp_replace(x, '{SPACE}', '', 'g')))), 0) AS lost FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept FROM m
"""
