"""Words are never broadcast: saved tables look small to Spark, as their files are compressed."""

import contextlib
import io

from tapeline.llm import spelling
from tapeline.llm.common import saved


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_words_are_not_broadcast(spark):
    words = saved(spark.createDataFrame([("apple", 9), ("apples", 3), ("ample", 4)], "word string, n long"), "words")
    near = spelling.near_words(words)
    assert sorted((r.x, r.y) for r in near.collect()) == [("ample", "apple"), ("apple", "apples")]
    assert "BroadcastHashJoin" not in plan(near)
    docs = spark.createDataFrame([("a", "apple apple apple apple apple apple apples apples apples")], "doc_id string, text string")
    out = spelling.spelling_variants(docs)
    assert sorted((r.word, r.root) for r in out.collect()) == [("apple", "apple"), ("apples", "apple")]
    assert "BroadcastHashJoin" not in plan(out)
