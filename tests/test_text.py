from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from stellarate.functions import text

EDGE_TEXTS = [
    None,
    "",
    "  ",
    "a b c\x1cd",
    "smile \U0001f600 wide　gap",
    "trailing\n",
    "I don't know it's",
    "Don't",
    "kit's won't've",
    "café Über naïve",
]


def values(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in rows.select(column.alias("v")).collect()]


def expand(value: str) -> str:
    for short, full in text.CONTRACTIONS.items():
        value = value.replace(short, full)
    return value


def test_character_count_is_python_len(spark):
    expected = [None if t is None else len(t) for t in EDGE_TEXTS]
    assert values(spark, EDGE_TEXTS, text.char_count(F.col("text"))) == expected


def test_word_count_is_python_split(spark):
    expected = [len(t.split()) if t else None for t in EDGE_TEXTS]
    assert values(spark, EDGE_TEXTS, text.word_count(F.col("text"))) == expected
    zero = [None if t is None else len(t.split()) for t in EDGE_TEXTS]
    assert values(spark, EDGE_TEXTS, text.word_count(F.col("text"), False)) == zero


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=150, max_size=200))
def test_word_count_on_any_text(spark, texts):
    expected = [len(t.split()) if t else None for t in texts]
    assert values(spark, texts, text.word_count(F.col("text"))) == expected


def test_word_count_on_all_space_like_characters(spark):
    texts = [f"a{chr(code)}b" for code in range(1, 0x3100)]
    expected = [len(t.split()) for t in texts]
    assert values(spark, texts, text.word_count(F.col("text"))) == expected


def test_contractions(spark):
    expected = [None if t is None else expand(t) for t in EDGE_TEXTS]
    assert values(spark, EDGE_TEXTS, text.expand_contractions(F.col("text"))) == expected


def test_has_text(spark):
    got = values(spark, [None, "", " "], text.has_text(F.col("text")))
    assert got == [None, False, True]


def test_tokens_and_stop_words_are_those_of_spark_ml(spark):
    known = [(t,) for t in EDGE_TEXTS if t is not None]
    rows = spark.createDataFrame(known, "text string")
    rows = RegexTokenizer(inputCol="text", outputCol="ml", pattern=r"\w+", gaps=False).transform(rows)
    rows = StopWordsRemover(inputCol="ml", outputCol="ml_kept").transform(rows)
    tokens = text.tokenize(F.col("text"))
    got = rows.select("ml", "ml_kept", tokens.alias("t"), text.remove_stop_words(tokens).alias("k"))
    for row in got.collect():
        assert row["ml"] == row["t"] and row["ml_kept"] == row["k"]


def test_each_stop_word_goes_as_spark_ml_takes_it_out(spark):
    """Every default stop word by itself, in capitals too, and words that are none."""
    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert len(listed) > 100
    words = [*listed, *[w.upper() for w in listed], "", "kit", "don", "d", "ll", "notable", "they've got"]
    rows = spark.createDataFrame([([w],) for w in words], "words array<string>")
    rows = StopWordsRemover(inputCol="words", outputCol="ml").transform(rows)
    got = rows.select("words", "ml", text.remove_stop_words(F.col("words")).alias("own")).collect()
    assert len(got) == len(words)
    assert [r.words[0] for r in got if r.ml != r.own] == []
    assert {r.words[0] for r in got if r.own == []} >= set(listed)


@pytest.mark.parametrize(
    "words, expected",
    [
        (["b", "a", "b"], {"a": 1, "b": 2}),
        (["z"], {"z": 1}),
        (["x", "x", "x"], {"x": 3}),
        ([], None),
        (None, None),
    ],
)
def test_term_counts(spark, words, expected):
    row = spark.createDataFrame([(words,)], "w array<string>")
    got = row.select(text.term_counts(F.col("w"))).first()[0]
    assert (None if got is None else {r["token"]: r["tf"] for r in got}) == expected
