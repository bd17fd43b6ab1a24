"""Native text expressions: no Python worker takes part in any of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# The contraction list. It is applied in this order, as
# case-sensitive substring replacement.
CONTRACTIONS = {
    "don't": "do not",
    "didn't": "did not",
    "doesn't": "does not",
    "can't": "cannot",
    "could've": "could have",
    "couldn't": "could not",
    "you've": "you have",
    "I'm": "I am",
    "I'd": "I would",
    "you're": "you are",
    "I've": "I have",
    "won't": "will not",
    "it's": "it is",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "wasn't": "was not",
}


# A run of anything but whitespace: Unicode white space and four control characters.
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]+"

WORD_PATTERN = r"\w+"


def char_count(text: Column) -> Column:
    """Number of characters; null for null text."""
    return F.length(text)


def word_count(text: Column, empty_as_null: bool = True) -> Column:
    """Number of runs of non-whitespace characters.

    Null text gives null. An empty string gives null too unless
    ``empty_as_null`` is off, which then gives 0.
    """
    words = F.regexp_count(text, F.lit(NOT_SPACE))
    return F.when(text != "", words) if empty_as_null else words


def has_text(text: Column) -> Column:
    """True where there is at least one character (null text: null)."""
    return F.length(text) > 0


def expand_contractions(text: Column) -> Column:
    """All contractions in list order; texts without an apostrophe skip the search."""
    expanded = reduce(
        lambda column, pair: F.replace(column, F.lit(pair[0]), F.lit(pair[1])),
        CONTRACTIONS.items(),
        text,
    )
    return F.when(F.contains(text, F.lit("'")), expanded).otherwise(text)


def tokenize(text: Column) -> Column:
    """Lower-cased ``\\w+`` matches, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def remove_stop_words(words: Column, stop_words: list[str] | None = None) -> Column:
    """The tokens which are no stop words in any letter case; duplicates stay.

    By default the stop words are Spark's own English ones.
    """
    default = StopWordsRemover.loadDefaultStopWords
    listed = [word.lower() for word in (stop_words or default("english"))]
    return F.filter(words, lambda word: ~F.lower(word).isin(listed))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once and not at each use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(words: Column) -> Column:
    """Distinct tokens of one row with their counts, as array<struct<token, tf>>.

    Works on the row's own array (sort, then cut at changes), so counting the
    terms of a document needs no shuffle.
    """

    def counted(ordered: Column, starts: Column) -> Column:
        end = F.size(ordered) + 1
        return F.transform(
            starts,
            lambda start, n: F.struct(
                F.get(ordered, start - 1).alias("token"),
                (F.coalesce(F.get(starts, n + 1), end) - start).cast("bigint").alias("tf"),
            ),
        )

    def first_places(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )

    def counts(ordered: Column) -> Column:
        found = _bound(first_places(ordered), lambda starts: counted(ordered, starts))
        return F.when(F.size(ordered) > 0, found)

    return _bound(F.sort_array(words), counts)
