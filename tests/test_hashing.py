from collections import Counter

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from stellarate.functions.text import term_counts
from stellarate.operators import hashing

DOCS = [
    (1, ["good", "food", "good"]), (2, []), (3, None), (4, ["", "é", "日本語", "good"]), (5, ["x" * 5000]),
    (6, ["good"] * 40), (7, ["abc", "abcd", "abcde", "ab", "a"]), (7, ["abc"]), (None, ["food"]),
]


def terms_of(spark):
    frame = spark.createDataFrame(DOCS, "doc_id long, words array<string>")
    return frame.select("doc_id", "words", term_counts(F.col("words")).alias("terms"))


def buckets(spark, words, size):
    frame = spark.createDataFrame([([w],) for w in words], "words array<string>")
    rows = HashingTF(inputCol="words", outputCol="v", numFeatures=size).transform(frame).collect()
    return {r["words"][0]: int(r["v"].indices[0]) for r in rows}


def test_index_is_what_hashing_does(spark):
    words = sorted({w for _, ws in DOCS for w in ws or []})
    expected = buckets(spark, words, 64)
    found = hashing.bucket_index(hashing.vocabulary(terms_of(spark)), 64).collect()
    assert {r.token: r.bucket for r in found} == expected
    df = Counter(w for _, ws in DOCS for w in set(ws or []))
    total = Counter(w for _, ws in DOCS for w in ws or [])
    assert {r.token: (r.df, r.total) for r in found} == {w: (df[w], total[w]) for w in words}


def test_null_tokens_and_other_columns(spark):
    frame = spark.createDataFrame([("a", "x"), (None, "y")], "token string, _vector string")
    found = hashing.bucket_index(frame, 16).collect()
    assert {(r.token, r._vector, r.bucket is None) for r in found} == {("a", "x", False), (None, "y", True)}


def test_reverse_index(spark):
    """With few buckets every one holds several terms, those with the largest totals first."""
    index = hashing.bucket_index(hashing.vocabulary(terms_of(spark)), 3)
    rows = index.collect()
    for bucket in hashing.bucket_terms(index, 2).collect():
        held = sorted((-r.total, r.token) for r in rows if r.bucket == bucket.bucket)
        assert bucket.terms == len(held) and bucket.total == -sum(n for n, _ in held)
        assert bucket.examples == [token for _, token in held[:2]]


def test_counts_from_the_index_are_those_of_the_vectors(spark):
    terms = terms_of(spark)
    index = hashing.bucket_index(hashing.vocabulary(terms), 16)
    found = hashing.bucket_counts(terms.where("doc_id < 7"), index)
    vectors = HashingTF(inputCol="words", outputCol="v", numFeatures=16).transform(
        terms.where("words is not null and doc_id < 7")
    )
    expected = hashing.vector_counts(vectors, "v")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_no_documents(spark):
    empty = terms_of(spark).limit(0)
    index = hashing.bucket_index(hashing.vocabulary(empty))
    assert index.collect() == [] and hashing.bucket_terms(index).collect() == []
    assert hashing.bucket_counts(empty, index).collect() == []
