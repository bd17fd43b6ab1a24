"""The hash buckets of terms, forwards and backwards.

``HashingTF`` keeps no record of which term went where. The index below is made over the
distinct terms of a corpus only, so it costs one hash per term and not one per occurrence, and
tells which terms share a weight.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.operators.joins import join_dimension
from stellarate.operators.optimality import entries

BUCKETS = 4096


def vocabulary(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, df, total) of rows (key, array<struct<token, tf>> ``terms``)."""
    return terms.select(F.inline("terms")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
    )


def bucket_index(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``words`` (column ``token``, without repeats) with the ``bucket`` of each.

    A null token stays, without a bucket: ``HashingTF`` never sees one.
    """
    token = F.col("token")
    rows = words.select(F.struct("*").alias("row"), F.when(token.isNotNull(), F.array(token)).alias("one"))
    hashed = HashingTF(inputCol="one", outputCol="vector", numFeatures=buckets)
    placed = hashed.transform(rows.where("one is not null")).select(
        "row.*", F.unwrap_udt("vector")["indices"][0].alias("bucket")
    )
    empty = rows.where("one is null").select("row.*", F.lit(None).cast("int").alias("bucket"))
    return placed.unionByName(empty)


def bucket_terms(index: DataFrame, most: int = 10) -> DataFrame:
    """(bucket, terms, total, examples): the reverse index of ``bucket_index`` with ``total``.

    ``examples`` has the ``most`` terms with the largest totals, equal ones by name. ``terms``
    over 1 means that these terms cannot be told apart by a model.
    """
    ranked = F.struct((-F.col("total")).alias("n"), F.col("token"))
    return index.where("bucket is not null").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("terms"),
        F.sum("total").alias("total"),
        F.transform(F.slice(F.sort_array(F.collect_list(ranked)), 1, most), lambda x: x["token"]).alias("examples"),
    )


def bucket_counts(terms: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bucket, count): the hashed term counts of each row, by a join with the index."""
    pairs = terms.select(F.col(f"`{key}`").alias(key), F.inline("terms"))
    # combined per row and bucket before anything else is done with them
    found = join_dimension(pairs, index.select("token", "bucket"), "token", [key])
    return found.groupBy(key, "bucket").agg(F.sum("tf").alias("count"))


def vector_counts(hashed: DataFrame, features: str = "word_features", key: str = "doc_id") -> DataFrame:
    """(key, bucket, count): the entries of hashed vectors."""
    return hashed.select(F.col(f"`{key}`").alias(key), F.inline(entries(features))).select(
        key, F.col("idx").alias("bucket"), F.col("x").cast("bigint").alias("count")
    )
