"""Term weights on the tokens themselves (no hashing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.functions.text import term_counts
from stellarate.sources.tables import stored

#: Rows of one token that one task should get.
ROWS_PER_PART = 1_000_000


def token_tfidf(
    df: DataFrame,
    key: str,
    words: Column,
    scratch: str,
    min_doc_freq: int = 1,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """(key, token, tf, df, idf, tfidf) for each distinct token of each row.

    idf = ln((rows + 1) / (df + 1)), and 0 for tokens in fewer than
    ``min_doc_freq`` rows.

    The texts are tokenised once: the term counts of each row are written to the
    folder ``scratch``. Document frequencies come from the narrow pairs, combined before
    they are shuffled, and are written beside it, for the choice of parts and the join. A token in many rows is dealt to as many parts as its frequency
    asks for, and its weight is repeated for each of them.
    """
    counted = stored(df.select(F.col(f"`{key}`").alias(key), term_counts(words).alias("terms")), scratch)
    rows = counted.count()
    pairs = counted.select(key, F.inline("terms"))
    parts = F.ceil(F.col("df") / F.lit(rows_per_part)).cast("int")
    idf = F.when(
        F.col("df") >= min_doc_freq, F.log((rows + 1) / (F.col("df") + 1))
    ).otherwise(F.lit(0.0))
    frequencies = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = stored(
        frequencies.select("token", "df", idf.alias("idf"), parts.alias("_parts")),
        f"{scratch.rstrip('/')}-vocabulary",
    )
    # At most as many tokens as rows / rows_per_part times the terms of a row are hot.
    hot = vocabulary.where("_parts > 1").select("token", "_parts")
    if hot.limit(1).count() == 0:
        weighed = pairs.hint("merge").join(vocabulary.drop("_parts"), "token")
    else:
        salt = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.col("_parts")).cast("int")
        pairs = pairs.join(hot, "token", "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
        each = vocabulary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        weighed = pairs.drop("_parts").hint("merge").join(each.drop("_parts"), ["token", "_salt"])
    return weighed.select(
        key, "token", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )
