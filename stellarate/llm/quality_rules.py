"""Quality rules: base counts, and a likelihood ratio of trusted to raw text.

Words and pairs of words are hashed to buckets. The counts of all documents give the
raw multinomial, those of the trusted ones the target. A document's score is the sum
of the log ratios of its n-grams' buckets divided by their number; it is kept at a
score of ``THRESHOLD`` or more, unless the base rules fail it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, map_arrow, segment_sums, sliced, text_buffer
from stellarate.llm.quality_model import ODD
from stellarate.llm.words import WHITE, Words, shingle_hashes, table

BITS = 16
THRESHOLD = -0.1
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30
#: Trusted ids that are broadcast; more are joined by a shuffle.
MOST_TRUSTED = 2_000_000

LINE_END = table((10, 10))
NOT_LATER = np.array([(b & 0xC0) != 0x80 for b in range(256)])
WORD_POINT = ~WHITE & NOT_LATER


# ---- base counts ----


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""

    def per_text(mark: np.ndarray) -> np.ndarray:
        return segment_sums(mark, offsets)

    lines = Words(data, offsets, LINE_END, lower=False)
    inner = np.append(0, np.cumsum(~WHITE[data], dtype=np.int64))
    own = np.flatnonzero(inner[lines.ends] > inner[lines.starts])
    return [
        words.counts,
        per_text(WORD_POINT[data]),
        per_text(ODD[data]),
        repeated(lines.doc[own], lines.hashes[own], len(words.counts)),
        repeated_words(words),
    ]


def repeated(doc: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Per text, how many of its hashes it had before."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    again = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1])) + 1
    return np.bincount(d[again], minlength=texts)


def repeated_words(words: Words) -> np.ndarray:
    """Words in windows of ``WINDOW`` words that a text has twice or more."""
    every = shingle_hashes(words.hashes, WINDOW)
    inside = np.flatnonzero(words.doc[: len(every)] == words.doc[WINDOW - 1 :]) if len(every) else []
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if len(inside):
        # a window and its text in one number
        key = every[inside] ^ (words.doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        covered[at] += 1
        covered[at + WINDOW] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
    return np.diff(covered[words.first])


# ---- n-grams ----


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of words."""
    shift = np.uint64(64 - BITS)
    pairs = shingle_hashes(words.hashes, 2)
    inside = words.doc[: len(pairs)] == words.doc[1:] if len(pairs) else np.zeros(0, bool)
    bucket = np.concatenate([words.hashes >> shift, pairs[inside] >> shift]).astype(np.int64)
    return bucket, np.concatenate([words.doc, words.doc[: len(pairs)][inside]])


class CountBuckets:
    """(bucket, n_raw, n_target) of a task's documents; the target is named by ids or a column."""

    def __init__(self, trusted) -> None:
        self.trusted = trusted

    def __call__(self, batches: Batches) -> Batches:
        raw, target = (np.zeros(1 << BITS, np.int64) for _ in range(2))
        for rows in sliced(batches, 1):
            data, offsets = text_buffer(rows.column(1))
            bucket, doc = ngram_buckets(Words(data, offsets, WHITE, lower=False))
            ids = rows.column(0).fill_null(-1).to_numpy()
            if self.trusted is None:
                good = rows.column(2).to_numpy(zero_copy_only=False)
            else:
                known = self.trusted.value
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                good = known[at] == ids if len(known) else np.zeros(len(ids), bool)
                good &= rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=1 << BITS)
            target += np.bincount(bucket[good[doc]], minlength=1 << BITS)
        has = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has.astype(np.int32)), pa.array(raw[has]), pa.array(target[has])],
            names=["bucket", "n_raw", "n_target"],
        )


def log_ratios(docs: DataFrame, trusted: DataFrame, most_broadcast: int = MOST_TRUSTED) -> np.ndarray:
    """Log ratio of the smoothed target and raw shares of each bucket, over all documents."""
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    if ids.count() <= most_broadcast:
        known = np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64))
        count = CountBuckets(spark.sparkContext.broadcast(known))
    else:
        plain = plain.join(ids.withColumn("good", F.lit(True)), "doc_id", "left").withColumn(
            "good", F.coalesce("good", F.lit(False))
        )
        count = CountBuckets(None)
    parts = map_arrow(plain, count, "bucket int, n_raw long, n_target long")
    sums = parts.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t"))
    found = sums.toPandas()
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    raw[found.bucket] += found.r
    target[found.bucket] += found.t
    if target.sum() == len(target):
        return np.zeros(1 << BITS)  # nothing trusted, nothing to tell apart
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


class Judge:
    NAMES = (
        "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score"
    ).split()

    def __init__(self, ratios) -> None:
        self.ratios = ratios

    def __call__(self, batches: Batches) -> Batches:
        ratios = self.ratios.value
        for rows in sliced(batches, 1):
            data, offsets = text_buffer(rows.column(1))
            words = Words(data, offsets, WHITE, lower=False)
            counts = base_counts(data, offsets, words)
            bucket, doc = ngram_buckets(words)
            texts = len(words.counts)
            grams = np.bincount(doc, minlength=texts)
            score = np.bincount(doc, ratios[bucket], texts) / np.maximum(grams, 1)
            failed = (counts[0] < FEWEST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
            kept = ~failed & (score >= THRESHOLD)
            arrays = [pa.array(c.astype(np.int64)) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *arrays, pa.array(failed), pa.array(kept), pa.array(score)],
                names=self.NAMES,
            )


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Base counts, base_failed, kept and score of every row of ``docs`` (doc_id, text).

    ``trusted`` has the doc_ids of the target. Null texts have no words and fail, like
    empty ones. Repeated rows count and are judged each; with nothing trusted all
    scores are 0; other columns are not looked at.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted))
    return map_arrow(
        docs.select("doc_id", "text"),
        Judge(ratios),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, score double",
    )
