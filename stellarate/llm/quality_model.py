"""Document quality by a regularised quadratic discriminant over text statistics.

Statistics of whole texts, transformed to be roughly normal, have a mean and a
covariance per class. A class covariance is shrunk towards the pooled one and its
diagonal; its Cholesky factor is computed once and kept with the model. A score is the
logistic of the difference of the classes' log densities (Mahalanobis terms and
log determinants) plus the log of their prior odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import (
    Batches,
    Scratch,
    map_arrow,
    segment_sums,
    sliced,
    text_buffer,
)
from stellarate.llm.words import LOWER, WHITE, Words, table

THRESHOLD = 0.3
#: Weights of the pooled covariance, and then of its diagonal, in a class covariance.
POOLED, DIAGONAL = 0.3, 0.05
#: Added to each variance; statistics have variances of about 0.01 to 1.
FLOOR = 3e-3

UPPER = table((65, 90))
ODD = table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
LOUD = table(*((ord(c), ord(c)) for c in "!?"))
COMMA = table((44, 44), (59, 59))
#: Digits count as letters: numbers in a short text say nothing of its quality.
LETTER = table((48, 57), (65, 90), (97, 122), (128, 255))
NAMES = (
    "size word_length upper odd loud commas sentence letters lines distinct adjacent "
    "bare ended capitals"
).split()


def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of each text, one row per text and one column per ``NAMES``."""
    data, offsets = text_buffer(column)
    words = Words(data, offsets, WHITE, lower=False)
    size, count = np.diff(offsets), words.counts

    def per_text(mark: np.ndarray) -> np.ndarray:
        return segment_sums(mark, offsets)

    def per_word(mark: np.ndarray) -> np.ndarray:
        return segment_sums(mark, words.first)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        return per_text(kind[data])

    last = data[words.ends - 1] if len(data) else data
    first = data[words.starts] if len(data) else data
    upper = bytes_in(UPPER)
    begin, end = words.starts, words.ends
    uppers = np.append(0, np.cumsum(UPPER[data], dtype=np.int32))
    uppers = uppers[end] - uppers[begin]
    shouted = (uppers >= 2) & (uppers >= (end - begin) / 2)
    # distinct words: sort (text, hash) in one number and count the changes
    key = (words.doc.astype(np.uint64) << np.uint64(40)) | (words.hashes >> np.uint64(24))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    held = (key[new] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(held, minlength=len(size))[: len(size)]
    same = np.zeros(len(words.hashes), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    inner = per_text(~WHITE[data])
    stops = per_word(last == ord("."))
    out = np.stack(
        [
            np.log1p(count) / 3,
            np.log1p(share(inner, count)),
            np.sqrt(share(upper, size)),
            np.sqrt(share(bytes_in(ODD), size)),
            np.sqrt(share(bytes_in(LOUD), size)),
            np.sqrt(share(bytes_in(COMMA), size)),
            np.log1p(share(count, stops)) / 3,
            share(bytes_in(LETTER), size),
            np.sqrt(share(per_text(data == 10), count)),
            np.log1p(share(count, distinct)) * np.log1p(share(count, distinct)),
            np.sqrt(share(per_word(same), count)),
            np.sqrt(share(per_word(~LETTER[first]), count)),
            np.sqrt(share(stops, count)),
            np.sqrt(share(per_word(shouted), count)),
        ],
        axis=1,
    )
    return out


class Measure:
    """Adds the statistics of each text as a list."""

    def __call__(self, batches: Batches) -> Batches:
        for rows in sliced(batches, 1):
            found = statistics(rows.column(1))
            flat = pa.array(found.ravel())
            steps = np.arange(0, found.size + 1, found.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(pa.array(steps), flat)],
                names=["doc_id", "x"],
            )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    return map_arrow(docs.select("doc_id", "text"), Measure(), "doc_id long, x array<double>")


def moments(batches: Batches) -> Batches:
    """(label, place, value): count, sums and sums of products of a task's labelled rows."""
    sums: dict[int, np.ndarray] = {}
    width = len(NAMES) + 1
    for rows in batches:
        if not rows.num_rows:
            continue
        x = rows.column(1).flatten().to_numpy().reshape(rows.num_rows, -1)
        x = np.column_stack([np.ones(len(x)), x])
        y = rows.column(0).to_numpy()
        for label in np.unique(y).tolist():
            own = x[y == label]
            sums[label] = sums.get(label, np.zeros((width, width))) + own.T @ own
    for label, s in sums.items():
        place = np.arange(s.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(s.size, label, np.int32)), pa.array(place), pa.array(s.ravel())],
            names=["label", "place", "value"],
        )


class Discriminant:
    """Class means, cached Cholesky factors and log priors; ``sums`` has moments by label."""

    def __init__(self, sums: dict[int, np.ndarray]) -> None:
        counts = {k: s[0, 0] for k, s in sums.items()}
        total = sum(counts.values())
        means = {k: s[0, 1:] / counts[k] for k, s in sums.items()}
        scatter = {
            k: s[1:, 1:] - counts[k] * np.outer(means[k], means[k]) for k, s in sums.items()
        }
        self.prior = {k: c / total for k, c in counts.items()}
        self.parts = {}
        if len(sums) < 2:
            return
        pooled = sum(scatter.values()) / max(total - len(sums), 1)
        for k in sums:
            own = scatter[k] / max(counts[k] - 1, 1)
            # few rows lean on the pooled covariance
            weight = max(POOLED, len(NAMES) / (counts[k] + len(NAMES)))
            cov = (1 - weight) * own + weight * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov))
            cov += FLOOR * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            bias = np.log(self.prior[k]) - np.log(np.diag(factor)).sum()
            self.parts[k] = (means[k], np.linalg.inv(factor), bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1; with one label only its share, with none one half."""
        if len(self.parts) < 2:
            return np.full(len(x), self.prior.get(1, 0.0) if self.prior else 0.5)
        log = {}
        for k, (mean, whiten, bias) in self.parts.items():
            z = (x - mean) @ whiten.T
            log[k] = bias - 0.5 * (z * z).sum(1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def held_out():
    """True where a doc_id is never learnt from; a null doc_id is none of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(False))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all rows of ``labels`` (doc_id, quality) that are not held out.

    Null labels and doc_ids are left out; a doc_id labelled twice counts twice. The
    driver gets the moments of both classes, a few hundred numbers.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(
        "doc_id", F.col("quality").cast("int").alias("label")
    )
    parts = map_arrow(
        known.join(features, "doc_id").select("label", "x"),
        moments,
        "label int, place int, value double",
    )
    width = len(NAMES) + 1
    sums: dict[int, np.ndarray] = {}
    for row in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(row.label, np.zeros(width * width))[row.place] = row.value
    return Discriminant({k: s.reshape(width, width) for k, s in sums.items()})


class Score:
    def __init__(self, model: Discriminant) -> None:
        self.model = model

    def __call__(self, batches: Batches) -> Batches:
        for rows in batches:
            x = rows.column(1).flatten().to_numpy().reshape(rows.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(self.model.score(x))], names=["doc_id", "score"]
            )


class Accept:
    """Passes on the rows whose text scores at least ``threshold``."""

    def __init__(self, model: Discriminant, text: int, threshold: float) -> None:
        self.model, self.text, self.threshold = model, text, threshold

    def __call__(self, batches: Batches) -> Batches:
        for rows in sliced(batches, self.text):
            score = self.model.score(statistics(rows.column(self.text)))
            yield rows.filter(pa.array(score >= self.threshold))


def scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Null texts are empty and are scored like other texts; repeated rows are scored
    each; without labels every score is one half.
    """
    features = scratch.table(measured(docs), "statistics", keep=True)
    scored = map_arrow(features, Score(fit(features, labels)), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    model = fit(measured(docs), labels)
    return map_arrow(docs, Accept(model, docs.columns.index("text"), threshold), docs.schema)
