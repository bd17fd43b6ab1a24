"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

Presence of hashed character n-grams; each is scaled by the log ratio of its smoothed
shares among toxic and clean texts, and logistic weights are learnt on the scaled
features. A score reads the whole text.

The classifier is fitted on at most ``MOST_LABELLED`` labelled documents, chosen by a
digest of their ids, of which every row counts. Of the 2 ** ``BITS`` features those
that separate the labels best enter the weights. The bias puts the cut with the fewest
mistakes at a score of ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, Scratch, distinct, map_arrow, sliced
from stellarate.llm.suffixes import BASES, mixed, powers

THRESHOLD = 0.7
ORDERS = (4, 6, 8)
BITS = 21
MOST_LABELLED = 40_000
MOST_FEATURES = 4_096
#: Pseudo-count of the shares, and strength of the penalty on the weights.
SMOOTH, PENALTY = 0.5, 2e-3
#: Characters hashed together.
SECTION = 1 << 18

UP = {n: powers(BASES[0], n) for n in ORDERS}


def gram_features(points: np.ndarray) -> list[np.ndarray]:
    """Feature number of the n-grams of each order, from the code points of a text."""
    out = []
    for n in ORDERS:
        count = len(points) - n + 1
        if count > 0:
            h = np.zeros(count, np.uint64)
            for step in range(n):
                h += points[step : step + count] * UP[n][step]
            out.append((mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each between spaces, as code points; and where each begins."""
    lowered = [f" {t.lower()} ".replace("\n", " ") for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    data = "".join(lowered).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32).astype(np.uint64), np.cumsum(sizes) - sizes


def present(column: pa.Array, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, without repeats, of the (chosen) features each text has."""
    rows, features = [], []
    overlap = max(ORDERS) - 1

    def add(row: np.ndarray, feature: np.ndarray) -> None:
        key = distinct(row.astype(np.int64) << BITS | feature)
        rows.append(key >> BITS)
        features.append(key & ((1 << BITS) - 1))

    def hashed(points: np.ndarray, row: np.ndarray, inside) -> None:
        got_rows, got = [], []
        for n, feature in zip(ORDERS, gram_features(points)):
            keep = inside(n, len(feature))
            if chosen is not None:
                keep = keep & chosen[feature]
            at = np.flatnonzero(keep)
            got_rows.append(row[at])
            got.append(feature[at])
        if got:
            add(np.concatenate(got_rows), np.concatenate(got))

    at = 0
    sizes = pa.compute.binary_length(column.fill_null("").cast(pa.binary())).to_pylist()
    while at < len(column):
        end, size = at + 1, sizes[at]
        while end < len(column) and size + sizes[end] <= SECTION:
            size += sizes[end]
            end += 1
        points, begin = code_points(column.slice(at, end - at).fill_null("").to_pylist())
        if end == at + 1:
            for start in range(0, len(points), SECTION):
                part = points[start : start + SECTION + overlap]
                hashed(part, np.full(len(part), at), lambda n, count: np.ones(count, bool))
        else:
            row = np.repeat(np.arange(at, end), np.diff(np.append(begin, len(points))))
            # n-grams do not reach into the next text
            hashed(points, row, lambda n, count: row[:count] == row[n - 1 : n - 1 + count])
        at = end
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none
    key = distinct(np.concatenate(rows) << BITS | np.concatenate(features))
    return key >> BITS, key & ((1 << BITS) - 1)


def held_out():
    """True where a doc_id is never learnt from; a null doc_id is none of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return F.coalesce(fold == 1, F.lit(False))


# ---- learning ----


def count_features(batches: Batches) -> Batches:
    """(label, feature, n): labelled texts that have a feature; feature -1 counts the texts."""
    schema = pa.schema([("label", pa.int32()), ("feature", pa.int32()), ("n", pa.int64())])
    totals = {}
    for rows in sliced(batches, 1):
        label = rows.column(0).to_numpy()
        row, feature = present(rows.column(1), None)
        for y in (0, 1):
            counts, texts = totals.get(y, (np.zeros(1 << BITS, np.int64), 0))
            counts += np.bincount(feature[label[row] == y], minlength=1 << BITS)
            totals[y] = (counts, texts + int((label == y).sum()))
    for y, (counts, texts) in totals.items():
        has = np.flatnonzero(counts)
        columns = [np.full(len(has) + 1, y), np.append(-1, has), np.append(texts, counts[has])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, schema.types)], schema=schema
        )


class KeepChosen:
    """(label, features): the chosen features of each labelled text, by their place."""

    def __init__(self, chosen: np.ndarray) -> None:
        self.chosen = chosen

    def __call__(self, batches: Batches) -> Batches:
        mask = np.zeros(1 << BITS, bool)
        mask[self.chosen] = True
        for rows in sliced(batches, 1):
            row, feature = present(rows.column(1), mask)
            place = np.searchsorted(self.chosen, feature).astype(np.int32)
            steps = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(pa.array(steps), pa.array(place))],
                names=["label", "features"],
            )


class Model:
    """Features chosen, their weights (scaling included) and the bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def score(self, column: pa.Array, table: np.ndarray, mask: np.ndarray) -> np.ndarray:
        row, feature = present(column, mask)
        total = np.bincount(row, table[feature], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def logistic(steps: np.ndarray, places: np.ndarray, y: np.ndarray, scale: np.ndarray):
    """Weights and bias of a penalised logistic regression on 0/1 features times ``scale``."""
    row = np.repeat(np.arange(len(y)), np.diff(steps))
    value = scale[places]
    # both classes weigh the same, so that rare labels are learnt as well
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for turn in range(1, 601):
        z = np.bincount(row, value * w[places], len(y)) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.append(
            np.bincount(places, value * error[row], len(scale)) + PENALTY * w, error.sum()
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def middle_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of the log odds with the fewest mistakes; the middle of those with as few."""
    order = np.argsort(z)
    z, toxic = z[order], y[order] == 1
    missed = np.append(0, np.cumsum(toxic))
    wrong = missed + np.append(np.cumsum(~toxic[::-1])[::-1], 0)
    best = np.flatnonzero(wrong == wrong.min())
    at = best[len(best) // 2]
    below = z[at - 1] if at else z[0] - 1
    above = z[at] if at < len(z) else z[-1] + 1
    return float(below + above) / 2


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Learn from the labelled rows (doc_id, toxic) of ``docs`` that are not held out.

    Null labels, doc_ids and texts without a label are left out. With one label only
    all scores are alike: its value; without labels one half.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(MOST_LABELLED)
    )
    known = scratch.table(known, "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")
    texts = scratch.table(texts, "labelled-texts")
    counts = map_arrow(texts, count_features, "label int, feature int, n long")
    counts = scratch.table(
        counts.groupBy("feature").agg(
            *[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
        ),
        "features",
    )
    total = counts.where("feature = -1").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    if not n0 or not n1:
        bias = 0.0 if n0 == n1 else (700.0 if n1 else -700.0)
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    # a signed gain: the log ratio of the shares times the difference they make
    share0, share1 = F.col("n0") / n0, F.col("n1") / n1
    ratio = F.log(((F.col("n1") + SMOOTH) / (n1 + 2 * SMOOTH)) / ((F.col("n0") + SMOOTH) / (n0 + 2 * SMOOTH)))
    best = (
        counts.where("feature >= 0")
        .select("feature", ratio.alias("ratio"), ((share1 - share0) * ratio).alias("gain"))
        .orderBy(F.desc("gain"), "feature")
        .limit(MOST_FEATURES)
        .toPandas()
        .sort_values("feature")
    )
    chosen, ratio = best.feature.to_numpy(np.int64), best.ratio.to_numpy()
    train = map_arrow(texts, KeepChosen(chosen), "label int, features array<int>").toArrow()
    lists = train.column("features").combine_chunks()
    steps = np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy()))
    places, y = lists.flatten().to_numpy(), train.column("label").to_numpy().astype(float)
    w, bias = logistic(steps, places, y, ratio)
    row = np.repeat(np.arange(len(y)), np.diff(steps))
    cut = middle_cut(np.bincount(row, (w * ratio)[places], len(y)) + bias, y)
    # the best cut becomes the score that counts as toxic
    return Model(chosen, w * ratio, float(bias - cut + np.log(THRESHOLD / (1 - THRESHOLD))))


class Score:
    def __init__(self, model: Model) -> None:
        self.model = model

    def __call__(self, batches: Batches) -> Batches:
        table, mask = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        table[self.model.chosen] = self.model.weights
        mask[self.model.chosen] = True
        for rows in sliced(batches, 1):
            score = self.model.score(rows.column(1), table, mask)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(score)], names=["doc_id", "score"]
            )


def scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Null texts are empty; repeated rows are scored each; other columns are not looked
    at.
    """
    model = fit(docs, labels, scratch)
    scored = map_arrow(docs.select("doc_id", "text"), Score(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
