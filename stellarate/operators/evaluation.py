"""Quality of binary predictions: confusion matrix, metrics, ROC curve, exact AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellarate.operators.ordered import (
    bucket_offsets,
    cut_points,
    in_buckets,
    with_running_totals,
)


def score_counts(
    scored: DataFrame, score: str, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per (label, prediction, score), with their number in ``n``.

    All that the functions below need of a scored frame; they take the ``n``
    of such a frame as ``weight``.
    """
    named = scored.select(
        F.col(label).alias("label"), F.col(prediction).alias("prediction"), F.col(score).alias("score")
    )
    return named.groupBy("label", "prediction", "score").agg(F.count(F.lit(1)).alias("n"))


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight)


def confusion_matrix(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """Rows per label with the counts of both predictions, also if one never occurs.

    Rows without a label are left out, as they are in the metrics.
    """
    counts = (
        scored.where(F.col(label).isNotNull())
        .withColumn("_n", _weight(weight))
        .groupBy(F.col(label).cast("double").alias("label"))
        .pivot(prediction, [0.0, 1.0])
        .agg(F.sum("_n"))
    )
    none = F.lit(0).cast("bigint")
    return counts.select(
        "label",
        F.coalesce(F.col("`0.0`"), none).alias("predicted_0"),
        F.coalesce(F.col("`1.0`"), none).alias("predicted_1"),
    )


def class_metrics(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """The four cell counts with accuracy, precision, recall and F1 in one row.

    A metric with a zero denominator is null.
    """
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1

    def rows(cell: Column) -> Column:
        return F.coalesce(F.sum(F.when(cell, _weight(weight))), F.lit(0).cast("bigint"))

    cells = scored.agg(
        rows(actual & predicted).alias("tp"),
        rows(~actual & predicted).alias("fp"),
        rows(actual & ~predicted).alias("fn"),
        rows(~actual & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    precision, recall = F.col("precision"), F.col("recall")
    return cells.select(
        "*",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    ).withColumn("f1", F.try_divide(2 * precision * recall, precision + recall))


def _ranked_scores(
    scored: DataFrame, score: str, label: str, weight: str | None
) -> DataFrame:
    """One row per distinct score, with class counts and running totals.

    Scores are negated, so that running totals go from the highest score down.
    """
    flags = scored.select(
        (-F.col(score).cast("double")).alias("rank"),
        F.when(F.col(label) == 1, _weight(weight)).otherwise(F.lit(0)).alias("pos"),
        F.when(F.col(label) != 1, _weight(weight)).otherwise(F.lit(0)).alias("neg"),
    ).where(F.col("rank").isNotNull() & (F.col("pos") + F.col("neg") > 0))
    counts = flags.groupBy("rank").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    placed = in_buckets(counts, "rank", cut_points(flags, "rank"))
    measures = ["pos", "neg"]
    rows = placed.join(bucket_offsets(placed, [], measures), "bucket")
    return with_running_totals(rows, [], "rank", measures)


def roc_points(
    scored: DataFrame, score: str, label: str = "label", weight: str | None = None
) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the origin has no threshold."""
    points = _ranked_scores(scored, score, label, weight).select(
        (-F.col("rank")).alias("threshold"),
        F.try_divide("upto_neg", "total_neg").alias("fpr"),
        F.try_divide("upto_pos", "total_pos").alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def area_under_roc(
    scored: DataFrame, score: str, label: str = "label", weight: str | None = None
) -> DataFrame:
    """Exact AUC in one row: the share of (positive, negative) pairs in the
    right order, with equal scores counting half."""
    ranked = _ranked_scores(scored, score, label, weight)
    above = F.col("upto_pos") - F.col("pos") + F.col("pos") / 2
    area = F.sum(F.col("neg") * above.cast("double"))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    return ranked.agg(F.try_divide(area, pairs).alias("auc"))


def bounded_curve(
    scored: DataFrame,
    score: str,
    points: int = 200,
    label: str = "label",
    weight: str | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr, slack): at most ``points`` points of the ROC curve, origin included.

    The scores are dealt to bins of about as many rows; the curve has a point where each
    bin ends, and these lie on the exact curve. Inside a bin the exact curve is within the
    rectangle that its positive and negative rows span, so the area under the points is off by
    at most half of each rectangle: ``slack``, 0 for a bin of one score. Rows are combined per
    bin before they are shuffled, so neither the curve nor its scores go anywhere whole.
    """
    if points < 2:
        raise ValueError(f"a curve has two points at least: {points}")
    flags = scored.select(
        (-F.col(score).cast("double")).alias("rank"),
        F.when(F.col(label) == 1, _weight(weight)).otherwise(F.lit(0)).alias("pos"),
        F.when(F.col(label) != 1, _weight(weight)).otherwise(F.lit(0)).alias("neg"),
    ).where(F.col("rank").isNotNull() & ~F.isnan("rank") & (F.col("pos") + F.col("neg") > 0))
    bins = points - 1
    shares = [i / bins for i in range(1, bins)] or [0.5]
    found = flags.agg(F.percentile_approx("rank", shares, 10 * bins)).first()[0]
    cuts = sorted({x for x in found or [] if x not in (float("inf"), float("-inf"))}) or [0.0]
    edges = cuts[: bins - 1]
    # a cut point belongs to the bin before it, so that a score of many rows ends a bin
    below = F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x < F.col("rank"))
    dealt = flags.withColumn("bin", F.size(below) if edges else F.lit(0))
    sums = dealt.groupBy("bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("rank").alias("lo"), F.max("rank").alias("hi")
    )
    # one row per bin, so at most ``points`` rows in these windows
    upto = Window.orderBy("bin")
    every = Window.partitionBy()
    pos, neg = F.sum("pos").over(every), F.sum("neg").over(every)
    single = F.col("lo") == F.col("hi")
    half = F.try_divide(F.col("pos") * F.col("neg") / 2.0, (pos * neg).cast("double"))
    curve = sums.select(
        (-F.col("hi")).alias("threshold"),
        F.try_divide(F.sum("neg").over(upto), neg).alias("fpr"),
        F.try_divide(F.sum("pos").over(upto), pos).alias("tpr"),
        F.when(single, 0.0).otherwise(half).alias("slack"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
        F.lit(0.0).alias("slack"),
    )
    return origin.unionByName(curve)


def curve_area(curve: DataFrame) -> DataFrame:
    """(points, auc, slack) of a bounded curve: the exact area is within ``slack`` of ``auc``."""
    before = Window.orderBy("fpr", "tpr")
    width = F.col("fpr") - F.lag("fpr", 1, 0.0).over(before)
    mean = (F.col("tpr") + F.lag("tpr", 1, 0.0).over(before)) / 2
    return curve.withColumn("part", width * mean).agg(
        F.count(F.lit(1)).alias("points"), F.sum("part").alias("auc"), F.sum("slack").alias("slack")
    )
