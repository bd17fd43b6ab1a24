from __future__ import annotations

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from stellarate.operators import evaluation


def scored(spark, rows):
    return spark.createDataFrame(rows, "label double, prediction double, score double")


def test_confusion_with_one_predicted_class(spark):
    frame = scored(spark, [(1.0, 0.0, 0.1), (0.0, 0.0, 0.2), (0.0, 0.0, 0.3)])
    got = {r.label: (r.predicted_0, r.predicted_1) for r in evaluation.confusion_matrix(frame).collect()}
    assert got == {0.0: (2, 0), 1.0: (1, 0)}
    metrics = evaluation.class_metrics(frame).first()
    assert metrics.precision is None and metrics.recall == 0.0 and metrics.f1 is None
    assert metrics.accuracy == pytest.approx(2 / 3)


def test_metrics(spark):
    cells = [(1.0, 1.0)] * 3 + [(0.0, 1.0)] + [(1.0, 0.0)] * 2 + [(0.0, 0.0)] * 4
    row = evaluation.class_metrics(scored(spark, [(a, b, 0.0) for a, b in cells])).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (3, 1, 2, 4)
    assert row.precision == 0.75 and row.recall == 0.6 and row.accuracy == 0.7
    assert row.f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35)


def pairs_auc(rows):
    positive = [s for label, _, s in rows if label == 1]
    negative = [s for label, _, s in rows if label == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return won / (len(positive) * len(negative))


@pytest.fixture(scope="module")
def ranked_rows():
    rows = [(float(i * 7 % 5 > 1), 0.0, float(i * 37 % 101) / 3) for i in range(500)]
    return rows + [(1.0, 0.0, 9.0)] * 150 + [(0.0, 0.0, 9.0)] * 100


@pytest.mark.parametrize("points", [[-30.0, -9.0, -5.0], None])
def test_auc_is_the_share_of_ordered_pairs(spark, ranked_rows, monkeypatch, points):
    if points is not None:
        monkeypatch.setattr(evaluation, "cut_points", lambda df, value: points)
    frame = scored(spark, ranked_rows)
    exact = evaluation.area_under_roc(frame, "score").first().auc
    assert exact == pytest.approx(pairs_auc(ranked_rows))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score")
    assert exact == pytest.approx(evaluator.evaluate(frame), abs=1e-2)


def test_roc_is_monotone_and_ends_at_one(spark, ranked_rows):
    points = evaluation.roc_points(scored(spark, ranked_rows), "score").collect()
    points = sorted(points, key=lambda r: -(r.threshold if r.threshold is not None else 1e9))
    assert (points[0].fpr, points[0].tpr) == (0.0, 0.0)
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    for before, after in zip(points, points[1:]):
        assert before.fpr <= after.fpr and before.tpr <= after.tpr


def test_auc_of_one_class_is_null(spark):
    assert evaluation.area_under_roc(scored(spark, [(1.0, 1.0, 0.5)]), "score").first().auc is None


def test_rows_without_a_label_are_left_out(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0), (0.0, 1.0), (None, 1.0), (None, 0.0)], "label double, prediction double"
    )
    got = sorted(map(tuple, evaluation.confusion_matrix(rows).collect()))
    assert got == [(0.0, 0, 1), (1.0, 0, 1)]
