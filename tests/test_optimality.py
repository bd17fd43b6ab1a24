import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from stellarate.operators import optimality as opt


def sample(count=300, seed=1):
    """Rows with a constant, a rare, a scaled and a repeated feature; some vectors are sparse."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        x = [rng.gauss(0, 1), 100 * rng.gauss(0, 1), 7.0, float(i % 50 == 0), 0.0, rng.choice([0.0, 1.0])]
        y = float(rng.random() < 1 / (1 + math.exp(-(x[0] - 0.01 * x[1] + 0.5))))
        vector = Vectors.dense(x) if i % 2 else Vectors.sparse(6, [(j, v) for j, v in enumerate(x) if v])
        rows.append((vector, y))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(rows, ["features", "label"]).repartition(3)


def loss_slopes(rows, model, reg, share, standard=True):
    """Right and left slopes of the penalised loss in each direction, by small steps."""
    x = np.array([v.toArray() for v, _ in rows])
    y = np.array([label for _, label in rows])
    scale = x.std(axis=0, ddof=1)
    start = np.append(model.coefficients.toArray(), model.intercept)

    def loss(at):
        margin = x @ at[:-1] + at[-1]
        fit = np.mean(np.logaddexp(0, margin) - y * margin)
        b = at[:-1] * scale if standard else at[:-1]
        return fit + reg * (share * np.abs(b).sum() + (1 - share) / 2 * (b * b).sum())

    out = []
    for j in range(len(start)):
        own = scale[j] if j < len(scale) and scale[j] > 0 else 1.0
        step = np.zeros(len(start))
        step[j] = 1e-6 / own
        out.append(((loss(start) - loss(start - step)) / 1e-6, (loss(start + step) - loss(start)) / 1e-6))
    return out


@pytest.mark.parametrize("reg, share", [(0.0, 0.0), (0.1, 0.0), (0.02, 1.0), (0.05, 0.5), (1.0, 1.0)])
@pytest.mark.parametrize("standard", [True, False])
def test_fits_are_optimal_and_intervals_are_slopes(spark, reg, share, standard):
    rows = sample()
    frame = frame_of(spark, rows)
    classifier = LogisticRegression(
        regParam=reg, elasticNetParam=share, standardization=standard, tol=1e-10, maxIter=500
    )
    model = classifier.fit(frame)
    found = {r.idx: r for r in opt.optimality(model.transform(frame), model).collect()}
    assert sorted(found) == [-1, *range(6)]
    assert max(r.residual for r in found.values()) < 1e-4
    slopes = loss_slopes(rows, model, reg, share, standard)
    for idx in (0, 1, 3, 5, -1):
        low, high = slopes[idx if idx >= 0 else 6]
        assert found[idx].low == pytest.approx(low, abs=2e-4)
        assert found[idx].high == pytest.approx(high, abs=2e-4)


def test_a_fit_cut_short_is_not_optimal(spark):
    frame = frame_of(spark, sample())
    model = LogisticRegression(maxIter=1).fit(frame)
    found = opt.optimality(model.transform(frame), model).collect()
    assert max(r.residual for r in found) > 1e-3


def test_a_fit_of_other_rows_is_not_optimal(spark):
    frame, other = frame_of(spark, sample()), frame_of(spark, sample(seed=9))
    model = LogisticRegression(regParam=0.01).fit(other)
    assert max(r.residual for r in opt.optimality(model.transform(frame), model).collect()) > 1e-3


def test_repeated_rows_and_rows_without_a_label(spark):
    rows = sample(60)
    model = LogisticRegression(regParam=0.1).fit(frame_of(spark, rows * 3))
    plain = opt.optimality(model.transform(frame_of(spark, rows * 3)), model).collect()
    more = frame_of(spark, [*rows * 3, (rows[0][0], None), (rows[1][0], None)])
    assert [r.idx for r in plain] == [-1, *range(6)]
    for a, b in zip(plain, opt.optimality(model.transform(more), model).collect()):
        assert a.residual == pytest.approx(b.residual, abs=1e-12)


def test_no_rows(spark):
    frame = frame_of(spark, sample(30))
    model = LogisticRegression(regParam=0.1).fit(frame)
    found = opt.optimality(model.transform(frame.limit(0)), model).collect()
    assert [r.residual for r in found] == [None] * 7


def test_no_intercept(spark):
    frame = frame_of(spark, sample())
    model = LogisticRegression(fitIntercept=False, regParam=0.05, tol=1e-10).fit(frame)
    found = {r.idx: r.residual for r in opt.optimality(model.transform(frame), model).collect()}
    assert found[-1] == 0 and max(found[i] for i in (0, 1, 3, 5)) < 1e-4


def test_entries_of_dense_and_sparse(spark):
    rows = [(Vectors.dense([0.0, 2.0]),), (Vectors.sparse(2, [1], [2.0]),), (Vectors.sparse(2, [], []),)]
    frame = spark.createDataFrame(rows, ["v"])
    got = [[tuple(e) for e in r[0]] for r in frame.select(opt.entries("v")).collect()]
    assert got == [[(0, 0.0), (1, 2.0)], [(1, 2.0)], []]
