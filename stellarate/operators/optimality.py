"""Whether a fitted logistic regression is at the optimum of its penalised loss.

The loss is convex, so a fit is optimal exactly where 0 is a subgradient. That is checked
on the rows themselves and not on what the solver reports: one aggregate over all rows
gives the gradient, and the L1 penalty widens it to an interval where a coefficient is 0.
"""

from __future__ import annotations

from math import sqrt

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of the intercept's row, which has no penalty.
INTERCEPT = -1


def entries(features: str) -> Column:
    """The entries of a vector that are held, as array<struct<idx, x>>."""
    vector = F.unwrap_udt(features)
    sparse = F.transform(
        F.arrays_zip(vector["indices"].alias("idx"), vector["values"].alias("x")),
        lambda e: F.struct(e["idx"].alias("idx"), e["x"].alias("x")),
    )
    dense = F.transform(vector["values"], lambda x, i: F.struct(i.alias("idx"), x.alias("x")))
    return F.when(vector["type"] == 0, sparse).otherwise(dense)


def gradient_sums(scored: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(idx, n, error, total, square) per feature, of rows with ``probability``.

    Sums over the rows of (p - y) x, of x and of x squared; the intercept counts as x = 1
    in every row. Only entries that are not 0 are looked at, and each task adds up its own
    rows before anything is shuffled. Rows without a label are left out.
    """
    error = vector_to_array("probability")[1] - F.col(label)
    one = F.array(F.struct(F.lit(INTERCEPT).alias("idx"), F.lit(1.0).alias("x")))
    rows = scored.where(F.col(label).isNotNull()).select(
        error.alias("error"), F.explode(F.concat(one, entries(features))).alias("e")
    )
    x = F.col("e.x")
    return rows.where("e.x != 0").groupBy("e.idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("error") * x).alias("error"),
        F.sum(x).alias("total"),
        F.sum(x * x).alias("square"),
    )


def interval(gradient: float, coefficient: float, l1: float) -> tuple[float, float]:
    """The subgradients of one coefficient, given the gradient of the smooth part."""
    if coefficient == 0:
        return gradient - l1, gradient + l1
    bound = gradient + (l1 if coefficient > 0 else -l1)
    return bound, bound


def optimality(
    scored: DataFrame, model: LogisticRegressionModel, features: str = "features", label: str = "label"
) -> DataFrame:
    """(idx, coefficient, low, high, residual) for the intercept (idx -1) and each feature.

    ``scored`` holds the rows that ``model`` was fitted on, with its probabilities. The
    penalty applies to features divided by their standard deviation, so subgradients are
    those of the scaled coefficients. ``residual`` is the distance of 0 from [low, high]:
    0 at the optimum. A feature with one value everywhere has to have coefficient 0. No rows
    give no residuals (null). What reaches the driver has one row per feature, like the model.
    """
    reg, share = model.getRegParam(), model.getElasticNetParam()
    l1, l2 = reg * share, reg * (1 - share)
    standard = model.getStandardization()
    sums = {r.idx: r for r in gradient_sums(scored, features, label).collect()}
    count = sums[INTERCEPT].n if sums else 0
    rows = []
    for idx, coefficient in [(INTERCEPT, model.intercept), *enumerate(model.coefficients.toArray().tolist())]:
        if not count:
            rows.append((idx, float(coefficient), None, None, None))
            continue
        found = sums.get(idx)
        if idx == INTERCEPT:
            low = high = found.error / count
            if not model.getFitIntercept():
                low, high = float("-inf"), float("inf")
        else:
            low, high = coefficient_interval(found, count, coefficient, l1, l2, standard)
        residual = max(low, -high, 0.0)
        rows.append((idx, float(coefficient), low, high, residual))
    return scored.sparkSession.createDataFrame(
        rows, "idx int, coefficient double, low double, high double, residual double"
    )


def coefficient_interval(found, count: int, coefficient: float, l1: float, l2: float, standard: bool):
    """Subgradients of one feature's scaled coefficient; ``found`` has its sums, None if all are 0."""
    if found is None:
        return coefficient, coefficient
    spread = found.square - found.total * found.total / count
    scale = sqrt(max(spread, 0.0) / (count - 1)) if count > 1 else 0.0
    if spread <= 1e-12 * found.square:
        return coefficient, coefficient
    gradient = found.error / count / scale
    if standard:
        return interval(gradient + l2 * coefficient * scale, coefficient, l1)
    # the penalty is then on the coefficients as they are
    return interval(gradient + l2 * coefficient / scale, coefficient, l1 / scale)
