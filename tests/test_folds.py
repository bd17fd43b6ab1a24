import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stellarate.plans import folds, training

SCHEMA = (
    "review_id string, review_stars double, business_review_count long, business_stars double, "
    "business_noiselevel string, business_ambience string, revised_text string"
)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def reviews(count=240, seed=2):
    """A third of the rows in one category; some values so rare that a fold may not have them."""
    rng = random.Random(seed)
    words = "great awful food place kind service slow never again table".split()
    noises = ["quiet", "loud", "very_loud", "average"]
    return [
        (
            f"r{i}", float(rng.randint(1, 5)), rng.randint(3, 900), rng.choice([1.5, 3.0, 4.5]),
            "quiet" if rng.random() < 0.4 else rng.choice(noises),
            f"rare{i}" if i % 60 == 0 else rng.choice(["casual", "classy", "romantic"]),
            " ".join(rng.choices(words, k=rng.randint(0, 12))),
        )
        for i in range(count)
    ]


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("min_doc_freq", [1, 30])
def test_features_are_those_of_stages_fitted_per_fold(spark, text, min_doc_freq):
    options = training.Options(text_features=text, hashed_terms=64, min_doc_freq=min_doc_freq)
    frame = frame_of(spark, reviews())
    if text:
        frame = PipelineModel(stages=training.term_stages(options)).transform(frame)
    folded = training.with_folds(frame, options).persist()
    sides = folds.sides_of(training.fold_statistics(folded, options), options.folds)
    for number, side in enumerate(sides):
        learn = folded.where(F.col("_fold") != number)
        fitted = Pipeline(stages=training.model_stages(options, with_terms=False)).fit(learn)
        expected = fitted.transform(folded).select("review_id", vector_to_array("features").alias("x"), "label")
        found = training.fold_features(folded, side, options)
        found = found.select("review_id", vector_to_array("features").alias("x"), "label")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    folded.unpersist()


def test_scores_are_those_of_stages_fitted_per_fold(spark):
    """Cross-validation chooses as it did when every stage was fitted for every fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    options = training.Options(parallelism=2)
    frame = frame_of(spark, reviews()).persist()
    classifier = LogisticRegression()
    grid = training.parameter_grid(classifier, options)
    found = training.cross_validate(frame, classifier, grid, options)
    folded = training.with_folds(frame, options)
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")
    totals = [0.0] * len(grid)
    for number in range(options.folds):
        learn = folded.where(F.col("_fold") != number)
        fitted = Pipeline(stages=training.model_stages(options)).fit(learn)
        held_out = fitted.transform(folded.where(F.col("_fold") == number))
        for i, params in enumerate(grid):
            model = classifier.fit(fitted.transform(learn), params)
            totals[i] += evaluator.evaluate(model.transform(held_out)) / options.folds
    assert found == pytest.approx(totals, abs=1e-6)
    frame.unpersist()


def test_training_side_is_all_but_the_fold(spark):
    rows = [(0, "a", 1.0), (0, "a", 9.0), (1, "b", 4.0), (2, None, None), (2, "a", 2.0)]
    frame = spark.createDataFrame(rows, "_fold int, colour string, size double")
    sums = folds.fold_sums(frame, "_fold", ["colour"], "size")
    sides = folds.sides_of(folds.training_sums(sums, 4), 4)
    assert [(s.rows, s.lo, s.hi) for s in sides] == [(3, 2.0, 4.0), (4, 1.0, 9.0), (3, 1.0, 9.0), (5, 1.0, 9.0)]
    assert [s.labels("colour") for s in sides] == [["a", "b"], ["a"], ["a", "b"], ["a", "b"]]


def test_one_fold_leaves_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(0, "a", 1.0)], "_fold int, colour string, size double")
    side = folds.sides_of(folds.training_sums(folds.fold_sums(frame, "_fold", ["colour"], "size"), 1), 1)[0]
    assert (side.rows, side.lo, side.labels("colour"), side.idf(3, 1)) == (0, None, [], [0.0] * 3)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "_fold int, colour string, size double")
    assert folds.training_sums(folds.fold_sums(frame, "_fold", ["colour"], "size"), 3).collect() == []


def test_expression_scores_rows_with_unknown_categories(spark):
    """The model as an expression over raw columns gives the pipeline's scores, also for new values."""
    options = training.Options(reg_params=(0.01,), elastic_net_params=(0.0,), validate=False)
    rows = reviews()
    trained = training.train(frame_of(spark, rows), options)
    strange = [("n1", 4.0, 5000, 4.5, "silent", "casual", "x"), ("n2", 4.0, 1, 1.0, "loud", "odd", "")]
    scored = training.with_score(trained.model.transform(frame_of(spark, [*rows, *strange])))
    named = training.coefficients(trained, scored)
    again = scored.withColumn("again", training.score_expression(trained, named, options))
    assert again.where("abs(again - score) > 1e-12").count() == 0
    certified = training.fit_optimality(trained, frame_of(spark, rows)).collect()
    assert {r.name for r in certified} >= {"intercept", "countScaled_0", "ambienceVector_casual"}
    assert max(r.residual for r in certified) < 1e-4
    with pytest.raises(ValueError):
        training.score_expression(trained, named, training.Options(text_features=True))
