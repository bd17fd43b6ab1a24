"""Cleaning, exploration and training on small review tables written as JSON lines."""

from __future__ import annotations

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stellarate.plans import cleaning, exploration, training
from stellarate.sources.tables import Layout, read_parquet

OPTIONS = training.Options(parallelism=2)


def business(number: int) -> dict:
    return {
        "business_id": f"b{number}",
        "name": f"Place {number}",
        "address": "1 Main St",
        "city": ["Reno", "Tampa", "Boise"][number % 3],
        "state": "NV",
        "postal_code": "89501",
        "latitude": 39.5,
        "longitude": -119.8,
        "stars": 1 + number % 9 / 2,
        "review_count": 5 + number,
        "is_open": 1,
        "categories": "Food" if number else None,
        "hours": {"Monday": "8:0-17:0"} if number % 2 else None,
        "attributes": {
            "NoiseLevel": ["quiet", "loud", "average"][number % 3],
            "Ambience": ["casual", "classy"][number % 2],
            "WiFi": "free",
        }
        if number != 1
        else None,
    }


def review(number: int) -> dict:
    # A third of all reviews are of one business.
    place = 2 if number % 3 == 0 else number % 12
    return {
        "review_id": f"r{number}",
        "user_id": f"u{number % 40}",
        "business_id": f"b{place}",
        "stars": float(1 + (number * 7 + place) % 5),
        "useful": number % 4,
        "funny": 0,
        "cool": 1,
        "text": f"I don't know, it's place {place}. " + "good " * (number % 5)
        if number != 5
        else None,
        "date": f"2018-01-{1 + number % 28:02d} 10:00:00",
    }


def user(number: int) -> dict:
    return {
        "user_id": f"u{number}",
        "name": "N",
        "review_count": number * 3,
        "yelping_since": f"2010-02-{1 + number % 28:02d} 00:00:00",
        "useful": number,
        "funny": 1,
        "cool": 2,
        "elite": "",
        "friends": "None",
        "fans": number % 3,
        "average_stars": 1 + number % 17 / 4,
        "compliment_cool": 0,
        "compliment_cute": 0,
        "compliment_funny": 0,
        "compliment_hot": 0,
        "compliment_list": 0,
        "compliment_more": 0,
        "compliment_note": 0,
        "compliment_photos": 0,
        "compliment_plain": 0,
        "compliment_profile": 0,
        "compliment_writer": 0,
    }


@pytest.fixture(scope="module")
def layout(tmp_path_factory) -> Layout:
    root = tmp_path_factory.mktemp("store")
    (root / "landing").mkdir()
    tables = {
        "business": [business(n) for n in range(12)],
        "review": [review(n) for n in range(600)],
        "user": [user(n) for n in range(40)],
        "tip": [
            {"business_id": "b2", "user_id": "u1", "text": t, "date": "2019-01-01", "compliment_count": 0}
            for t in ["nice", "", "nice", "two words"]
        ],
        "checkin": [{"business_id": f"b{n}", "date": "2019-01-01, 2019-02-01"} for n in range(5)],
    }
    for name, rows in tables.items():
        lines = "\n".join(json.dumps(row) for row in rows)
        (root / "landing" / f"data_{name}.json").write_text(lines)
    return Layout(str(root), "data_")


@pytest.fixture(scope="module")
def cleaned(spark, layout):
    return {name: cleaning.clean_table(spark, layout, name) for name in cleaning.RULES}


def test_cleaned_columns_and_rows(cleaned):
    assert "compliment_count" not in cleaned["tip"].columns
    assert set(cleaned["user"].columns) == {
        "average_stars", "review_count", "useful", "user_id", "yelping_since"
    }
    assert "hours" not in cleaned["business"].columns
    assert cleaned["business"].count() == 10  # b0 lacks categories, b1 attributes
    assert cleaned["review"].count() == 600 and cleaned["checkin"].count() == 5


def test_null_report(spark, layout, cleaned):
    raw = cleaning.landing_table(spark, layout, "business")
    report = {r["column"]: (r.before, r.after) for r in cleaning.null_report(raw, cleaned["business"]).collect()}
    assert report["categories"] == (1, 0) and report["attributes"] == (1, 0)
    assert report["hours"] == (6, None)


def test_inferred_scan_keeps_other_attributes(spark, layout):
    raw = cleaning.landing_table(spark, layout, "business")
    assert raw.where("attributes.WiFi = 'free'").count() == 11


def test_writing_twice_fails_unless_told(spark, layout, cleaned):
    with pytest.raises(Exception, match="(?i)exists"):
        cleaning.clean_table(spark, layout, "tip")
    assert cleaning.clean_table(spark, layout, "tip", mode="overwrite").count() == 4


def test_exploration_reports(spark, layout, cleaned):
    raw = {name: cleaning.landing_table(spark, layout, name) for name in cleaning.RULES}
    tips = exploration.explore_tips(raw["tip"])
    assert tips["with_text"].first()[0] == 3
    assert [r.words for r in tips["lengths"].collect()] == [1, None, 1, 2]
    places = exploration.explore_businesses(raw["business"])
    assert [tuple(r) for r in places["top_cities"].collect()] == [("Boise", 4), ("Reno", 4), ("Tampa", 4)]
    users = exploration.explore_users(raw["user"])
    assert sum(r["count"] for r in users["stars"].collect()) == 40
    reviews = exploration.explore_reviews(raw["review"])
    assert reviews["dates"].first().oldest == "2018-01-01 10:00:00"
    for report in (tips, places, users, reviews, exploration.explore_checkins(raw["checkin"])):
        for frame in report.values():
            frame.collect()


@pytest.fixture(scope="module")
def frame(cleaned, layout):
    joined = training.training_frame(cleaned["review"], cleaned["business"], fraction=1.0)
    return training.save_frame(joined, layout)


@pytest.fixture(scope="module")
def trained(frame):
    learn, test = training.split_frame(frame, OPTIONS)
    model = training.train(learn, OPTIONS)
    return model, learn, model.model.transform(test)


def test_frame(frame):
    # b0 and b1 are not among the cleaned businesses; review 5 has no text.
    expected = [n for n in range(600) if review(n)["business_id"] not in ("b0", "b1") and n != 5]
    assert {r.review_id for r in frame.select("review_id").collect()} == {f"r{n}" for n in expected}
    assert {"cool", "funny", "business_name", "business_noiselevel"} <= set(frame.columns)
    assert "useful" not in frame.columns
    first = frame.where("review_id = 'r3'").first()
    assert first.revised_text.startswith("I do not know, it is place 2.")


def test_sampling_before_the_join_gives_the_same_rows(cleaned, frame):
    sampled = training.training_frame(cleaned["review"], cleaned["business"], fraction=0.4)
    from stellarate.functions.sampling import hash_sample

    after = hash_sample(frame, ["review_id"], 0.4, 42)
    ids = {r.review_id for r in sampled.select("review_id").collect()}
    assert ids == {r.review_id for r in after.select("review_id").collect()} and ids


def test_grid_and_best(trained, frame):
    model, _, _ = trained
    rows = training.grid_scores(model, frame).collect()
    assert len(rows) == 4 and sum(r.best for r in rows) == 1
    assert all(0.0 <= r.auc <= 1.0 for r in rows)
    best = next(r for r in rows if r.best)
    assert best.auc == max(r.auc for r in rows)
    params = {r.param: r.value for r in training.best_parameters(model, frame).collect()}
    assert float(params["regParam"]) == best.reg_param


def test_same_seed_same_model(trained):
    model, learn, _ = trained
    again = training.train(learn.repartition(5), OPTIONS)
    assert again.best == model.best
    for a, b in zip(model.classifier.coefficients, again.classifier.coefficients):
        assert a == pytest.approx(b, abs=1e-4)


def test_features(trained):
    _, _, predictions = trained
    for column in ("ambienceVector", "noiseVector", "starVector"):
        sums = predictions.select(F.aggregate(vector_to_array(column), F.lit(0.0), lambda a, x: a + x))
        assert {r[0] for r in sums.collect()} == {1.0}
    scaled = [r[0] for r in predictions.select(vector_to_array("countScaled")[0]).collect()]
    assert all(-0.5 <= value <= 1.5 for value in scaled)
    assert {"words", "revised_words", "word_features", "IDF_features"} <= set(predictions.columns)


def test_evaluation(trained):
    _, _, predictions = trained
    parts = {name: part.collect() for name, part in training.evaluate(predictions).items()}
    cells = sum(r.predicted_0 + r.predicted_1 for r in parts["confusion"])
    metrics = parts["metrics"][0]
    assert cells == metrics.tp + metrics.fp + metrics.fn + metrics.tn == predictions.count()
    assert 0.0 <= parts["auc"][0].auc <= 1.0


def test_coefficient_names(trained):
    model, _, predictions = trained
    names = [r.name for r in training.coefficients(model, predictions).orderBy("idx").collect()]
    assert len(names) == model.classifier.numFeatures == len(set(names))
    assert names[0] == "countScaled_0" and any(n.startswith("ambienceVector_") for n in names)


def test_text_features_extend_the_vector(frame):
    options = training.Options(
        text_features=True, hashed_terms=64, reg_params=(0.1,), elastic_net_params=(0.0,)
    )
    model = training.train(frame, options)
    plain = training.train(frame, training.Options(reg_params=(0.1,), elastic_net_params=(0.0,)))
    assert model.classifier.numFeatures == plain.classifier.numFeatures + 64


def test_save_and_load(spark, trained, layout):
    model, learn, predictions = trained
    training.save(model, predictions, layout)
    stored = read_parquet(spark, layout.trusted("predictions"))
    assert stored.count() == predictions.count()
    loaded = PipelineModel.load(layout.model("pipeline"))
    again = loaded.transform(stored.select(*learn.columns))
    pairs = again.select("review_id", "prediction").exceptAll(stored.select("review_id", "prediction"))
    assert pairs.count() == 0


def test_token_weights_are_those_of_spark(spark, frame, tmp_path):
    """ln((m + 1) / (df + 1)) per token, by brute force."""
    from stellarate.functions.text import tokenize
    from stellarate.operators.tfidf import token_tfidf
    from math import log

    rows = frame.select("review_id", "text").collect()
    got = token_tfidf(frame, "review_id", tokenize(F.col("text")), str(tmp_path / "terms")).collect()
    words = {r.review_id: r.text.lower().replace(".", " ").replace(",", " ").replace("'", " ").split() for r in rows}
    documents = {}
    for tokens in words.values():
        for token in set(tokens):
            documents[token] = documents.get(token, 0) + 1
    assert len(got) == sum(len(set(tokens)) for tokens in words.values())
    for row in got:
        assert row.tf == words[row.review_id].count(row.token)
        assert row.df == documents[row.token]
        assert row.idf == pytest.approx(log((len(rows) + 1) / (row.df + 1)))


def test_hot_tokens_give_the_same_weights(spark, frame, tmp_path):
    from stellarate.functions.text import tokenize
    from stellarate.operators.tfidf import token_tfidf

    words = tokenize(F.col("text"))
    plain = token_tfidf(frame, "review_id", words, str(tmp_path / "a"))
    split = token_tfidf(frame, "review_id", words, str(tmp_path / "b"), rows_per_part=20)
    assert sorted(plain.collect()) == sorted(split.collect())


def test_nothing_is_lost_on_landing(spark, tmp_path):
    """Unknown columns and nested fields stay; broken lines go to the rejects."""
    store = Layout(str(tmp_path))
    (tmp_path / "landing").mkdir()
    lines = [json.dumps(business(n) | {"extra": [n]}) for n in range(2, 8)]
    lines += ['{"business_id": "b9", "stars": ', "", '{"stars": "many"}', "[1]"]
    (tmp_path / "landing" / "business.json").write_text("\n".join(lines))
    kept = cleaning.clean_table(spark, store, "business")
    assert kept.select("attributes.WiFi").distinct().collect()[0][0] == "free"
    assert "extra" in kept.columns and kept.count() == 6
    rejects = sorted(r.line for r in read_parquet(spark, store.rejected("business")).collect())
    assert rejects == sorted(line for line in lines[6:] if line)


def test_grid_of_one_point_is_complete(spark, frame):
    single = training.Options(reg_params=(0.1,), elastic_net_params=(0.0,), parallelism=1)
    scores = training.grid_scores(training.train(frame, single), frame).collect()
    assert len(scores) == 1 and scores[0].best and 0 <= scores[0].auc <= 1
    quick = training.Options(parallelism=1, validate=False)
    assert [r.auc for r in training.grid_scores(training.train(frame, quick), frame).collect()] == [None] * 4
