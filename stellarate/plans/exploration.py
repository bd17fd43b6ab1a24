"""Exploration reports of the review tables, each a dict of named result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.functions.text import char_count, has_text, word_count
from stellarate.operators import distributions as dist
from stellarate.operators import profile as prof

# Edges of the star-rating histogram.
STAR_EDGES = [1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]


def profile_tables(tables: dict[str, DataFrame], without_duplicates: tuple[str, ...] = ()) -> DataFrame:
    """Profiles of several tables in one long frame."""
    parts = [
        prof.profile(df, name, duplicates=name not in without_duplicates)
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def with_text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(
        {"characters": char_count(F.col(text)), "words": word_count(F.col(text))}
    )


def count_with_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count_if(has_text(F.col(text))).alias("rows_with_text"))


def explore_tips(tips: DataFrame) -> dict[str, DataFrame]:
    lengths = with_text_lengths(tips)
    return {
        "profile": prof.profile(tips, "tip"),
        "dates": prof.value_range(tips, "date"),
        "with_text": count_with_text(tips),
        "lengths": lengths,
        "length_scatter": dist.scatter_counts(lengths, "characters", "words"),
    }


def explore_checkins(checkins: DataFrame) -> dict[str, DataFrame]:
    return {
        "profile": prof.profile(checkins, "checkin"),
        "dates": prof.value_range(checkins, "date"),
    }


def explore_businesses(businesses: DataFrame) -> dict[str, DataFrame]:
    return {
        "profile": prof.profile(businesses, "business", duplicates=False),
        "stars": dist.automatic_histogram(businesses, "stars"),
        "stars_by_edges": dist.histogram_of_edges(businesses, "stars", STAR_EDGES),
        "top_cities": dist.top_values(businesses, "city", 10),
    }


def explore_users(users: DataFrame, seed: int = 0) -> dict[str, DataFrame]:
    """``user_id`` is text and so has no place in the correlation matrix."""
    basics = ["count", "min", "max", "mean"]
    return {
        "rows": prof.row_count(users),
        "describe": prof.describe_all(users),
        "summary": prof.summary_all(users),
        "rating_summary": prof.summary(users, ["average_stars", "review_count"], basics),
        "social_summary": prof.summary(users, ["fans", "friends", "useful"], basics),
        "nulls": prof.null_counts(
            users, ["average_stars", "review_count", "user_id", "friends"]
        ),
        "dates": prof.value_range(users, "yelping_since"),
        "stars": dist.histogram(users, "average_stars", 10),
        "stars_box": dist.box_statistics(users, "average_stars"),
        "review_count_box": dist.box_statistics(users, "review_count"),
        "correlation": dist.correlation(users, ["useful", "average_stars", "review_count"]),
        "stars_scatter": dist.scatter_sample(
            users, "average_stars", "review_count", ["user_id"], 0.2, seed
        ),
        "useful_scatter": dist.scatter_sample(
            users, "useful", "review_count", ["user_id"], 0.2, seed
        ),
    }


def explore_reviews(reviews: DataFrame) -> dict[str, DataFrame]:
    lengths = with_text_lengths(reviews)
    return {
        "describe": prof.describe_all(reviews),
        "summary": prof.summary_all(reviews),
        "vote_summary": prof.summary(
            reviews, ["stars", "cool", "funny", "useful"], ["count", "min", "max", "mean"]
        ),
        "nulls": prof.null_counts(
            reviews, ["business_id", "date", "user_id", "review_id", "text", "stars"]
        ),
        "dates": prof.value_range(reviews, "date"),
        "lengths": lengths,
        "stars_box": dist.box_statistics(reviews, "stars"),
        "correlation": dist.correlation(lengths, ["stars", "useful", "words"]),
        "stars": dist.automatic_histogram(reviews, "stars"),
        "stars_10": dist.histogram(reviews, "stars", 10),
    }


def explore_training_frame(
    frame: DataFrame, keys: list[str], seed: int = 0
) -> dict[str, DataFrame]:
    """Distributions and correlation of the joined frame."""
    counts = ["business_review_count", "business_stars", "review_stars"]
    return {
        "business_stars": dist.automatic_histogram(frame, "business_stars"),
        "review_stars": dist.automatic_histogram(frame, "review_stars"),
        "stars_scatter": dist.scatter_sample(
            frame, "business_stars", "business_review_count", keys, 0.05, seed
        ),
        "correlation": dist.correlation(frame, counts),
    }
