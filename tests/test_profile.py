from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from stellarate.operators import profile as prof

ROWS = [
    (1, 0.5, "a", ("x",)),
    (2, float("nan"), "b", None),
    (3, None, None, ("y",)),
    (1, 0.5, "a", ("x",)),
    (1, 0.5, "a", ("x",)),
    (4, -0.0, "z", None),
    (4, 0.0, "z", None),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(ROWS, "n int, x double, s string, o struct<f: string>")


def test_null_counts_with_and_without_nan(mixed):
    assert prof.null_counts(mixed).first().asDict() == {"n": 0, "x": 1, "s": 1, "o": 3}
    assert prof.null_counts(mixed, nan_as_null=True).first()["x"] == 2
    assert prof.nonnull_counts(mixed).first().asDict() == {"n": 7, "x": 6, "s": 6, "o": 4}


def test_null_rows_and_columns(mixed):
    assert prof.null_rows(mixed).first()[0] == 4
    assert {tuple(r) for r in prof.null_columns(mixed).collect()} == {("x", 1), ("s", 1), ("o", 3)}


def test_duplicates_with_nested_columns_and_signed_zero(mixed):
    assert prof.duplicate_rows(mixed).first()[0] == 3


def test_duplicates_tell_null_from_text(spark):
    rows = spark.createDataFrame([("null", None), (None, "null"), (None, None)], "a string, b string")
    assert prof.duplicate_rows(rows).first()[0] == 0
    assert prof.duplicate_rows(rows.where("1 = 0")).first()[0] == 0


def test_describe_is_that_of_pandas(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {
            "skewed": np.where(rng.random(500) < 0.4, 3.0, rng.normal(0, 100, 500)),
            "small": rng.integers(1, 6, 500),
        }
    )
    frame.loc[::17, "skewed"] = np.nan
    got = prof.describe_numeric(spark.createDataFrame(frame)).toPandas()
    table = got.pivot(index="stat", columns="column", values="value")
    expected = frame.describe()
    for stat in expected.index:
        assert np.allclose(table.loc[stat, ["skewed", "small"]], expected.loc[stat])


def test_describe_of_empty_column(spark):
    rows = spark.createDataFrame([(None, 1.0)], "x double, y double")
    got = {(r["column"], r.stat): r.value for r in prof.describe_numeric(rows).collect()}
    assert got[("x", "count")] == 0 and got[("x", "50%")] is None and got[("y", "50%")] == 1.0
    assert len(got) == 16


def test_summary_of_text_is_lexicographic(mixed):
    got = {r.stat: (r.value, r.text) for r in prof.summary(mixed, ["s"], ["count", "min", "max", "mean"]).collect()}
    assert got == {"count": (6.0, None), "min": (None, "a"), "max": (None, "z"), "mean": (None, None)}


def test_approximate_quartiles_are_near(spark):
    got = {r.stat: r.value for r in prof.summary_all(spark.range(1001)).collect()}
    assert abs(got["50%"] - 500) <= 2 and got["max"] == 1000.0


def test_profile_parts(mixed):
    rows = prof.profile(mixed, "mixed").collect()
    table = {(r["column"], r.stat): r for r in rows}
    assert table[(prof.TABLE, "duplicate_rows")].value == 3
    assert table[(prof.TABLE, "null_rows")].value == 4
    assert table[("x", "type")].text == "double" and table[("x", "nulls")].value == 2
    assert all(r.source == "mixed" for r in rows)
    bare = prof.profile(mixed, "mixed", duplicates=False).collect()
    assert "duplicate_rows" not in {r.stat for r in bare}


def test_duplicates_to_the_microsecond_and_nested(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES
        (timestamp'2020-01-01 00:00:00.123456', map('a', 1, 'b', 2), named_struct('x', array(0.0D))),
        (timestamp'2020-01-01 00:00:00.123999', map('a', 1, 'b', 2), named_struct('x', array(0.0D))),
        (timestamp'2020-01-01 00:00:00.123456', map('b', 2, 'a', 1), named_struct('x', array(-0.0D))),
        (timestamp'2020-01-01 00:00:00.123456', map('a', 1, 'b', 3), named_struct('x', array(0.0D))),
        (null, null, null), (null, null, null) AS t(ts, m, s)"""
    )
    assert prof.duplicate_rows(rows).first()[0] == 2


def test_extremes_of_longs_are_exact(spark):
    rows = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "id long")
    text = {r.stat: r.text for r in prof.summary(rows, ["id"], ["min", "max"]).collect()}
    assert text == {"min": "9007199254740992", "max": "9007199254740993"}
