import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stellarate.operators import distributions as dist
from stellarate.operators import profile as prof
from stellarate.operators import states as st

SCHEMA = (
    "file string, big long, x double, y float, d decimal(12,2), name string, flag boolean, "
    "day date, empty int, tags array<string>, `a.b` int"
)


def rows(count=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        x = rng.choice([None, float("nan"), rng.gauss(1e6, 1), rng.gauss(1e6, 1)])
        out.append((
            f"f{min(i % 7, 3)}", (1 << 62) + i % 40, x, rng.random() if i % 5 else None,
            Decimal(rng.randrange(10**6)) / 100, rng.choice(["a", "b", None]), i % 2 == 0,
            datetime.date(2020, 1, 1 + i % 28), None, ["t"] if i % 3 else None, i % 9,
        ))
    return out + out[:50] + [("late", None, None, None, None, None, None, None, None, None, None)]


def frame_of(spark, some):
    return spark.createDataFrame(some, SCHEMA).repartition(4)


def close(found, expected):
    key = lambda r: (r.source, r.column, r.stat)
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [key(r) for r in found] == [key(r) for r in expected]
    size = {r.column: abs(r.value) for r in expected if r.stat == "max" and r.value is not None}
    for a, b in zip(found, expected):
        # a mean of doubles is rounded to the digits of its column, and the spread about it too
        slack = max(1e-9, 1e-15 * size.get(a.column, 0.0)) if a.stat == "std" else 1e-9
        assert a.text == b.text, (a, b)
        assert a.value == (b.value if b.value is None else pytest.approx(b.value, rel=1e-9, abs=slack)), (a, b)


def test_states_of_files_add_up_to_the_profile(spark, tmp_path):
    """Files land in three loads; values far from 0, nulls, NaN, copies across files."""
    frame = frame_of(spark, rows())
    for load in ("file in ('f0', 'f1')", "file in ('f2', 'f3')", "file = 'late'"):
        st.add_states(st.file_states(frame.where(load), "file"), str(tmp_path))
    kept = st.kept_states(spark, str(tmp_path))
    data = frame.drop("file")
    close(st.merged_profile(kept, "t").collect(), prof.profile(data, "t").collect())
    expected = {(r.x, r.y): r.r for r in dist.correlation(data).collect()}
    found = {(r.x, r.y): r.r for r in st.correlation(kept).collect()}
    for pair, r in found.items():
        if r is not None and expected[pair] is not None and pair[0] != "empty":
            assert r == pytest.approx(expected[pair], abs=1e-6)
    assert set(found) >= {("x", "y"), ("y", "x"), ("d", "d"), ("a.b", "big")}


def test_a_file_more_changes_what_it_must(spark, tmp_path):
    some = rows()
    first, later = some[:100], [("new", *r[1:]) for r in some[100:]]
    st.add_states(st.file_states(frame_of(spark, first), "file"), str(tmp_path))
    before = st.merged_profile(st.kept_states(spark, str(tmp_path)), "t").collect()
    st.add_states(st.file_states(frame_of(spark, later), "file"), str(tmp_path))
    after = st.merged_profile(st.kept_states(spark, str(tmp_path)), "t").collect()
    close(before, prof.profile(frame_of(spark, first).drop("file"), "t").collect())
    close(after, prof.profile(frame_of(spark, first + later).drop("file"), "t").collect())


def test_only_the_parts_that_are_wanted(spark, tmp_path):
    states = st.file_states(frame_of(spark, rows()), "file")
    st.add_states(states, str(tmp_path), ("columns", "pairs"))
    kept = st.kept_states(spark, str(tmp_path), ("columns", "pairs"))
    assert kept.values is None and st.correlation(kept).count() > 0


def test_text_columns_only_and_one_column(spark):
    frame = spark.createDataFrame([("f", "a"), ("f", None), ("g", "a")], "file string, name string")
    found = st.merged_profile(st.file_states(frame, "file"), "t").collect()
    close(found, prof.profile(frame.drop("file"), "t").collect())
    one = spark.createDataFrame([("f", 1), ("g", 1)], "file string, n int")
    close(st.merged_profile(st.file_states(one, "file"), "t").collect(), prof.profile(one.drop("file"), "t").collect())


def test_no_rows(spark):
    states = st.file_states(frame_of(spark, rows()).where("file = 'none'"), "file")
    found = {(r.column, r.stat): r.value for r in st.merged_profile(states, "t").collect()}
    assert found == {
        ("(table)", "rows"): 0.0, ("(table)", "null_rows"): 0.0, ("(table)", "duplicate_rows"): 0.0
    }
    assert st.correlation(states).collect() == []


def test_a_value_in_a_third_of_the_rows(spark):
    frame = spark.range(9000).select(
        F.concat(F.lit("f"), F.col("id") % 5).alias("file"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"),
    )
    states = st.file_states(frame, "file")
    assert states.values.where("value = 5.0").count() == 5
    close(st.merged_profile(states, "t").collect(), prof.profile(frame.drop("file"), "t").collect())
