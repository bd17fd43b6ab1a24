import math
import random

import pytest
from pyspark.sql import functions as F

from stellarate.operators import evaluation as ev
from stellarate.operators import sketches as sk


def numbers(spark, count=20_000):
    rng = random.Random(3)
    rows = [
        (i % 4, None if i % 11 == 0 else rng.gauss(0, 10), 7 if i % 3 == 0 else rng.randrange(1000), "x")
        for i in range(count)
    ]
    rows += [(4, None, None, "x"), (5, math.nan, 3, "x"), (None, 1.0, 4, "x")]
    return spark.createDataFrame(rows, "part int, `x.y` double, n long, sketch string").repartition(5)


def test_quantiles_of_parts_and_merged_are_within_the_bound(spark, tmp_path):
    frame = numbers(spark).withColumnRenamed("x.y", "x")
    kept = sk.quantile_sketches(frame, ["x", "n"], ["part"])
    kept.write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    whole = sk.merged_sketches(kept)
    shares = {"1%": 0.01, "50%": 0.5, "99%": 0.99}
    bound = sk.rank_error()
    parts = sk.rank_errors(sk.sketch_quantiles(kept, ["part"], shares), frame.where("part < 4"), ["part"], shares)
    total = sk.rank_errors(sk.sketch_quantiles(whole, [], shares), frame, [], shares)
    assert parts.count() == 4 * 2 * 3 and total.count() == 6
    assert parts.agg(F.max("error")).first()[0] <= bound and total.agg(F.max("error")).first()[0] <= bound


def test_counts_and_extremes(spark):
    kept = sk.quantile_sketches(numbers(spark, 100), ["x.y", "n"], ["part"])
    found = {(r.part, r.column): (r.n, r.lo, r.hi) for r in kept.collect()}
    assert (4, "x.y") not in found and (5, "x.y") not in found
    assert found[5, "n"] == (1, 3.0, 3.0) and found[None, "n"] == (1, 4.0, 4.0)
    whole = {r.column: r.n for r in sk.merged_sketches(kept).collect()}
    assert whole["n"] == 102


def test_rank_of_a_value(spark):
    kept = sk.quantile_sketches(numbers(spark), ["n"])
    rank = kept.select(sk.sketch_rank("sketch", F.lit(500.0))).first()[0]
    exact = numbers(spark).where("n is not null").agg(F.avg((F.col("n") <= 500).cast("int"))).first()[0]
    assert rank == pytest.approx(exact, abs=sk.rank_error())


def test_larger_sketches_are_finer():
    assert sk.rank_error(1600) < sk.rank_error(800) < sk.rank_error(200) < 0.014


def test_no_rows(spark):
    kept = sk.quantile_sketches(numbers(spark, 0).where("part = 9"), ["n"], ["part"])
    assert kept.collect() == [] and sk.merged_sketches(kept).collect() == []


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label double, bin string, lo int, pos int")


def curve_cases():
    rng = random.Random(5)
    third = [(0.5, float(rng.random() < 0.6), "b", 1, 1) for _ in range(900)]
    rest = [(rng.random(), 0.0, "b", 1, 1) for _ in range(900)]
    rest += [(min(1.0, rng.random() + 0.2), 1.0, "b", 1, 1) for _ in range(900)]
    return third + rest + [(None, 1.0, "b", 1, 1), (0.3, None, "b", 1, 1), (math.nan, 1.0, "b", 1, 1)]


@pytest.mark.parametrize("points", [2, 3, 10, 200, 5000])
def test_bounded_curve_holds_the_exact_area(spark, points):
    """Also where a third of the rows have one score, and with more points than scores."""
    frame = scored(spark, curve_cases()).repartition(4)
    clean = frame.where("not isnan(score)")
    curve = ev.bounded_curve(frame, "score", points)
    area = ev.curve_area(curve).first()
    exact = ev.area_under_roc(clean, "score").first().auc
    assert area.points <= points
    assert abs(area.auc - exact) <= area.slack + 1e-12
    if points == 5000:
        assert area.slack < 0.002 and area.auc == pytest.approx(exact, abs=0.002)


def test_points_lie_on_the_exact_curve(spark):
    clean = [r for r in curve_cases() if r[0] is not None and not math.isnan(r[0]) and r[1] is not None]
    frame = scored(spark, clean)
    exact = {(round(r.threshold, 12), round(r.fpr, 12), round(r.tpr, 12))
             for r in ev.roc_points(frame, "score").collect() if r.threshold is not None}
    found = [r for r in ev.bounded_curve(frame, "score", 20).collect() if r.threshold is not None]
    assert 10 < len(found) < 20
    assert {(round(r.threshold, 12), round(r.fpr, 12), round(r.tpr, 12)) for r in found} <= exact
    assert max(found, key=lambda r: r.fpr).tpr == 1.0


def test_weights_count_as_rows(spark):
    rows = [(0.1, 0.0, 3), (0.4, 1.0, 5), (0.4, 0.0, 2), (0.8, 1.0, 1)]
    weighed = spark.createDataFrame(rows, "score double, label double, w long")
    plain = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "score double, label double")
    a = ev.curve_area(ev.bounded_curve(weighed, "score", 50, weight="w")).first()
    b = ev.curve_area(ev.bounded_curve(plain, "score", 50)).first()
    assert a.auc == pytest.approx(b.auc) and a.slack == b.slack == 0.0


def test_one_class_and_no_rows(spark):
    one = scored(spark, [(0.5, 1.0, "b", 1, 1), (0.6, 1.0, "b", 1, 1)])
    assert [r.fpr for r in ev.bounded_curve(one, "score", 5).collect()][1:] in ([None, None], [None])
    none = ev.bounded_curve(one.where("score > 1"), "score", 5).collect()
    assert [(r.fpr, r.tpr) for r in none] == [(0.0, 0.0)]
    with pytest.raises(ValueError):
        ev.bounded_curve(one, "score", 1)
