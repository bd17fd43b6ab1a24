import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.operators.encoding import apply_categories, apply_scale, fit_categories, fit_scale, min_max
from stellarate.operators.joins import join_dimension
from stellarate.sources import bucketed, variants

KNOWN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("nested", T.StructType([T.StructField("ignored", T.LongType())])),
    ]
)
GOOD = [
    '{"id":1,"name":"a","score":2,"extra":{"Deep":{"x":1.5}},"tags":["t"]}',
    '{"id":2,"score":1.25,"extra":{"Deep":{"x":2}},"open":true}',
    ' {"id":3,"name":5,"nested":{"k":"v"},"mixed":1} ',
    '{"id":4,"mixed":"text","big":12345678901234567890}',
    '{"id":null,"name":null}',
    "{}",
    '{"id":7,"a.b":1,"it\'s \\"x\\"":2}',
    '{"id":8,"list":[{"p":1,"P":2}]}',
]
BAD = [
    '{"id":9} trailing',
    '{"id":10}{"id":11}',
    '{"id":12},{"id":13}',
    '{"id":14,"id":15}',
    '{"id":16,"ID":17}',
    '{"Name":"capital"}',
    '{"id":18,"extra":{"DEEP":1}}',
    '{"id":1.5}',
    '{"id":"19"}',
    '{"score":"high"}',
    '{"open":"true"}',
    '{"id":99999999999999999999}',
    '{"id":20',
    "[1]",
    "3",
    '"text"',
    "null",
]


def landed(spark, tmp_path, lines, known=KNOWN):
    (tmp_path / "t.json").write_text("\n".join([*lines, "", "   "]), encoding="utf-8")
    return variants.variant_lines(spark, str(tmp_path / "t.json"), known, str(tmp_path / "parsed"))


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    lines = [x for pair in zip(GOOD * 3, BAD * 2) for x in pair] + BAD
    rows, rejects = landed(spark, tmp_path, lines)
    used = [x for x in lines if x in BAD]
    assert sorted(r.line for r in rejects.collect()) == sorted(used)
    assert rows.count() == len(lines) - len(used)


def test_values_and_types(spark, tmp_path):
    rows, rejects = landed(spark, tmp_path, GOOD)
    assert rejects.count() == 0
    assert rows.columns[:5] == ["id", "name", "score", "open", "nested"]
    kinds = dict(rows.dtypes)
    assert kinds["extra"] == "struct<Deep:struct<x:double>>" and kinds["tags"] == "array<string>"
    assert kinds["mixed"] == "string" and kinds["big"] == "decimal(38,0)" and kinds["nested"] == "struct<k:string>"
    assert kinds["list"] == "array<string>"
    by_id = {r.id: r for r in rows.collect()}
    assert by_id[1].score == 2.0 and by_id[1].extra.Deep.x == 1.5 and by_id[2].open is True
    assert by_id[3].name == "5" and by_id[3].mixed == "1" and by_id[4].mixed == "text"
    assert by_id[4].big == 12345678901234567890 and by_id[7]["a.b"] == 1
    assert by_id[7]['it\'s "x"'] == 2
    assert [r.name for r in rows.collect() if r.id is None] == [None, None]


def test_spelling_of_a_column(spark, tmp_path):
    """The known spelling wins; of unknown ones that with most small letters."""
    rows, rejects = landed(spark, tmp_path, ['{"id":1,"City":"a"}', '{"city":"b"}', '{"CITY":"c"}', '{"Id":2}'])
    assert "city" in rows.columns and "id" in rows.columns
    assert [r.city for r in rows.collect()] == ["b"] and rejects.count() == 3


def test_no_lines_and_no_good_line(spark, tmp_path):
    rows, rejects = landed(spark, tmp_path, [])
    assert rows.columns == [f.name for f in KNOWN.fields] and rows.count() == rejects.count() == 0
    (tmp_path / "again").mkdir()
    rows, rejects = landed(spark, tmp_path / "again", ["nonsense", "[{}]"])
    assert rows.count() == 0 and rejects.count() == 2


def test_types_as_variants_describe_them(spark):
    assert variants.type_of("OBJECT<VOID: BIGINT, `OBJECT<`: VOID>").simpleString() == (
        "struct<VOID:bigint,OBJECT<:string>"
    )
    assert variants.type_of("ARRAY<DECIMAL(5,2)>").simpleString() == "array<double>"
    assert variants.type_of("DECIMAL(25,0)").simpleString() == "decimal(38,0)"


# ---- bucketed tables ----


def facts(spark):
    """A third of the rows have key 0, some none, and key 999 has no dimension row."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, 999).when(F.col("id") % 50 != 2, F.col("id") % 700)
    return spark.range(6000).select(key.cast("long").alias("key"), "id")


@pytest.mark.parametrize("rows_per_part", [500, 1_000_000])
def test_bucketed_join_is_the_plain_join_without_a_shuffle(spark, tmp_path, rows_per_part):
    dimension = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    left = bucketed.write_bucketed(facts(spark), str(tmp_path / "f"), "key", 8, rows_per_part)
    right = bucketed.write_bucketed(dimension, str(tmp_path / "d"), "key", 8)
    joined = bucketed.bucketed_join(spark, left, right)
    expected = facts(spark).join(dimension, "key")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, expected.select("key", "id", "twice").collect()))
    even = left.even(spark).hint("merge").join(right.even(spark), "key")
    plan = even._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    held = left.even(spark).groupBy("key").count().agg(F.max("count")).first()[0]
    assert held < 500 if rows_per_part == 500 else held >= 2000
    assert left.rows(spark).count() == 6000
    left.forget(spark), right.forget(spark)


def test_bucketed_table_of_an_earlier_session(spark, tmp_path):
    wrote = bucketed.write_bucketed(facts(spark), str(tmp_path / "f"), "key", 4)
    wrote.forget(spark)
    again = bucketed.open_bucketed(spark, str(tmp_path / "f"), "key", 4)
    assert sorted(map(tuple, again.rows(spark).fillna(-1).collect())) == sorted(
        map(tuple, facts(spark).fillna(-1).collect())
    )
    plan = again.even(spark).groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again.forget(spark)


def test_empty_bucketed_tables_and_bad_names(spark, tmp_path):
    none = bucketed.write_bucketed(facts(spark).where("id < 0"), str(tmp_path / "f"), "key", 2)
    assert bucketed.bucketed_join(spark, none, none).count() == 0
    with pytest.raises(ValueError):
        bucketed.write_bucketed(facts(spark).withColumnRenamed("key", "a.b"), str(tmp_path / "g"), "a.b", 2)


def test_bucket_count():
    assert [bucketed.bucket_count(n, 100) for n in (0, 1, 100, 101, 300, 1600)] == [1, 1, 1, 2, 4, 16]


# ---- stored categories and scales ----


def test_unseen_categories(spark):
    learn = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "`c.x` string")
    fitted = fit_categories(learn, "c.x")
    assert {r["value"]: r["index"] for r in fitted.collect()} == {"b": 0.0, "a": 1.0, "c": 2.0}
    rows = spark.createDataFrame([("a", 1), ("new", 2), (None, 3), ("b", 4)], "`c.x` string, n int")

    def found(mode):
        out = apply_categories(rows, fitted, "c.x", "i.x", mode)
        return {r.n: r["i.x"] for r in out.collect()}

    assert found("skip") == {1: 1.0, 4: 0.0}
    assert found("keep") == {1: 1.0, 2: 3.0, 3: 3.0, 4: 0.0}
    with pytest.raises(Exception, match="c.x has a category without index"):
        found("error")
    good = apply_categories(rows.where("n in (1, 4)"), fitted, "c.x", "i", "error")
    assert {r.n: r.i for r in good.collect()} == {1: 1.0, 4: 0.0}
    with pytest.raises(ValueError):
        apply_categories(rows, fitted, "c.x", "i", "other")


def test_nothing_to_learn_from(spark):
    none = fit_categories(spark.createDataFrame([(None,)], "c string"), "c")
    rows = spark.createDataFrame([("a",), (None,)], "c string")
    assert apply_categories(rows, none, "c", "i", "skip").count() == 0
    assert [r.i for r in apply_categories(rows, none, "c", "i", "keep").collect()] == [0.0, 0.0]


def test_stored_scales(spark):
    learn = spark.createDataFrame([(1.0, 5, None), (3.0, 5, None), (float("nan"), None, None)], "`x.y` double, n int, e int")
    fitted = fit_scale(learn, ["x.y", "n", "e"])
    rows = spark.createDataFrame([(2.0, 5, 1), (9.0, 7, 2), (None, None, None)], "`x.y` double, n int, e int")
    out = apply_scale(rows, fitted, {"x.y": "a", "n": "b", "e": "c"}).select("a", "b", "c").collect()
    assert [tuple(r) for r in out] == [(0.5, 0.5, None), (4.0, 0.5, None), (None, None, None)]
    clipped = apply_scale(rows, fitted, {"x.y": "a"}, clip=True).select("a").collect()
    assert [r.a for r in clipped] == [0.5, 1.0, None]
    assert [r.z for r in min_max(rows, "x.y", "z").collect()] == [0.0, 1.0, None]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_left_join_keeps_rows_without_a_match(spark, limit):
    dimension = spark.range(1, 900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    for name in ("key", "a.key"):
        left, right = (df.withColumnRenamed("key", name) for df in (facts(spark), dimension))
        joined = join_dimension(left, right, name, ["id"], limit, rows_per_part=300, how="left")
        got = sorted((r.id, r.twice or 0) for r in joined.collect())
        expected = facts(spark).join(dimension, "key", "left").collect()
        assert got == sorted((r.id, r.twice or 0) for r in expected)
