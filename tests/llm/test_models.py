import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stellarate.llm import quality_model, toxicity
from stellarate.llm.cluster import Scratch
from tests.llm import common

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def tables(spark, sf=SMALL):
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")]


def auc(score: np.ndarray, label: np.ndarray) -> float:
    rank = np.argsort(np.argsort(score)) + 1
    ones = (label == 1).sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize(
    "module, label, mod, out, sf, least",
    [(quality_model, "quality", 5, 0, SMALL, 0.99), (toxicity, "toxic", 3, 1, LARGE, 0.98)],
)
def test_held_out_documents(spark, module, label, mod, out, sf, least):
    docs, labels = tables(spark, sf)
    with Scratch(spark) as scratch:
        got = module.scores(docs, labels, scratch).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.predicted == (got.score >= module.THRESHOLD)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % mod == out for d in got.doc_id]).all()
    known = duckdb.sql(f"SELECT doc_id, {label} AS y FROM '{sf}/labels.parquet'").df()
    held = got[got.held_out].merge(known, on="doc_id")
    assert auc(held.score.to_numpy(), held.y.to_numpy()) > 0.98
    assert (held.predicted == held.y).mean() > least


@pytest.mark.parametrize("module, column", [(quality_model, "quality"), (toxicity, "toxic")])
def test_awkward_rows_and_labels(spark, module, column):
    rows = common.awkward()
    docs = common.docs_of(spark, rows)
    schema = f"doc_id long, {column} int, note string"
    for labelled in (
        [], [(4, 1, "")], [(4, 0, ""), (5, 1, ""), (5, 1, ""), (None, 1, ""), (6, None, ""), (7, 5, "")],
    ):
        labels = spark.createDataFrame(labelled, schema)
        with Scratch(spark) as scratch:
            got = module.scores(docs, labels, scratch).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        if not labelled:
            assert {r.score for r in got} == {0.5}
    with Scratch(spark) as scratch:
        assert module.scores(common.docs_of(spark, []), labels, scratch).collect() == []


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    d = len(quality_model.NAMES)
    x = {0: rng.normal(0, 1, (50, d)), 1: rng.normal(0.5, 0.7, (200, d))}
    sums = {}
    for k, own in x.items():
        one = np.column_stack([np.ones(len(own)), own])
        sums[k] = one.T @ one
    model = quality_model.Discriminant(sums)
    pooled = sum(np.cov(own.T) * (len(own) - 1) for own in x.values()) / 248
    log = {}
    for k, own in x.items():
        weight = max(quality_model.POOLED, d / (len(own) + d))
        cov = (1 - weight) * np.cov(own.T) + weight * pooled
        cov = (1 - quality_model.DIAGONAL) * cov + quality_model.DIAGONAL * np.diag(np.diag(cov))
        cov += quality_model.FLOOR * np.eye(d)
        diff = x[1] - own.mean(0)
        log[k] = (
            np.log(len(own) / 250)
            - 0.5 * np.linalg.slogdet(cov)[1]
            - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
        )
    assert np.allclose(model.score(x[1]), 1 / (1 + np.exp(log[0] - log[1])))


def test_accepted_keeps_columns(spark):
    docs, labels = tables(spark)
    got = quality_model.accepted(docs, labels)
    assert got.columns == docs.columns
    with Scratch(spark) as scratch:
        good = quality_model.scores(docs, labels, scratch).where("predicted = 1")
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(
            r.doc_id for r in good.collect()
        )


def test_features_present(monkeypatch):
    texts = ["Abc abd\nabc", None, "", "é" * 30, common.prose(1, 400), "xy"]
    every = toxicity.present(pa.array(texts, pa.string()), None)
    monkeypatch.setattr(toxicity, "SECTION", 50)
    small = toxicity.present(pa.array(texts, pa.string()), None)
    assert all(np.array_equal(a, b) for a, b in zip(every, small))
    for row, text in enumerate(texts):
        whole = f" {(text or '').lower()} ".replace("\n", " ")
        own = set()
        for n in toxicity.ORDERS:
            for i in range(len(whole) - n + 1):
                points = np.array([ord(c) for c in whole[i : i + n]], np.uint64)
                own.update(
                    int(f) for o, f in zip(toxicity.ORDERS, [toxicity.gram_features(points)[-1][0]])
                )
        assert own == set(every[1][every[0] == row].tolist())
