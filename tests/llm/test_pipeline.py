"""The corpus pipeline against brute-force versions of its stages."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from stellarate.llm import quality_model
from tests.llm import common


def rows_for_pipeline() -> tuple[list, list, list]:
    """Documents, labels and benchmark items: copies, shared passages, junk and leaks."""
    passage = common.prose(700, 55)
    docs, labels = [], []
    for i in range(90):
        text = f"{common.prose(i, 60)}. {common.prose(i + 1000, 30)}.\n{common.prose(i + 2000, 40)}."
        if i % 9 == 0:
            text += "\n" + passage
        if i % 10 == 3:
            text = " ".join(f"{w}%%%" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(i % 10 != 3), 0))
    docs += [(200, docs[4][1]), (201, docs[4][1] + " more"), (202, "short"), (203, None)]
    items = [(1, common.prose(900, 40)), (2, common.prose(901, 12))]
    docs += [(210, f"{common.prose(5000, 50)}. {items[0][1]} {common.prose(5001, 30)}.")]
    docs += [(211, f"{common.prose(5002, 50)}. {items[1][1].upper()}\n{common.prose(5003, 30)}.")]
    return docs, labels, items


def brute(docs: list, labels: list, items: list) -> dict:
    """Text by doc_id of what the last stage packs."""
    x = quality_model.statistics(pa.array([t for _, t in docs], pa.string()))
    of = {d: row for (d, _), row in zip(docs, x)}
    sums = {}
    for d, y, _ in labels:
        if zlib.crc32(str(d).encode()) % 5 and d in of:
            v = np.append(1, of[d])
            sums[y] = sums.get(y, 0) + np.outer(v, v)
    score = quality_model.Discriminant(sums).score(x)
    docs = [row for row, s in zip(docs, score) if s >= 0.3]
    docs = [row for row, (d, _, c) in zip(docs, common.near_copies(docs)) if d == c]
    docs = [(row[0], text) for row, text in common.repeats(docs)]
    leaked = {d for d, *_ in common.contained(docs, items)}
    return {d: t for d, t in docs if d not in leaked}


def test_pipeline(spark, tmp_path):
    docs, labels, items = rows_for_pipeline()
    common.docs_of(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute(docs, labels, items)
    assert 70 < len(expected) < 90 and 210 not in expected and 211 not in expected
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {
        d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in expected.items()
    }
    found = {}
    for row in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert row.start == len(found.get(row.doc_id, []))
        found.setdefault(row.doc_id, []).extend(np.frombuffer(row.ids, "<u4").tolist())
    assert found == ids


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for rows in ([], common.awkward()):
        docs = common.docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            after.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.count() >= len(rows)
