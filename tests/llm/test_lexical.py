import math
import random
import re

import numpy as np
import pytest

from stellarate.llm import lexical
from stellarate.llm.cluster import Scratch
from tests.llm import common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    text = text or ""
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, best=50):
    rows = [(d, terms(t)) for d, t in docs]
    rows = [(d, w) for d, w in rows if w]
    N, L = len(rows), sum(len(w) for _, w in rows)
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked = set(terms(text))
        scores = []
        for d, w in rows:
            m = 50 + 50 * len(w) * N // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m))
                for t in asked & set(w)
            )
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scores, key=lambda s: s[:3])[:best], 1):
            out.append((item, rank, d, -score))
    return out


def searched(spark, docs, items):
    frame = common.docs_of(spark, docs)
    asked = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, terms string"
    )
    with Scratch(spark) as scratch:
        return lexical.search(frame, asked, scratch).select("item_id", "rank", "doc_id", "score").collect()


def cases(count=400):
    rng = random.Random(1)
    words = [common.prose(i, 1) + str(i % 50) for i in range(300)]
    def text(n):
        return " ".join(words[int(rng.paretovariate(0.6)) % 300].upper() if rng.random() < 0.2 else
                        words[int(rng.paretovariate(0.6)) % 300] for _ in range(n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(count)]
    items = [(i, text(rng.randint(1, 60))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "no-such@word"), (3, items[3][1]), (None, items[4][1])]
    docs += [(1000 + i, items[i][1] + ", and\nmore") for i in range(12)]
    return docs, items


@pytest.mark.parametrize("first, bucket, block", [(1 << 14, 2048, 1 << 20), (20, 16, 60)])
def test_against_all_scores(spark, monkeypatch, first, bucket, block):
    """With small bounds: several rounds, buckets and blocks of items."""
    monkeypatch.setattr(lexical, "FIRST_ROWS", first)
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = cases()
    common.same(searched(spark, docs, items), brute(docs, items))


def test_awkward_rows(spark):
    docs = common.awkward() + [(20, "Ünï-cödé ÉCOLE école"), (21, "a_b[c]d`e{f"), (22, "\x7f\x00")]
    items = [(1, common.prose(1, 20)), (2, "ÉCOLE a b c"), (3, "one"), (4, "e f")]
    common.same(searched(spark, docs, items), brute(docs, items))


def test_ties_go_to_the_smaller_id_and_copies_are_all_ranked(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_ROWS", 16)
    docs = [(i % 70, "alpha beta") for i in range(140)] + [(None, "alpha beta")] + [
        (500 + i, f"word{i} gamma") for i in range(150)
    ]
    items = [(1, "beta Alpha"), (2, "gamma word7")]
    common.same(searched(spark, docs, items), brute(docs, items))


def test_no_rows(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None), (2, "--")], [(1, "a")]) == []


def test_candidates_hold_every_score_that_counts():
    rng = np.random.default_rng(2)
    weights = rng.integers(0, 9000, 40)
    for _ in range(50):
        sizes = rng.integers(1, 12, 60)
        terms = np.concatenate([np.sort(rng.choice(40, s, replace=False)) for s in sizes]).astype(np.int32)
        own = rng.integers(1, 1_000_000, len(terms))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        norm = np.sqrt(np.add.reduceat(weights[terms] * own.astype(float) ** 2, offsets[:-1]))
        bucket = lexical.Bucket(terms, own, offsets, norm)
        asked = np.sort(rng.choice(40, rng.integers(1, 15), replace=False)).astype(np.int32)
        dense = np.zeros(40, np.int64)
        dense[asked] = weights[asked]
        scores = np.add.reduceat(dense[terms] * own, offsets[:-1])
        for least in (1, int(np.quantile(scores, 0.5)) + 1, int(scores.max())):
            some = bucket.candidates(asked, weights, least)
            assert set(np.flatnonzero(scores >= least)) <= set(some.tolist())
            assert (bucket.scores(some, dense) == scores[some]).all()
