import hashlib
import random

import numpy as np
import pytest

from stellarate.llm import simhash
from stellarate.llm.cluster import Scratch
from stellarate.llm.components import components
from tests.llm import common


def found(spark, rows):
    with Scratch(spark) as scratch:
        got = simhash.near_copies(common.docs_of(spark, rows), scratch)
        return got.select("doc_id", simhash.hexed().alias("f"), "component_id").collect()


def test_awkward_rows(spark):
    rows = common.awkward()
    common.same(found(spark, rows), common.near_copies(rows))


def test_no_rows(spark):
    assert found(spark, []) == []


def test_copies_in_a_chain(spark):
    words = common.prose(5, 300).split()
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        words[(7 * i) % 300] = f"w{i}"
    common.same(found(spark, rows), common.near_copies(rows))


def linked(fps, label):
    return sorted(common.grouped((fps[l], int(f)) for l, f in zip(label, fps)).values())


@pytest.mark.parametrize("at_once", [1 << 21, 5_000])
def test_links_equal_all_pairs(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(6):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(centre)
    fps = np.array(sorted(fps), np.uint64)
    label = simhash.link_bucket(fps, np.full(len(fps), 2, np.int8), 0, 4)
    sets = common.Sets()
    for a in fps.tolist():
        for b in fps.tolist():
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    assert linked(fps, label) == sorted(common.grouped((sets.find(f), f) for f in fps.tolist()).values())


def test_crowded_buckets_are_split(spark, monkeypatch):
    """Fingerprints with equal leading bits go on by further bits, with the same components."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20)
    rng = random.Random(4)
    fps = {rng.getrandbits(30) for _ in range(150)}
    fps |= {f ^ 1 << rng.randrange(30) ^ 1 << rng.randrange(64) for f in list(fps)[:60]}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    with Scratch(spark) as scratch:
        edges = simhash.links(frame, len(fps), scratch)
        got = components(edges, scratch).collect()
    sets = common.Sets()
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    own = common.grouped((r.root, r.node % (1 << 64)) for r in got)
    expected = common.grouped((sets.find(f), f) for f in list(sets.up))
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, expected.values()))


def test_majority_of_bits():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 700, 0, 1, 1297])
    hashes = rng.integers(0, 2**64, counts.sum(), np.uint64)
    ends = np.cumsum(counts)
    for n, end, got in zip(counts, ends, simhash.majority(hashes, counts)):
        own = [int(h) for h in hashes[end - n : end]]
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def one_of_each(rows):
    """(doc_id, text) of the row of each component with the smallest id, null last, and digest."""
    sets = common.Sets()
    prints = [common.fingerprint(t) for _, t in rows]
    for a in set(prints):
        for b in set(prints):
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    best: dict = {}
    for (d, t), p in zip(rows, prints):
        key = (d is None, d or 0, hashlib.md5((t or "").encode()).digest())
        root = sets.find(p)
        if root not in best or key < best[root][0]:
            best[root] = (key, (d, t))
    return [row for _, row in best.values()]


def chosen(spark, rows):
    with Scratch(spark) as scratch:
        docs = common.docs_of(spark, rows)
        got = simhash.one_of_each(docs, scratch)
        assert got.columns == docs.columns
        return [(r.doc_id, r.text or "") for r in got.collect()]


def test_one_of_each_awkward_rows(spark):
    rows = common.awkward()
    common.same(chosen(spark, rows), [(d, t or "") for d, t in one_of_each(rows)])


def test_texts_that_share_an_id_are_told_apart(spark):
    """No text goes of which no near copy stays, and no copy stays beside another."""
    a, b, c, d = (common.prose(i, 50) for i in range(4))
    rows = [(5, a), (5, b), (6, a), (7, c), (None, d), (None, d), (None, b), (None, None), (9, None)]
    expected = [(5, a), (5, b), (7, c), (None, d), (9, "")]
    common.same(chosen(spark, rows), expected)
    common.same(chosen(spark, rows * 40), expected)


def test_one_of_each_of_nothing(spark):
    assert chosen(spark, []) == []


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(50)]
    edges += [(None, 3), (4, None), (9, 9)]
    sets = common.Sets()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.join(a, b)
    with Scratch(spark) as scratch:
        got = components(spark.createDataFrame(edges, "p long, q long"), scratch).collect()
    common.same(got, [(n, sets.find(n)) for n in list(sets.up)])


def test_components_of_nothing(spark):
    with Scratch(spark) as scratch:
        assert components(spark.createDataFrame([], "p string, q string"), scratch).collect() == []
