"""Near copies by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from stellarate.llm import jaccard
from stellarate.llm.cluster import Scratch
from tests.llm import common

#: Added to fingerprints, so that they are no row numbers.
BEYOND = 1 << 65


def edited(text: str, changes: int, seed: int) -> str:
    words, rng = text.split(), random.Random(seed)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{seed}{at}"
    return " ".join(words)


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows() -> list[tuple]:
    rows = [(None, common.prose(1, 200)), (1, None), (2, ""), (3, "a b"), (4, "A  b")]
    for i in range(40):
        text = common.prose(100 + i, 160)
        rows.append((100 * (i + 1), text))
        rows += [(100 * (i + 1) + k, edited(text, k, k)) for k in (1, 2, 3, 4, 6, 9)]
    return rows


def groups(rows: list[tuple]) -> dict:
    """Smallest index of each row's component over Jaccard >= 0.8 and the SimHash."""
    sets = common.Sets()
    own = [shingles(t or "") for _, t in rows]
    for i, a in enumerate(own):
        for j in range(i):
            both = len(a & own[j])
            if both and both >= 0.8 * len(a | own[j]):
                sets.join(i, j)
    return sets


def test_stage_keeps_one_of_each_shingle_group(spark, tmp_path):
    rows = [r for r in near_rows() if r[0] is not None and r[0] > 2]
    got = corpus_pipeline.drop_near_copies(spark, common.docs_of(spark, rows), str(tmp_path))
    kept = {r.doc_id for r in got.collect()}
    simhash = {d: c for (d, _), (_, _, c) in zip(rows, common.near_copies(rows))}
    sets = groups(rows)
    place = {d: i for i, (d, _) in enumerate(rows)}
    for d, c in simhash.items():
        sets.join(place[d], place[c])
    least = {}
    for d, _ in rows:
        root = sets.find(place[d])
        least[root] = min(d, least.get(root, d))
    assert kept == set(least.values())
    # fingerprints alone do not reach these
    assert len(kept) < len({c for c in simhash.values()})


@pytest.mark.parametrize("key_rows", [20_000, 2])
def test_links_connect_what_all_pairs_connect(spark, key_rows):
    rows = [(i, t) for i, (_, t) in enumerate(near_rows())]
    fp = {r: p for r, p, _ in common.near_copies(rows)}
    with Scratch(spark) as scratch:
        got = jaccard.links(common.docs_of(spark, rows), scratch, key_rows).collect()
    mine, theirs = common.Sets(), groups(rows)
    for r in got:
        mine.join(r.a + BEYOND, r.b + BEYOND)
    for i, _ in rows:
        mine.join(i, np.uint64(int(fp[i], 16)).view(np.int64).item() + BEYOND)
    by_fp = {}
    for i, _ in rows:
        theirs.join(by_fp.setdefault(fp[i], i), i)
    for i, _ in rows:
        for j in range(i):
            assert (mine.find(i) == mine.find(j)) == (theirs.find(i) == theirs.find(j))


def test_links_of_nothing(spark):
    with Scratch(spark) as scratch:
        assert jaccard.links(common.docs_of(spark, []), scratch).collect() == []


def test_links_of_awkward_rows(spark):
    """The texts that the links connect are those that similarities of 0.8 connect."""
    rows = common.awkward()
    with Scratch(spark) as scratch:
        got = jaccard.links(common.docs_of(spark, rows), scratch).collect()
    found, expected = common.Sets(), common.Sets()
    for a, b in got:
        found.join(a % (1 << 64), b % (1 << 64))
    sets = [(common.fingerprint(t), common.shingle_set(t)) for _, t in rows]
    for p, x in sets:
        found.find(p), expected.find(p)
        for q, y in sets:
            if p != q and x and y and 5 * len(x & y) >= 4 * len(x | y):
                expected.join(p, q)
    prints = {p for p, _ in sets}
    assert {p: found.find(p) for p in prints} == {p: expected.find(p) for p in prints}
