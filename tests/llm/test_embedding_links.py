import math

import numpy as np
import pytest

from stellarate.llm import embedding_links as links
from stellarate.llm import vector_graph
from stellarate.llm.cluster import Scratch
from tests.llm import common

SMALL = links.Options(shard_rows=40, part_rows=30, cells=8)


def linked(spark, rows, options=links.Options(), kind="float"):
    frame = spark.createDataFrame(
        [(*r, "g", 1, b"c") for r in rows],
        f"vec_id long, embedding array<{kind}>, label int, grp string, node int, code binary",
    ).repartition(3)
    with Scratch(spark) as scratch:
        return links.linked(frame, scratch, options).collect()


def brute(rows, single=True):
    good = []
    for v in (r[1] for r in rows):
        own = None
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32 if single else np.float64).astype(np.float64)
            x /= np.abs(x).max()
            own = x / np.sqrt((x * x).sum())
        good.append(own)
    sets, count = common.Sets(), [0] * len(rows)
    for i, (_, _, label) in enumerate(rows):
        sets.find(i)
        for j in range(i):
            a, b = good[i], good[j]
            if label is None or rows[j][2] != label or a is None or b is None or len(a) != len(b):
                continue
            if a @ b >= links.COSINE:
                sets.join(i, j)
                count[i] += 1
                count[j] += 1
    low = {}
    for i, (id_, _, _) in enumerate(rows):
        if id_ is not None:
            low[sets.find(i)] = min(id_, low.get(sets.find(i), id_))
    return [
        (r[0], count[i], low.get(sets.find(i)), r[0] == low.get(sets.find(i))) for i, r in enumerate(rows)
    ]


def near(rng, base, spread, times):
    return [(base + rng.standard_normal(len(base)) * spread).tolist() for _ in range(times)]


def cases():
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        for i in range(60):
            for v in near(rng, rng.standard_normal(24), rng.choice([0.03, 0.15, 0.26]), rng.integers(1, 6)):
                rows.append((1000 * label + len(rows), v, label))
    return rows, rng


@pytest.mark.parametrize("options", [links.Options(), SMALL])
def test_against_all_pairs(spark, options):
    rows, rng = cases()
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    common.same(linked(spark, shuffled, options), brute(shuffled))


def test_awkward_vectors(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [math.nan, 1.0], 1),
        (6, [math.inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1),
        (10, [2.0, 0.1], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.05], 1),
        (None, [-1.0, 0.0], 1), (None, None, None), (9, [1.0, 0.0], 1), (9, [0.0, -1.0], 1),
        (13, [1.0], 1), (14, [-1.0], 1), (15, [5.0], 1),
    ]
    found = linked(spark, rows)
    expected = [(i, n, c, i == c) for i, n, c, _ in brute(rows)]
    common.same(found, expected)


def test_components_of_extreme_size(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e-200, 1e-201], 1), (3, [1e-300, 1e-290], 1), (4, [1e308, 1e308], 1)]
    common.same(linked(spark, rows, kind="double"), brute(rows, single=False))


def test_no_rows(spark):
    assert linked(spark, []) == []


def test_a_third_copies_and_a_third_near_copies(spark):
    """Copies are one node; near copies are a crowd that several tasks share."""
    rng = np.random.default_rng(4)
    copy, centre = rng.standard_normal(24), rng.standard_normal(24)
    rows = [(i, copy.tolist(), 1) for i in range(200)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(near(rng, centre, 0.1, 200))]
    rows += [(2000 + i, v, 1) for i, v in enumerate(near(rng, centre, 0.28, 40))]
    rows += [(3000 + i, rng.standard_normal(24).tolist(), 1) for i in range(160)]
    common.same(linked(spark, rows, SMALL), brute(rows))


def test_neighbouring_crowds(spark):
    """Crowds whose centres are within the range of each other: pairs across count once."""
    rng = np.random.default_rng(7)
    one, two = rng.standard_normal(24), rng.standard_normal(24)
    one, two = one / np.linalg.norm(one), two / np.linalg.norm(two)
    rows = []
    for turn in (0.0, 0.2, 0.27, 0.4):
        rows += [(len(rows) + i, v, 1) for i, v in enumerate(near(rng, one + turn * two, 0.015, 120))]
    rows += [(9000 + i, rng.standard_normal(24).tolist(), 1) for i in range(100)]
    common.same(linked(spark, rows, SMALL), brute(rows))


def test_crowd_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, 1) for i, v in enumerate(near(rng, rng.standard_normal(24), 0.05, 300))]
    common.same(linked(spark, rows, SMALL), brute(rows))


def test_low_recall_is_not_passed_over(spark, monkeypatch):
    monkeypatch.setattr(links, "recall", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall 0.500"):
        linked(spark, [(1, [1.0, 0.0], 1)], links.Options(tries=2))


def test_recall_counts_what_is_missing(spark):
    rows = [(i, 5, 7, np.array([1, 0.01 * i], np.float32).tobytes()) for i in range(4)]
    nodes = spark.createDataFrame([("2:1", r[0], 1, r[3]) for r in rows], "grp string, node long, n long, code binary")
    counts = spark.createDataFrame([(i, 3 if i else 0) for i in range(4)], "node long, links long")
    assert links.recall(nodes, counts, "<f4", links.Options()) == 0.75


def pairs_of(vectors, least):
    like = vectors @ vectors.T >= least
    return set(zip(*np.nonzero(like)))


def test_range_search_from_medoids():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((100, 32))
    parts = [base + rng.standard_normal(base.shape) * s for s in (0.0, 0.05, 0.2, 0.3)]
    vectors = links.units(np.concatenate([*parts, base[:1] + rng.standard_normal((200, 32)) * 0.05]))
    graph = vector_graph.build(vectors)
    assert (graph.neighbours >= -1).all() and graph.neighbours.shape[1] == vector_graph.DEGREE
    graph = vector_graph.searchable(vectors, *graph.outgoing())
    found = set(zip(*graph.within(vectors, 0.93)))
    true = pairs_of(vectors, 0.93)
    assert found <= true
    assert len(found) > 0.98 * len(true) > 10_000


def test_prune_keeps_the_closest_and_drops_what_it_covers():
    angles = np.radians([0, 10, 12, 14, 80, 200])
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    kept = vector_graph.robust_prune(vectors, np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 0]]), 3)
    assert kept.tolist() == [[1, 5, -1]] or kept[0, 0] == 1 and 2 not in kept and 3 not in kept
