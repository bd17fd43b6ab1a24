import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stellarate.llm import suffixes
from stellarate.llm.cluster import Scratch
from tests.llm import common

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def found(spark, rows, keep=True):
    with Scratch(spark) as scratch:
        cut = suffixes.remove_repeats(common.docs_of(spark, rows), scratch, keep_text=keep)
        return cut.select(*COLUMNS, "kept").collect()


def passages(seed: int, docs: int) -> list[tuple]:
    """Documents that share cut-out passages with differing neighbours."""
    rng = random.Random(seed)
    pool = [common.prose(100 + i, rng.randint(15, 60)) for i in range(5)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(pool)
            a = rng.randrange(0, 30)
            parts.append(passage[a : len(passage) - rng.randrange(0, 30)])
            parts.append(common.prose(rng.random(), rng.randint(0, 20)))
        rows.append((rng.randrange(1000), rng.choice(["", " ", "é"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    rows = passages(seed, 40)
    expected = common.repeats(rows)
    common.same(found(spark, rows), [(*row, kept) for row, kept in expected])


def test_awkward_rows(spark):
    rows = [r for r in common.awkward() if len(r[1] or "") < 50_000]
    rows += [(20, "ab" * 300), (21, "x" + "ab" * 200), (22, "abc" * 120 + "ab" * 100)]
    common.same(found(spark, rows), [(*row, kept) for row, kept in common.repeats(rows)])


def test_no_rows(spark):
    assert found(spark, []) == []


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    """Anchors shuffled by whole windows."""
    rows = passages(3, 25)
    hashes = set()
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        for unit in suffixes.find_units(data, np.array([0, len(data)]), np.zeros(0, np.uint64)):
            hashes.update(unit[4].tolist())
    monkeypatch.setattr(suffixes, "crowded_anchors", lambda docs: sorted(hashes)[::2])
    common.same(found(spark, rows), [(*row, kept) for row, kept in common.repeats(rows)])


def test_sections_do_not_matter(monkeypatch):
    monkeypatch.setattr(suffixes, "SECTION", 4_000)
    text = common.prose(9, 4_000).encode()
    data = np.frombuffer(text, np.uint8)
    units = list(suffixes.find_units(data, np.array([0, len(data)]), np.zeros(0, np.uint64)))
    windows = sorted(
        (int(s), int(n)) for _, start, count, *_ in units for s, n in zip(start, count)
    )
    assert windows[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(windows, windows[1:]))
    assert sum(windows[-1]) == len(data) - suffixes.SPAN + 1


def test_equal_windows_have_equal_anchors():
    passage = common.prose(11, 80)
    places = []
    for before in ("", "some words before ", "é" * 70):
        data = np.frombuffer((before + passage).encode(), np.uint8)
        shift = len(before.encode())
        own = {}
        for _, start, count, rel, *_ in suffixes.find_units(
            data, np.array([0, len(data)]), np.zeros(0, np.uint64)
        ):
            for s, n, r in zip(start.tolist(), count.tolist(), rel.tolist()):
                own.update({i - shift: s + r - shift for i in range(s, s + n) if i >= shift})
        places.append(own)
    assert places[0] == places[1] == places[2]


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    right = rng.integers(97, 99, (200, suffixes.SPAN)).astype(np.uint8)
    right[50:80] = right[50]
    length = rng.integers(20, suffixes.SPAN + 1, 200)
    for row, n in enumerate(length):
        right[row, n:] = 0
    group = np.sort(rng.integers(0, 9, 200))
    order = suffixes.merge_sort(suffixes.Suffixes(right, length, suffixes.BASES[0]), group)
    keys = [(int(g), bytes(right[i, : length[i]])) for g, i in zip(group, order)]
    assert [group[i] for i in order] == group.tolist()
    assert keys == sorted(keys)


def test_colliding_base_is_replaced(monkeypatch):
    """A base of 0 makes all hashes collide; verification notices and takes the next."""
    rng = np.random.default_rng(6)
    n, reach = 12, suffixes.SPAN - suffixes.GRAM
    right = rng.integers(97, 99, (n, suffixes.SPAN)).astype(np.uint8)
    left = rng.integers(97, 99, (n, reach)).astype(np.uint8)
    right[6:], left[6:, :50] = right[:6], left[:6, :50]
    arguments = (
        np.zeros(n, np.int64), left, right, np.full(n, 81), np.full(n, 80), np.arange(n)
    )
    expected = suffixes.repeated_windows(*arguments)
    monkeypatch.setattr(suffixes, "BASES", (0, *suffixes.BASES))
    assert np.array_equal(suffixes.repeated_windows(*arguments), expected)
    assert expected.any()


def test_text_and_other_columns_stay(spark):
    rows = passages(4, 12)
    with Scratch(spark) as scratch:
        docs = common.docs_of(spark, rows)
        got = suffixes.without_repeats(docs, scratch)
        assert got.columns == docs.columns
        rows_ = got.select("doc_id", "text", "n_chars", "source").collect()
    common.same(
        rows_, [(row[0], kept, len(kept), "src0") for row, kept in common.repeats(rows)]
    )


def test_texts_of_one_id_are_told_apart_by_all_bits(spark):
    """Two texts under a null doc_id whose digests agree in 24 bits keep their own repeats."""
    seen: dict = {}
    passage, base = common.prose(1, 60), common.prose(2, 60)
    for n in range(100_000):
        text = f"{base} {n}" if n % 2 else f"{n} {passage} {base[:20]}"
        digest = hashlib.blake2b(text.encode(), digest_size=3).digest()
        if seen.setdefault(digest, text)[0].isdigit() != text[0].isdigit():
            break
    else:
        pytest.fail("no pair of texts")
    rows = [(None, seen[digest]), (None, text), (None, f"x{passage}"), (1, None)]
    common.same(found(spark, rows), [(*row, kept) for row, kept in common.repeats(rows)])


def test_rows_of_a_null_id_spread_over_tasks(spark):
    rows = [(None, common.prose(i, 40)) for i in range(200)]
    docs = common.docs_of(spark, [*rows, (1, rows[0][1])])
    keyed = docs.select(suffixes.doc_key(), "text")
    dealt = suffixes.versioned(keyed, suffixes.shared_ids(docs)).repartition(8, "doc", *suffixes.VERSION)
    assert [(r.high, r.low) for r in dealt.where("doc = 1").collect()] == [(0, 0)]
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 60


def candidates(sizes, seed=3):
    """Candidates of anchors 0, 1, ..., ``sizes`` of each, in batches; many windows are equal."""
    rng = random.Random(seed)
    rows = []
    for anchor, size in enumerate(sizes):
        core = bytes(rng.choice(b"abcd") for _ in range(180))
        for doc in range(size):
            own = bytearray(core)
            own[rng.choice([0, 5, 90, 179])] = rng.choice(b"xyz")
            rows.append((anchor, doc, rng.randrange(1000), (81 << 8) | 80, 0, 0, bytes(own)))
    names = ["anchor", "doc", "start", "shape", "high", "low", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    return [whole.slice(at, 7) for at in range(0, len(rows), 7)]


def test_anchors_are_compared_a_few_at_a_time(monkeypatch):
    """Whole anchors, whatever the batches: one with a third of all candidates among small ones."""
    batches = candidates([1, 3, 60, 2, 40, 1, 5, 30, 8])

    def found():
        rows = [r for b in suffixes.compare(iter(batches)) for r in b.to_pylist()]
        return {(r["doc"], r["start"] + i) for r in rows for i in range(r["whole"])}

    together = found()
    assert len(together) > 50
    sizes, plain = [], suffixes.compared
    monkeypatch.setattr(suffixes, "compared", lambda table: sizes.append(table.num_rows) or plain(table))
    monkeypatch.setattr(suffixes, "COMPARED", 10)
    assert found() == together
    assert len(sizes) > 3 and sum(sizes) == 150 and max(sizes) < 120
    assert list(suffixes.compare(iter([]))) == []
