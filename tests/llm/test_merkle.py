import zlib
from hashlib import sha256

import pytest

from stellarate.llm import merkle
from stellarate.llm.cluster import Scratch
from tests.llm import common


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    values = (doc_id, source, lang, n_chars, text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proof(level: list[str], at: int) -> list[tuple[str, str]]:
    """(side, digest) of the siblings of a node up to the only node; level by level."""
    steps = []
    while len(level) > 1:
        other = at ^ 1
        steps.append(("left" if other < at else "right", level[other]) if other < len(level) else ("", ""))
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at //= 2
    return steps


def root_of(level: list[str]) -> str:
    while len(level) > 1:
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def brute(rows: list[tuple]) -> list[tuple]:
    low = -(1 << 70)
    langs: dict = {}
    for d, source, lang, n, text in rows:
        changed = n is not None and d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        own = leaf(d, source, lang, n, text)
        seen = leaf(d, source, lang, n + 1, text) if changed else own
        langs.setdefault(lang, []).append((low if d is None else d, own, seen, d))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort(key=lambda r: r[:2])
    tops = [root_of([r[1] for r in langs[name]]) for name in names]
    root, out = root_of(tops), []
    for place, name in enumerate(names):
        leaves = [r[1] for r in langs[name]]
        for at, (_, own, seen, d) in enumerate(langs[name]):
            steps = proof(leaves, at) + proof(tops, place)
            folded = seen
            for side, other in steps:
                folded = digest(other + folded if side == "left" else folded + other)
            told = digest("".join(other for _, other in steps))
            out.append((d, own, tops[place], root, told, folded, folded == root))
    return out


def proved(spark, rows):
    docs = spark.createDataFrame(
        [(*r, "x", b"y", 7) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, "
        "key string, digest binary, pos int",
    ).repartition(3)
    with Scratch(spark) as scratch:
        return merkle.proofs(merkle.manifest(docs, scratch), scratch).collect()


def awkward() -> list[tuple]:
    rows = [(d, "s", "en", None if t is None else len(t), t) for d, t in common.awkward()]
    rows += [(100 + i, None if i % 3 else "web", [None, "", "é", "de", "fr"][i % 5], i, f"text {i}") for i in range(60)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "a", "single", (1 << 63) - 1, "most")]
    return rows + [(id_, "s", "single-2", 4, "t") for id_ in (-5,)]


@pytest.mark.parametrize("height", [1, 3, 8])
def test_against_plain_trees(spark, monkeypatch, height):
    """Blocks of two leaves make many tiers, also above the languages."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = awkward()
    common.same(proved(spark, rows), brute(rows))


@pytest.mark.parametrize("count", [1, 2, 255, 256, 257, 700])
def test_sizes_about_a_block(spark, count):
    rows = [(i * 3, "s", "en", i, str(i)) for i in range(count)]
    found = proved(spark, rows)
    common.same(found, brute(rows))
    assert sum(not r.verified for r in found) == sum(zlib.crc32(str(3 * i).encode()) % 7 == 0 for i in range(count))


def test_no_rows(spark):
    assert proved(spark, []) == []


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(5, "s", "en", 4, "copy")] * 300 + [(i, "s", "en", 1, str(i)) for i in range(600)]
    common.same(proved(spark, rows), brute(rows))


def test_addresses_fill_the_array_and_keep_subtrees_together():
    for levels in range(1, 10):
        places = [merkle.address(levels, d, i) for d in range(levels) for i in range(1 << d)]
        assert sorted(places) == list(range((1 << levels) - 1))
    # a bottom tree of four levels of a tree of eight is one run of 15 places
    for tree in range(16):
        run = [merkle.address(8, 4 + d, (tree << d) + i) for d in range(4) for i in range(1 << d)]
        assert sorted(run) == list(range(15 + 15 * tree, 30 + 15 * tree))


def test_fold_of_any_other_leaf_is_another_root():
    leaves = [sha256(bytes([i])).digest() for i in range(11)]
    tree = merkle.Tree(11, merkle.rise_to_one(11)).fill(leaves)
    for i, own in enumerate(leaves):
        assert merkle.fold(own, tree.path(i)) == tree.root
        assert merkle.fold(leaves[(i + 1) % 11], tree.path(i)) != tree.root
