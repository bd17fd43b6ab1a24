import random

from stellarate.llm import decontamination as dec
from tests.llm import common


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def cases() -> tuple[list, list]:
    rng = random.Random(5)
    items = [(i, common.prose(i, rng.randint(1, 70))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "one"), (93, items[9][1]), (None, items[8][1])]
    docs = common.awkward()
    for i, (_, text) in enumerate(items[:30]):
        words = text.split()
        for spoilt in (0, 1, 3):
            own = [w.upper() for w in words]
            for at in rng.sample(range(len(own)), min(spoilt, len(own))):
                own[at] = "other"
            docs.append((100 + 10 * i + spoilt, f"{common.prose(i + 500, 30)} {' '.join(own)}\nend"))
    return docs, items


def test_against_all_pairs(spark):
    docs, items = cases()
    got = dec.contained_items(common.docs_of(spark, docs), items_of(spark, items)).drop("containment")
    expected = common.contained(docs, items)
    assert len(expected) > 30
    common.same(got.collect(), expected)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 600)
    docs, items = cases()
    frame, table = common.docs_of(spark, docs), items_of(spark, items)
    assert len(list(dec.indexes(table, 0.8))) > 5
    got = dec.contained_items(frame, table).drop("containment")
    common.same(got.collect(), common.contained(docs, items))
    leaked = {d for d, *_ in common.contained(docs, items)}
    kept = dec.without_items(frame, table)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(
        str(d) for d, t in docs if not (d in leaked and common.contained([(d, t)], items))
    )


def test_nothing(spark):
    none, some = common.docs_of(spark, []), common.docs_of(spark, [(1, "a b c d e f")])
    no_items = items_of(spark, [])
    assert dec.contained_items(none, items_of(spark, [(1, "a b")])).count() == 0
    assert dec.contained_items(some, no_items).count() == 0
    assert dec.without_items(some, no_items).count() == 1


def test_sketches_cannot_be_missed():
    for count in range(1, 200):
        need = dec.needed(count, 0.8)
        assert 5 * need >= 4 * count > 5 * (need - 1)
        assert dec.sketch_size(count, 0.8) >= count - need + 1
