"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, in classes that double. An item's
sketch is its smallest shingle hashes; a class has as many as may be missing from a
document that still contains enough of its largest item, and one more. So a
document that contains enough of an item holds at least one hash of the sketch,
however long it is, and the search misses nothing. Documents stream past the sketch
index; what collides is verified on the shingles themselves.

The index goes to the tasks in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, map_arrow, sliced, text_buffer
from stellarate.llm.words import WHITE, Words, shingles, text_shingles

SIZE = 5
CONTAINMENT = 0.8
#: Bytes of item text in one block of the index.
BLOCK_BYTES = 16 << 20


def needed(count: int, containment: float) -> int:
    """The fewest of ``count`` shingles that reach the containment."""
    return max(1, math.ceil(round(containment * count, 9)))


def sketch_size(count: int, containment: float) -> int:
    """Hashes of the sketch of an item, by the largest count of its size class."""
    largest = (1 << max(0, count - 1).bit_length()) if count else 0
    return min(count, largest - needed(largest, containment) + 1)


class Index:
    """Sketches of some items, and their shingles to verify with."""

    def __init__(self, items: list[tuple[int | None, str | None]], containment: float) -> None:
        self.containment = containment
        self.items = [(name, frozenset(text_shingles(text, SIZE))) for name, text in items]
        column = pa.array([text for _, text in items], pa.string())
        data, offsets = text_buffer(column)
        hashes, owner = shingles(Words(data, offsets, WHITE, lower=True), SIZE)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        self.of_hash: dict[int, list[int]] = defaultdict(list)
        for item in range(len(items)):
            own = np.unique(hashes[np.searchsorted(owner, item) : np.searchsorted(owner, item, "right")])
            for h in own[: sketch_size(len(own), containment)].tolist():
                self.of_hash[h].append(item)
        self.hashes = np.array(sorted(self.of_hash), np.uint64)
        # a first look at 16 bits of a hash spares most searches
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def collisions(self, column: pa.Array) -> dict[int, set[int]]:
        """Rows of a column of texts, each with the items of which it holds a sketch hash."""
        data, offsets = text_buffer(column)
        found: dict[int, set[int]] = defaultdict(set)
        if not len(self.hashes):
            return found
        hashes, doc = shingles(Words(data, offsets, WHITE, lower=True), SIZE)
        some = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        hashes, doc = hashes[some], doc[some]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        for row, h in zip(doc[hit].tolist(), hashes[hit].tolist()):
            found[row].update(self.of_hash[h])
        return found

    def contained(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles found) of the pairs that reach the containment."""
        for row, items in sorted(self.collisions(column).items()):
            own = set(text_shingles(column[row].as_py(), SIZE))
            for item in sorted(items):
                wanted = self.items[item][1]
                count = len(wanted & own)
                if count >= needed(len(wanted), self.containment):
                    yield row, item, count


class Report:
    def __init__(self, index) -> None:
        self.index = index

    def __call__(self, batches: Batches) -> Batches:
        index = self.index.value
        for rows in sliced(batches, 1):
            found = list(index.contained(rows.column(1)))
            if found:
                row, item, count = (list(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(row)),
                        pa.array([index.items[i][0] for i in item], pa.int64()),
                        pa.array([len(index.items[i][1]) for i in item], pa.int64()),
                        pa.array(count, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_shingles", "n_found"],
                )


class Drop:
    """Passes on the rows that contain no item; ``text`` is the column to search."""

    def __init__(self, index, text: int) -> None:
        self.index, self.text = index, text

    def __call__(self, batches: Batches) -> Batches:
        for rows in sliced(batches, self.text):
            keep = np.ones(rows.num_rows, bool)
            keep[[row for row, _, _ in self.index.value.contained(rows.column(self.text))]] = False
            yield rows.filter(pa.array(keep))


def indexes(items: DataFrame, containment: float) -> Iterator[Index]:
    """The items (item_id, text), in blocks of at most ``BLOCK_BYTES`` and one text."""
    held, size = [], 0
    for item in items.select("item_id", "text").toLocalIterator():
        if held and size + len(item.text or "") > BLOCK_BYTES:
            yield Index(held, containment)
            held, size = [], 0
        held.append(tuple(item))
        size += len(item.text or "")
    yield Index(held, containment)


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found) where a document contains enough of an item.

    Words are runs without white space, A-Z lower-cased; shingles are five
    consecutive words, or all words of a shorter text; enough means ``containment``
    of the item's distinct shingles. Null, empty and blank texts contain nothing and
    are contained nowhere. Ids may be null; repeated rows of either table give a row
    each; other columns are not looked at.
    """
    found = None
    plain = docs.select("doc_id", "text")
    for index in indexes(items, containment):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        block = map_arrow(
            plain, Report(shared), "doc_id long, item_id long, n_shingles long, n_found long"
        )
        found = block if found is None else found.unionByName(block)
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; see ``contained_items``."""
    for index in indexes(items, containment):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = map_arrow(docs, Drop(shared, docs.columns.index("text")), docs.schema)
    return docs
