"""Ranked lexical search: the best documents of each item, by norm buckets as in LEMP.

A document is a vector of integer impacts over the terms that items use. The vectors
are put in order of their length and cut to buckets. An item skips a bucket where
Cauchy-Schwarz leaves no score that could still enter its list; inside a bucket, bounds on
single coordinates leave few vectors, whose scores are then computed in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, Scratch, batch, map_arrow, sliced, text_buffer, values
from stellarate.llm.suffixes import mixed
from stellarate.llm.words import LOWER, NOT_ALPHANUMERIC, Words, word_hash

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents in an item's list.
BEST = 50
#: Terms of all items worked on together; one more item goes beyond it at most.
BLOCK_TERMS = 1 << 20
#: Vectors in a bucket.
BUCKET = 2048
#: Rows of the first round, and how many times more rows each further round takes.
FIRST_ROWS = 1 << 14
ROUND_BITS = 4
#: What rounding may take from a bound, as a share of it.
SLACK = 1e-9

VECTORS = "row long, doc_id long, level int, n long, terms array<int>, tfs array<long>"
IMPACTS = "row long, doc_id long, level int, norm double, terms array<int>, impacts array<int>"
FOUND = "item int, item_id long, score long, doc_id long"


def terms_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER_CASE, LOWER_CASE)
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(1)))


class Vocabulary:
    """The terms of some items, each with a number, found again by hash and then by bytes."""

    def __init__(self, terms: set[str]) -> None:
        words = [t.encode() for t in terms]
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of the items have one hash")
        words = [words[i] for i in order]
        self.number = {w.decode(): i for i, w in enumerate(words)}
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms here, and the numbers of these terms."""
        at = np.flatnonzero(self.seen[(words.hashes >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, words.hashes[at]), len(self) - 1)
        hit = self.hashes[term] == words.hashes[at]
        at, term = at[hit], term[hit]
        length = words.ends[at] - words.starts[at]
        same = length == self.lengths[term]
        at, term, length = at[same], term[same], length[same]
        if not len(at):
            return at, term
        first = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(first, length)
        ours = LOWER[data[inside + np.repeat(words.starts[at], length)]]
        equal = ours == self.data[inside + np.repeat(self.starts[term], length)]
        same = np.logical_and.reduceat(equal, first)
        return at[same], term[same]


class Vectors:
    """Counts of the vocabulary's terms in each document that has any term at all."""

    def __init__(self, vocabulary) -> None:
        self.vocabulary = vocabulary

    def __call__(self, batches: Batches) -> Batches:
        vocabulary = self.vocabulary.value
        size = np.int64(len(vocabulary))
        for rows in sliced(batches, 2):
            data, offsets = text_buffer(rows.column(2))
            words = Words(data, offsets, NOT_ALPHANUMERIC, lower=True)
            at, term = vocabulary.find(words, data)
            pair, tf = np.unique(words.doc[at] * size + term, return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(words.counts) + 1) * size)
            row = values(rows.column(0), 0)
            hashes = mixed(row.astype(np.uint64))
            level = np.zeros(len(row), np.int32)
            for step in range(1, 16):
                level += hashes & np.uint64((1 << ROUND_BITS * step) - 1) == 0
            out = pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(level),
                    pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array((pair % size).astype(np.int32))
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array(tf.astype(np.int64))
                    ),
                ],
                names=["row", "doc_id", "level", "n", "terms", "tfs"],
            )
            yield out.filter(pa.array(words.counts > 0))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and where each list begins and the last ends."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    elements = column.values.to_numpy(zero_copy_only=False)
    return elements[offsets[0] : offsets[-1]], offsets - offsets[0]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of a term that stands ``tf`` times in a document of ``n`` terms."""
    m = 100 - 50 + 50 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Impacts:
    """Impacts and length of each vector; ``length`` weighs a coordinate by its term's weight."""

    def __init__(self, weights, documents: int, length: int) -> None:
        self.weights, self.documents, self.length = weights, documents, length

    def __call__(self, batches: Batches) -> Batches:
        weights = self.weights.value.astype(np.float64)
        for rows in batches:
            terms, offsets = lists(rows.column("terms"))
            tf, _ = lists(rows.column("tfs"))
            sizes = np.diff(offsets)
            n = np.repeat(values(rows.column("n"), 0), sizes)
            own = impacts(tf, n, self.documents, self.length)
            square = np.zeros(len(sizes))
            full = np.flatnonzero(sizes)
            if len(full):
                parts = weights[terms] * own.astype(np.float64) ** 2
                square[full] = np.add.reduceat(parts, offsets[:-1][full])
            out = pa.RecordBatch.from_arrays(
                [
                    rows.column("row"),
                    rows.column("doc_id"),
                    rows.column("level"),
                    pa.array(np.sqrt(square)),
                    rows.column("terms"),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(own.astype(np.int32))
                    ),
                ],
                names=["row", "doc_id", "level", "norm", "terms", "impacts"],
            )
            yield out.filter(pa.array(sizes > 0))


@dataclass
class Items:
    """Items with their term numbers and weights, and the least score that matters for each."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    least: np.ndarray


class List:
    """The best documents found for one item so far."""

    def __init__(self, least: int) -> None:
        self.least = max(1, int(least))
        self.score = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)
        self.doc = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        self.score = np.concatenate([self.score, score])
        self.known = np.concatenate([self.known, known])
        self.doc = np.concatenate([self.doc, doc])
        if len(self.score) > 4 * BEST:
            self.trim()

    def trim(self) -> None:
        best = np.lexsort((self.doc, self.known, -self.score))[:BEST]
        self.score, self.known, self.doc = self.score[best], self.known[best], self.doc[best]
        if len(best) == BEST:
            self.least = max(self.least, int(self.score[-1]))


class Bucket:
    """Vectors of similar length, by row and by coordinate."""

    def __init__(self, terms: np.ndarray, own: np.ndarray, offsets: np.ndarray, norm: np.ndarray) -> None:
        self.terms, self.own, self.offsets, self.norm = terms, own.astype(np.int64), offsets, norm
        self.longest = norm.max()
        order = np.argsort(terms, kind="stable")
        row = np.repeat(np.arange(len(norm)), np.diff(offsets))
        self.row, self.by_term = row[order], self.own[order]
        self.present, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.highest = np.maximum.reduceat(self.by_term, self.first)

    def candidates(self, terms: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Rows whose score may reach ``least``, by Cauchy-Schwarz and coordinate bounds."""
        none = np.zeros(0, np.int64)
        wide = np.sqrt(weights[terms].sum())
        if wide * self.longest * (1 + SLACK) < least:
            return none
        at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
        here = self.present[at] == terms
        terms, at = terms[here], at[here]
        if not len(terms):
            return none
        weight = weights[terms]
        most = weight * self.highest[at]
        order = np.argsort(-most, kind="stable")
        terms, at, weight, most = terms[order], at[order], weight[order], most[order]
        # what the coordinates from each place on can give at most
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        if rest[0] < least:
            return none
        # a row without any of the focus coordinates stays below
        focus = int(np.searchsorted(-rest, -least, "right"))
        focus = min(max(focus, 1), len(terms))
        sizes = self.last[at[:focus]] - self.first[at[:focus]]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.first[at[:focus]] - begin, sizes)
        row, own = self.row[place], self.by_term[place].astype(np.float64)
        w = np.repeat(weight[:focus].astype(np.float64), sizes)
        part = np.bincount(row, w * own, len(self.norm))
        used = np.bincount(row, w * own * own, len(self.norm))
        left = np.sqrt(np.maximum(self.norm**2 * (1 + SLACK) - used, 0)) * np.sqrt(weight[focus:].sum())
        bound = part + np.minimum(left, rest[focus])
        return np.flatnonzero((part > 0) & (bound * (1 + SLACK) >= least))

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``dense`` has the item's weight of every term."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.offsets[rows] - begin, sizes)
        return np.add.reduceat(dense[self.terms[place]] * self.own[place], begin)


class Search:
    def __init__(self, items, bucket: int) -> None:
        self.items, self.bucket = items, bucket

    def __call__(self, batches: Batches) -> Batches:
        items: Items = self.items.value
        best = [List(least) for least in items.least]
        dense = np.zeros(len(items.weights), np.int64)
        for rows in batches:
            for start in range(0, rows.num_rows, self.bucket):
                self.look(rows.slice(start, self.bucket), items, best, dense)
        for found in best:
            found.trim()
        sizes = [len(b.score) for b in best]
        schema = pa.schema(
            [("item", pa.int32()), ("item_id", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())]
        )
        for start in range(0, len(best), 1024):
            some = range(start, min(start + 1024, len(best)))
            if sum(sizes[i] for i in some):
                doc = np.concatenate([best[i].doc for i in some])
                known = np.concatenate([best[i].known for i in some])
                yield batch(
                    schema,
                    np.repeat(np.array(some, np.int32), [sizes[i] for i in some]),
                    [items.ids[i] for i in some for _ in range(sizes[i])],
                    np.concatenate([best[i].score for i in some]),
                    pa.array(doc, mask=~known),
                )

    @staticmethod
    def look(rows: pa.RecordBatch, items: Items, best: list[List], dense: np.ndarray) -> None:
        terms, offsets = lists(rows.column("terms"))
        own, _ = lists(rows.column("impacts"))
        bucket = Bucket(terms, own, offsets, values(rows.column("norm"), 0))
        ids = rows.column("doc_id")
        known, doc = ids.is_valid().to_numpy(zero_copy_only=False), values(ids, 0)
        for number, asked in enumerate(items.terms):
            found = best[number]
            some = bucket.candidates(asked, items.weights, found.least)
            if not len(some):
                continue
            dense[asked] = items.weights[asked]
            score = bucket.scores(some, dense)
            dense[asked] = 0
            enough = score >= found.least
            some = some[enough]
            found.add(score[enough], known[some], doc[some])


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items (item_id, terms) that have terms, ``BLOCK_TERMS`` terms at a time."""
    held, size = [], 0
    listed = items.select("item_id", terms_of(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    for item in listed.toLocalIterator():
        if held and size + len(item.terms) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((item.item_id, item.terms))
        size += len(item.terms)
    if held:
        yield held


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def ranked(found: DataFrame, best: int = BEST) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search_block(docs: DataFrame, held: list[tuple], scratch: Scratch) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of some items; None if no document has a term."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    vocabulary = Vocabulary({t for _, terms in held for t in terms})
    shared = share(vocabulary)
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    vectors = scratch.table(map_arrow(plain, Vectors(shared), VECTORS), "vectors")
    shared.destroy()
    documents, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.full(len(vocabulary), weight(documents, 0), np.int64)
    for row in counts.toLocalIterator():
        weights[row.term] = weight(documents, row.df)
    shared = share(weights)
    ordered = map_arrow(vectors, Impacts(shared, documents, length), IMPACTS)
    by_length = [F.desc("norm"), F.asc("row")]
    ordered = ordered.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    ordered = scratch.table(ordered, "by-length")
    shared.destroy()
    items = Items(
        [item_id for item_id, _ in held],
        [np.unique([vocabulary.number[t] for t in terms]).astype(np.int32) for _, terms in held],
        weights,
        np.zeros(len(held), np.int64),
    )
    rounds = 0
    while documents >> ROUND_BITS * rounds > FIRST_ROWS:
        rounds += 1
    for number in reversed(range(rounds + 1)):
        # the lists of a part of the documents bound those of all from below
        rows = ordered.where(F.col("level") >= number) if number else ordered
        if number == rounds:
            rows = rows.coalesce(1)
        shared = share(items)
        found = ranked(scratch.table(map_arrow(rows, Search(shared, BUCKET), FOUND), f"found-{number}"))
        if number:
            last = found.where(F.col("rank") == BEST).select("item", "score")
            for row in last.toLocalIterator():
                items.least[row.item] = row.score
        else:
            found = scratch.table(found.select("item_id", "rank", "doc_id", "score"), "ranked", keep=True)
        shared.destroy()
    return found


def search(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``BEST`` documents of each item with a score above 0.

    Every row of ``items`` is asked for by itself, repeated ones and null ids too; null and
    empty texts have no terms and no result. Every row of ``docs`` is a document; null
    texts and texts without a term count for nothing. Equal scores are in order of doc_id,
    null first. No rows on either side give no rows; other columns are not looked at.
    """
    found = None
    for held in blocks(items):
        block = search_block(docs, held, scratch)
        if block is not None:
            found = block if found is None else found.unionByName(block)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
