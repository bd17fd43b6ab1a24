"""Near copies by SimHash: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints at most ``radius`` bits apart share a variant that is at most
``radius / 2`` bits from either, and all that share a variant are at most
``radius`` apart. So every fingerprint stands for all its variants within half
the radius (2,081 for a radius of 4), variants are brought together by a shuffle,
and what meets there is linked.

The shuffle goes by the leading bits of the variants: a fingerprint is sent once to
each value of those bits that some of its variants have, with the number of flips
it has left, and the task that owns the value makes the variants there, a bounded
number at a time. Copies count once, and a task passes on only a spanning forest of
what it links.
"""

from __future__ import annotations

import math
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import (
    Batches,
    Scratch,
    batch,
    distinct,
    join_unique,
    map_arrow,
    pieces,
    sliced,
)
from stellarate.llm.components import components

BITS = 64
RADIUS = 4
WORDS = 4
SEED = 42
#: Variants that a task makes at a time, and those that a bucket should have on average.
VARIANTS_AT_ONCE = 1 << 21
VARIANTS_PER_BUCKET = 1 << 21
#: Variants that a task should make in all.
VARIANTS_PER_TASK = 1 << 24
#: Fingerprints in a bucket beyond which it is split by more leading bits.
BUCKET_ROWS = 1 << 17
SPLIT_BITS = 6

LANES = np.uint64(0x0101010101010101)


# ---- fingerprints ----


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words; of the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return [
        digest(joined[s:e], SEED)
        for s, e in zip(starts[: len(found) - span + 1].tolist(), ends[span - 1 :].tolist())
    ]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes, the bits set in over half of them; groups may be empty."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    # Byte lanes hold sums of at most 255 bits, so groups are cut to blocks of 255.
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    begins = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * inner
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, begins)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        over = (2 * sums > sizes[:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def _fingerprints(batches: Batches) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for rows in sliced(batches, 1):
        hashes = [shingle_hashes(t.as_py()) for t in rows.column(1)]
        counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = np.fromiter((h for own in hashes for h in own), np.uint64, counts.sum())
        yield batch(schema, rows.column(0), majority(flat, counts).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text; without words it is 0."""
    return map_arrow(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


# ---- variants ----


def ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def masks(bits: int, flips: int) -> np.ndarray:
    """All ways to flip exactly ``flips`` of the lowest ``bits`` bits."""
    chosen = [sum(1 << b for b in c) for c in combinations(range(bits), flips)]
    return np.array(chosen, np.uint64)


def bucket_bits(count: int, flips: int) -> int:
    """Leading bits such that a bucket has about ``VARIANTS_PER_BUCKET`` variants."""
    buckets = count * ball_size(BITS, flips) / VARIANTS_PER_BUCKET
    return min(24, max(6, math.ceil(math.log2(max(1.0, buckets)))))


def routes(bits: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of a ``bits`` bit prefix by at most ``flips``, and the flips that remain."""
    parts = [masks(bits, r) for r in range(flips + 1)]
    left = np.repeat(np.arange(flips, -1, -1), [len(p) for p in parts])
    return np.concatenate(parts), left


def _prefixes(fps: np.ndarray, known: int, bits: int) -> np.ndarray:
    """The ``bits`` bits after the first ``known`` ones."""
    if not bits:
        return np.zeros(len(fps), np.uint64)
    return (fps >> np.uint64(BITS - known - bits)) & np.uint64((1 << bits) - 1)


class Route:
    """Sends fingerprints to the buckets of ``bits`` more leading bits.

    Input (bucket, fp, left): ``known`` bits are settled already and ``left`` flips
    remain. Output: the same columns, a bucket being a number of ``known + bits`` bits.
    """

    def __init__(self, known: int, bits: int, flips: int, count: bool) -> None:
        self.known, self.bits, self.flips, self.count = known, bits, flips, count

    def __call__(self, batches: Batches) -> Batches:
        sent = pa.schema([("bucket", pa.int64()), ("fp", pa.int64()), ("left", pa.int8())])
        counted = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
        for rows in batches:
            bucket, fp, left = (c.to_numpy() for c in rows.columns)
            for cut in pieces([bucket, fp, left], 20_000):
                for out in self.deal(*cut):
                    if self.count:
                        where, n = np.unique(out[0], return_counts=True)
                        yield batch(counted, where, n)
                    else:
                        yield from (batch(sent, *p) for p in pieces(list(out), 200_000))

    def deal(self, bucket: np.ndarray, fp: np.ndarray, left: np.ndarray):
        for flips in range(self.flips + 1):
            own = left == flips
            if own.any():
                change, rest = routes(self.bits, flips)
                prefix = _prefixes(fp[own].view(np.uint64), self.known, self.bits)
                to = (prefix[:, None] ^ change).view(np.int64)
                to |= (bucket[own] << self.bits)[:, None]
                yield (
                    to.ravel(),
                    np.repeat(fp[own], len(change)),
                    np.tile(rest, own.sum()).astype(np.int8),
                )


def flatten(label: np.ndarray) -> np.ndarray:
    while True:
        further = label[label]
        if np.array_equal(further, label):
            return label
        label = further


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of each a[i] and b[i]; a label is the set's smallest index."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = flatten(label)
    return label


def mixed16(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def link_bucket(fps: np.ndarray, left: np.ndarray, known: int, radius: int) -> np.ndarray:
    """Labels of one bucket's fingerprints: equal if a chain of shared variants joins them."""
    label = np.arange(len(fps))
    todo = [(label, left, known)]
    while todo:
        own, flips, settled = todo.pop()
        sizes = np.array([ball_size(BITS - settled, r) for r in range(flips.max() + 1)])
        rows = sizes[flips].sum()
        if len(own) < 2:
            continue
        if rows > VARIANTS_AT_ONCE and settled <= BITS - 4:
            prefix = _prefixes(fps[own], settled, 4)
            for value in range(16):
                rest = flips - np.bitwise_count(prefix ^ np.uint64(value)).astype(np.int8)
                ok = rest >= 0
                if ok.sum() > 1:
                    todo.append((own[ok], rest[ok], settled + 4))
            continue
        free = BITS - settled
        keep = np.uint64((1 << free) - 1)
        variants, owners = [], []
        for r in range(flips.max() + 1):
            mine = own[flips >= r]
            if len(mine):
                change = masks(free, r)
                variants.append(((fps[mine] & keep)[:, None] ^ change).ravel())
                owners.append(np.repeat(mine, len(change)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        # few variants meet another: only those that may are ordered with their owners
        ordered = np.sort(variant)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        marked = np.zeros(1 << 16, bool)
        marked[mixed16(twice)] = True
        some = np.flatnonzero(marked[mixed16(variant)])
        variant, owner = variant[some], owner[some]
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        meet = np.flatnonzero(variant[1:] == variant[:-1])
        a, b = owner[meet], owner[meet + 1]
        pair = distinct(np.minimum(a, b) * len(fps) + np.maximum(a, b))
        a, b = pair // len(fps), pair % len(fps)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        label = unite(label, a[near], b[near])
    return label


class Link:
    """Per task: gathers its buckets and gives a spanning forest (a, b) of each."""

    def __init__(self, known: int, radius: int) -> None:
        self.known, self.radius = known, radius

    def __call__(self, batches: Batches) -> Batches:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        bucket, rows = None, []
        for more in batches:
            where, fp, left = (c.to_numpy() for c in more.columns)
            cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
            for at, own, flips in zip(
                [where[i] for i in [0, *cuts] if len(where)],
                np.split(fp, cuts),
                np.split(left, cuts),
            ):
                if at != bucket and rows:
                    yield from self.forest(schema, rows)
                    rows = []
                bucket = at
                rows.append((own, flips))
        if rows:
            yield from self.forest(schema, rows)

    def forest(self, schema: pa.Schema, rows: list) -> Batches:
        fp = np.concatenate([r[0] for r in rows])
        left = np.concatenate([r[1] for r in rows])
        label = link_bucket(fp.view(np.uint64), left, self.known, self.radius)
        joined = np.flatnonzero(label != np.arange(len(label)))
        if len(joined):
            yield batch(schema, fp[label[joined]], fp[joined])


def links(prints: DataFrame, count: int, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints a chain of links connects.

    ``prints`` has one column ``fp`` without repeats, ``count`` rows. A link joins
    two fingerprints that differ in at most ``radius`` bits; ``radius`` is even.
    """
    flips = radius // 2
    rows = prints.select(
        F.lit(0).cast("long").alias("bucket"), "fp", F.lit(flips).cast("byte").alias("left")
    )
    known, bits, found = 0, bucket_bits(count, flips), None
    while True:
        route = Route(known, bits, flips, count=False)
        counter = Route(known, bits, flips, count=True)
        sent = map_arrow(rows, route, "bucket long, fp long, left byte")
        known += bits
        buckets = map_arrow(rows, counter, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")
        )
        # A bucket passes only with BUCKET_ROWS rows, and beyond 16 times the mean of
        # the first level, so few do and their list may be broadcast.
        most = max(BUCKET_ROWS, 16 * count * len(routes(bits, flips)[0]) >> bits)
        full = scratch.table(buckets.where(F.col("n") > most).select("bucket"), "full")
        split = known <= BITS - SPLIT_BITS - 4 and full.count() > 0
        here = sent.join(F.broadcast(full), "bucket", "left_anti") if split else sent
        parts = max(24, count * ball_size(BITS, flips) // VARIANTS_PER_TASK)
        forest = map_arrow(
            here.repartition(parts, "bucket").sortWithinPartitions("bucket"),
            Link(known, radius),
            "a long, b long",
        )
        found = forest if found is None else found.unionByName(forest)
        if not split:
            return found.distinct()
        rows = sent.join(F.broadcast(full), "bucket", "left_semi")
        rows = scratch.table(rows, "crowded")
        bits = SPLIT_BITS


def named_groups(
    groups: DataFrame, low: str, scratch: Scratch, radius: int, further: DataFrame | None = None
) -> DataFrame:
    """(fp, component_id): of each fingerprint the least ``low`` of its component.

    ``groups`` has a row per fingerprint, with the least ``low`` of its documents. ``further``
    has links (a, b) of fingerprints to add.
    """
    count = groups.count()
    edges = links(groups.select("fp"), count, scratch, radius)
    if further is not None:
        edges = edges.unionByName(further)
    roots = components(edges, scratch)
    member = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.col(low).alias("low"), F.coalesce("root", "fp").alias("root")
    )
    member = scratch.table(member, "members")
    sizes = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_unique(
        member.select("fp", "root"),
        sizes.select("root", "component_id"),
        "root",
        sizes.select("root", "n"),
        count,
    )
    return scratch.table(named.select("fp", "component_id"), "named", keep=True)


def near_copies(docs: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fp, component_id).

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. Null and blank texts have fingerprint 0 and are linked like any
    other; rows with a null doc_id keep it and lend no id to their component (null
    if it has no other). Repeated rows stay repeated; no rows give no rows; other
    columns are not looked at.
    """
    prints = scratch.table(fingerprints(docs), "prints", keep=True)
    groups = scratch.table(
        prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")),
        "groups",
        keep=True,
    )
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = named_groups(groups, "low", scratch, radius)
    return join_unique(prints, named, "fp", groups.select("fp", "n"), rows)


def hexed(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: A row of a document: its id, null last, and a digest of its text.
ROW = ("no_id", "doc_id", "digest")


def _prints_with_digests(batches: Batches) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.binary())])
    for rows in batches:
        digests = [md5(t.as_buffer() or b"", usedforsecurity=False).digest() for t in rows.column(1)]
        prints = pa.Table.from_batches(list(_fingerprints(iter([rows])))).combine_chunks()
        yield batch(
            schema, rows.column(0), prints.column("fp").combine_chunks(), pa.array(digests, pa.binary())
        )


def one_of_each(
    docs: DataFrame, scratch: Scratch, radius: int = RADIUS, further: DataFrame | None = None
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Rows are chosen by doc_id, null last, and then by a digest of their text, so texts that
    share a doc_id, and texts without one, are told apart: no text is lost of which no
    near copy stays, and of repeated rows one stays, also without an id. ``further`` has
    links (a, b) of fingerprints to add. No rows give no rows; all columns stay.
    """
    prints = map_arrow(
        docs.select("doc_id", "text"), _prints_with_digests, "doc_id long, fp long, digest binary"
    )
    prints = scratch.table(prints.withColumn("no_id", F.col("doc_id").isNull()), "row-prints")
    groups = scratch.table(
        prints.groupBy("fp").agg(F.min(F.struct(*ROW)).alias("low")), "row-groups", keep=True
    )
    named = named_groups(groups, "low", scratch, radius, further)
    # one row of each component, by the row that its least fingerprint stands for
    chosen = named.select("component_id.*").distinct()
    key = F.struct(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"),
    )
    known = F.struct("no_id", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "digest")
    counts = prints.groupBy(known.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    chosen = scratch.table(
        chosen.select(known.alias("key")).join(counts, "key").withColumnRenamed("n", "_rows"),
        "chosen",
        keep=True,
    )
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    # merged at every size, so that what is shuffled grows as the documents do
    kept = rows.join(chosen.hint("merge"), "key")
    once = kept.where("_rows = 1").select("row.*")
    # repeated rows are equal in id and text; the first of them stays
    repeated = kept.where("_rows > 1").dropDuplicates(["key"]).select("row.*")
    return once.unionByName(repeated)
