"""Removal of long byte strings that occurred earlier: a sparse, distributed suffix sort.

A byte goes if a ``SPAN``-byte string over it also starts earlier in the corpus.

1. Every window of ``SPAN`` bytes names its smallest ``GRAM``-byte string as anchor
   (by a hash, the leftmost of equals), so equal windows name the same anchor at the
   same place. Consecutive windows with one anchor form a unit, about 40 windows.
   All hashes are differences of prefix polynomial hashes.
2. Units are shuffled by their anchor. Of equal units only the earliest can hold
   first occurrences; the windows of the others are repeats. Equal units within one
   batch are settled before the shuffle, so mass copies never meet in one task, and
   anchors with very many units are shuffled by whole windows instead.
3. Earliest units that share an anchor and 60 bytes around it, but differ, may still
   share windows. Their suffixes from the anchor on are sorted by a mergesort that
   compares two suffixes by a binary search over prefix hashes for their common
   extension. Windows are equal if the suffixes agree to the window's end (a stretch
   of the order without a shorter common extension) and so do the hashes to its
   start. Both are verified on the bytes; a collision starts the sort anew with
   another base.
4. Repeats are sorted to their documents and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, Scratch, batch, map_arrow, text_buffer, values

SPAN = 100
GRAM = 20
#: Bytes beyond the anchor that candidates must share on one side.
FLANK = (SPAN - GRAM) // 2
#: Bytes hashed at a time.
SECTION = 1 << 18
#: Units of one anchor beyond which it is shuffled by windows, and the share of the
#: documents from which such anchors are found (it affects the balance only).
CROWDED = 100_000
LOOKED_AT = 64

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
LOWEST = -(1 << 63)
WHOLE = 1 << 64

REPEAT, UNIT, CANDIDATE, TEXT = 0, 1, 2, 3
UNITS = "kind byte, anchor long, whole long, sides int, doc long, start int, shape long, high long, low long"
UNIT_SCHEMA = pa.schema(
    [
        ("kind", pa.int8()),
        ("anchor", pa.int64()),
        ("whole", pa.int64()),
        ("sides", pa.int32()),
        ("doc", pa.int64()),
        ("start", pa.int32()),
        ("shape", pa.int64()),
        ("high", pa.int64()),
        ("low", pa.int64()),
    ]
)
#: The 128 bits that, with the doc_id, tell texts apart: halves of a digest of the text.
#: Candidates compared together; one takes some 3.5 KB while it is.
COMPARED = 8192
VERSION = ["high", "low"]
#: Buckets of ids; only texts of buckets with a repeated id need a version.
ID_BUCKETS = 1 << 16


# ---- hashes ----


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    out[1:] = base % WHOLE
    return np.multiply.accumulate(out)


class Prefixes:
    """Prefix polynomial hashes of a section; any part's hash is one difference."""

    limit = SECTION + 4 * SPAN
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        if base not in self.tables:
            self.tables[base] = (powers(base, self.limit), powers(pow(base, -1, WHOLE), self.limit))
        up, self.down = self.tables[base]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:count]) * self.down[:count])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def window_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` consecutive values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


# ---- units ----


def sections(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of windows to hash together: (document, first window, end of windows) arrays."""
    docs = np.flatnonzero(np.diff(offsets) >= SPAN)
    first, last = offsets[docs], offsets[docs + 1] - SPAN + 1
    held: list[tuple[int, int, int]] = []
    for doc, lo, hi in zip(docs.tolist(), first.tolist(), last.tolist()):
        for at in range(lo, hi, SECTION):
            end = min(hi, at + SECTION)
            if held and end - held[0][1] > SECTION:
                yield tuple(np.array(held).T)
                held = []
            held.append((doc, at, end))
    if held:
        yield tuple(np.array(held).T)


def find_units(data: np.ndarray, offsets: np.ndarray, crowded: np.ndarray) -> Iterator[list]:
    """[document, start, windows, anchor place, anchor, whole, sides] of each section's units.

    ``sides`` holds 16 bits of the hash of the bytes around the anchor that all windows
    with enough room before it share, and of those after it; 0 where no window has.
    """
    one = np.uint64(1)
    for doc, first, end in sections(offsets):
        lo = first[0]
        part = data[lo : end[-1] + SPAN - 1]
        hashes, other = Prefixes(part, BASES[0]), Prefixes(part, BASES[1])
        grams = hashes.grams(GRAM)
        ranked = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        anchor_at = (window_minimum(ranked, SPAN - GRAM + 1) & np.uint64(0xFFFFF)).astype(np.int64)
        count = len(anchor_at)
        turn = np.zeros(count + 1, bool)
        turn[1:count] = anchor_at[1:] != anchor_at[:-1]
        turn[first - lo] = True
        turn[end - lo] = True
        turn[count] = True
        places = np.flatnonzero(turn)
        begin, stop = places[:-1], places[1:]
        own = np.searchsorted(first - lo, begin, "right") - 1
        inside = begin < (end - lo)[own]
        begin, stop, own = begin[inside], stop[inside], own[inside]
        at = anchor_at[begin]
        anchor = grams[at]
        loose = np.isin(anchor, crowded) if len(crowded) else np.zeros(len(begin), bool)
        if loose.any():
            sizes = np.where(loose, stop - begin, 1)
            row = np.repeat(np.arange(len(begin)), sizes)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin, own, at, anchor, loose = begin[row] + inner, own[row], at[row], anchor[row], loose[row]
            stop = np.where(loose, begin + 1, stop[row])
        whole = other.part(begin, stop + SPAN - 1) ^ mixed((stop - begin).astype(np.uint64))
        has_before = (at - begin >= FLANK) & ~loose
        has_after = (at - stop + 1 < FLANK) & ~loose
        before = hashes.part(np.where(has_before, at - FLANK, begin), at + GRAM)
        after = hashes.part(at, np.where(has_after, at + GRAM + FLANK + 1, at + 1))
        if loose.any():
            anchor = np.where(loose, hashes.part(begin, begin + SPAN), anchor)
        yield [
            doc[own],
            begin + lo - offsets[doc[own]],
            stop - begin,
            at - begin,
            anchor.view(np.int64),
            whole.view(np.int64),
            sides_of(np.where(has_before, before >> np.uint64(48) | one, 0))
            | sides_of(np.where(has_after, after >> np.uint64(48) | one, 0)) << 16,
        ]


def sides_of(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32).view(np.int32)


def shape_of(windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Windows and anchor place in one number."""
    return (windows << 8) | place


def unshape(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shape >> 8) & 255, shape & 255


def shared_ids(docs: DataFrame) -> DataFrame:
    """Column bucket: what of ``ID_BUCKETS`` hash buckets some repeated doc_id is in."""
    counts = docs.select(doc_key()).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select(id_bucket()).distinct()


def doc_key():
    return F.coalesce("doc_id", F.lit(LOWEST)).alias("doc")


def id_bucket():
    return F.pmod(F.xxhash64("doc"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")


def versioned(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with columns high and low: an MD5 digest of the bytes of ``text``, null as
    empty. Both are 0 where the bucket of the id is not in ``shared``, so the id is unique."""
    digest = F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    known = F.broadcast(shared.withColumn("many", F.lit(True)))
    found = rows.withColumn("bucket", id_bucket()).join(known, "bucket", "left")
    return found.withColumns(
        {
            name: F.when(
                F.col("many"), F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
            ).otherwise(F.lit(0).cast("long"))
            for at, name in zip((1, 17), VERSION)
        }
    ).drop("bucket", "many")


def joined_runs(doc, high, low, start, windows) -> list[np.ndarray]:
    """Runs of windows as (doc, high, low, start, windows), with adjoining ones made one."""
    if not len(doc):
        return [doc, high, low, start, windows]
    order = np.lexsort((start, low, high, doc))
    doc, high, low, start, windows = (c[order] for c in (doc, high, low, start, windows))
    new = group_starts(doc, high, low)
    new[1:] |= start[1:] > start[:-1] + windows[:-1]
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(start + windows, head)
    return [doc[head], high[head], low[head], start[head], end - start[head]]


def repeats(doc, high, low, start, windows) -> pa.RecordBatch:
    """Rows for runs of repeated windows; ``whole`` has their number."""
    doc, high, low, start, windows = joined_runs(doc, high, low, start, windows)
    none = np.zeros(len(doc), np.int64)
    spread = mixed((doc ^ high).view(np.uint64) ^ mixed(start.astype(np.uint64)))
    return batch(
        UNIT_SCHEMA, none + REPEAT, spread.view(np.int64), windows, none, doc, start,
        shape_of(none, none), high, low,
    )


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def later_ones(anchor, whole, doc, start, shape, high, low) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by unit and place, and True for those that repeat an earlier unit.

    Rows of the same unit at the same place (versions of a document) are not earlier
    than each other.
    """
    order = np.lexsort((low, high, shape, start, doc, whole, anchor))
    a, w, d, s = anchor[order], whole[order], doc[order], start[order]
    new = group_starts(a, w)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (d != d[lead]) | (s != s[lead])


def repeated_units(doc, start, shape, high, low) -> pa.RecordBatch:
    return repeats(doc, high, low, start, unshape(shape)[0])


class FindUnits:
    """Texts to units; units that repeat one of the same batch come out as repeats."""

    def __init__(self, crowded: list[int]) -> None:
        self.crowded = np.array(crowded, np.int64).view(np.uint64)

    def __call__(self, batches: Batches) -> Batches:
        for rows in batches:
            data, offsets = text_buffer(rows.column(1))
            ids = values(rows.column(0), LOWEST)
            found = list(find_units(data, offsets, self.crowded))
            if not found:
                continue
            high, low = (c.to_numpy() for c in rows.columns[2:])
            doc, start, windows, place, anchor, whole, sides = map(np.concatenate, zip(*found))
            shape = shape_of(windows, place)
            doc, high, low = ids[doc], high[doc], low[doc]
            order, later = later_ones(anchor, whole, doc, start, shape, high, low)
            columns = [c[order] for c in (anchor, whole, sides, doc, start, shape, high, low)]
            if later.any():
                yield repeated_units(*(c[later] for c in columns[3:]))
            # the same unit of the same text twice: repeated rows
            keep = group_starts(columns[0], columns[1], *columns[3:]) & ~later
            yield batch(UNIT_SCHEMA, np.full(keep.sum(), UNIT, np.int8), *(c[keep] for c in columns))


def sampled_anchors(batches: Batches) -> Batches:
    """Counts of the anchors that recur in a batch of the looked-at documents."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
    none = np.zeros(0, np.uint64)
    for rows in batches:
        data, offsets = text_buffer(rows.column(1))
        for unit in find_units(data, offsets, none):
            anchor, n = np.unique(unit[4], return_counts=True)
            yield batch(schema, anchor[n > 1], n[n > 1])


def settle(batches: Batches) -> Batches:
    """All units of some anchors: repeats of whole units, and what must be compared byte by byte."""
    held: list[list[np.ndarray]] = []
    for rows in batches:
        kind = rows.column(0).to_numpy()
        columns = [c.to_numpy() for c in rows.columns]
        done = kind == REPEAT
        if done.any():
            yield batch(UNIT_SCHEMA, *(c[done] for c in columns))
        if not done.all():
            held.append([c[~done] for c in columns])
    if not held:
        return
    _, *columns = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.argsort(columns[0])
    new = group_starts(columns[0][order])
    alone = new & np.append(new[1:], True)
    columns = [c[order[~alone]] for c in columns]
    order, later = later_ones(columns[0], columns[1], *columns[3:])
    columns = [c[order] for c in columns]
    if later.any():
        yield repeated_units(*(c[later] for c in columns[3:]))
    # repeated rows of different batches count once
    keep = group_starts(columns[0], columns[1], *columns[3:]) & ~later
    columns = [c[keep] for c in columns]
    anchor, whole, sides = columns[:3]
    pick = np.zeros(len(anchor), bool)
    for side in (sides & 0xFFFF, sides >> 16):
        by = np.lexsort((whole, side, anchor))
        same = ~group_starts(anchor[by], side[by])
        differ = np.zeros(len(by), bool)
        differ[1:] = same[1:] & (whole[by][1:] != whole[by][:-1])
        # mark every member of a stretch that holds two different units
        stretch = np.cumsum(~same) - 1
        marked = np.zeros(stretch[-1] + 1 if len(by) else 0, bool)
        marked[stretch[differ]] = True
        pick[by] |= marked[stretch] & (side[by] != 0)
    if pick.any():
        yield batch(UNIT_SCHEMA, np.full(pick.sum(), CANDIDATE, np.int8), *(c[pick] for c in columns))


# ---- suffix sort of the candidates ----


class Suffixes:
    """Suffixes from the anchor on, as prefix polynomial hashes and bytes."""

    def __init__(self, right: np.ndarray, length: np.ndarray, base: int) -> None:
        self.right, self.length = right, length
        self.sums = np.zeros((len(right), right.shape[1] + 1), np.uint64)
        np.cumsum(right * powers(base, right.shape[1]), axis=1, out=self.sums[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.sums[a, middle] == self.sums[b, middle]
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a is before suffix b (or equal to it, where asked)."""
        at = self.common(a, b)
        a_ended, b_ended = at == self.length[a], at == self.length[b]
        last = self.right.shape[1] - 1
        x, y = self.right[a, np.minimum(at, last)], self.right[b, np.minimum(at, last)]
        return np.where(b_ended, a_ended & or_equal, a_ended | (x < y))


def merge_sort(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within runs of equal ``group`` (sorted): bottom-up mergesort.

    All merges of a level happen at once: an element's place is its own index plus its
    rank in the sibling run, found by a binary search of suffix comparisons.
    """
    count = len(group)
    order = np.arange(count)
    if not count:
        return order
    new = group_starts(group)
    head = np.maximum.accumulate(np.where(new, np.arange(count), 0))
    size = np.diff(np.append(np.flatnonzero(new), count))[np.cumsum(new) - 1]
    inner = np.arange(count) - head
    run = 1
    while run < size.max():
        index = inner // run
        sibling = (index ^ 1) * run
        todo = np.flatnonzero(sibling < size)
        from_left = (index[todo] & 1) == 0
        base = head[todo] + sibling[todo]
        low = np.zeros(len(todo), np.int64)
        high = np.minimum(run, size[todo] - sibling[todo])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            theirs, mine = order[base[open_] + middle], order[todo[open_]]
            before = suffixes.less(theirs, mine, ~from_left[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        pair = head[todo] + (index[todo] & ~1) * run
        place = pair + inner[todo] % run + low
        moved = order.copy()
        moved[place] = order[todo]
        order = moved
        run *= 2
    return order


def repeated_windows(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, windows: np.ndarray,
    place: np.ndarray, rank: np.ndarray,
) -> np.ndarray:
    """Matrix (unit, bytes before the anchor): True if an equal window has a smaller rank.

    ``left`` holds the bytes before the anchor, nearest first, ``right`` those from the
    anchor on; ``group`` is sorted.
    """
    reach = left.shape[1]
    length = np.minimum(windows + SPAN - 1 - place, SPAN)
    for base in BASES:
        suffixes = Suffixes(right, length, base)
        order = merge_sort(suffixes, group)
        a, b = order[:-1], order[1:]
        common = np.append(0, suffixes.common(a, b)) if len(order) else np.zeros(0, int)
        # verification: the bytes must give the same common extensions
        limit = np.minimum(length[a], length[b])
        unequal = right[a] != right[b]
        true = np.minimum(np.where(unequal.any(1), unequal.argmax(1), SPAN), limit)
        if not np.array_equal(common[1:], true):
            continue
        hashes = np.zeros((len(left), reach + 1), np.uint64)
        np.cumsum(left * powers(base, reach), axis=1, out=hashes[:, 1:])
        out = np.zeros((len(group), reach + 1), bool)
        fresh = group_starts(group[order])
        for o in range(reach + 1):
            stretch = np.cumsum(fresh | (common < SPAN - o))
            has = np.flatnonzero((place[order] >= o) & (place[order] - windows[order] < o))
            unit = order[has]
            by = np.lexsort((rank[unit], hashes[unit, o], stretch[has]))
            unit, at = unit[by], stretch[has][by]
            new = group_starts(at, hashes[unit, o])
            lead = unit[np.maximum.accumulate(np.where(new, np.arange(len(unit)), 0))] if len(unit) else unit
            repeated = rank[unit] > rank[lead]
            if (left[unit[repeated], :o] != left[lead[repeated], :o]).any():
                break
            out[unit, o] = repeated
        else:
            return out
    raise ArithmeticError("hash collisions under every base")


def compare(batches: Batches) -> Batches:
    """Candidates with their bytes, in order of their anchors, to the repeats among their windows.

    Whole anchors are compared, about ``COMPARED`` candidates at a time.
    """
    held: list[pa.RecordBatch] = []
    count = wanted = 0
    for rows in batches:
        held.append(rows)
        count += rows.num_rows
        if count < max(COMPARED, wanted):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column(0).to_numpy()
        whole = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
        if whole:
            yield from compared(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        count -= whole
        # an anchor of very many candidates is not looked through at every batch
        wanted = 2 * count
    if count:
        yield from compared(pa.Table.from_batches(held).combine_chunks())


def compared(table: pa.Table) -> Batches:
    anchor, doc, start, shape, high, low = (table.column(i).to_numpy() for i in range(6))
    blob, offsets = binary_buffer(table.column(6))
    windows, place = unshape(shape)
    order = np.argsort(anchor, kind="stable")
    reach = SPAN - GRAM
    at = offsets[:-1] + place
    sides = []
    for steps, inside in (
        (-1 - np.arange(reach), lambda s: -s <= place[:, None]),
        (np.arange(SPAN), lambda s: s < (windows + SPAN - 1 - place)[:, None]),
    ):
        where = np.clip(at[:, None] + steps, 0, max(len(blob) - 1, 0))
        sides.append(np.where(inside(steps), blob[where], 0).astype(np.uint8))
    key = np.lexsort((start + place, doc))
    change = group_starts(doc[key], (start + place)[key])
    rank = np.empty(len(doc), np.int64)
    rank[key] = np.cumsum(change)
    flags = repeated_windows(
        anchor[order], sides[0][order], sides[1][order], windows[order], place[order], rank[order]
    )
    unit, before = np.nonzero(flags)
    unit = order[unit]
    begin = start[unit] + place[unit] - before
    yield repeats(doc[unit], high[unit], low[unit], begin, np.ones(len(unit), np.int64))


def binary_buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    joined = column.combine_chunks().cast(pa.large_binary())
    _, places, data = joined.buffers()
    offsets = np.frombuffer(places, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets


# ---- cutting ----

DONE = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, "
    "spans array<struct<start:long,end:long>>"
)
OPEN = (
    "text binary, runs binary, units array<struct<anchor:long,start:int,shape:long,bytes:binary>>"
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OPEN_UNITS = pa.list_(
    pa.struct(
        [("anchor", pa.int64()), ("start", pa.int32()), ("shape", pa.int64()), ("bytes", pa.binary())]
    )
)


def spans_of(runs: np.ndarray) -> np.ndarray:
    """(start, windows) rows to the maximal byte runs they cover, as (start, end) rows."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 0] + runs[:, 1] + SPAN - 1)
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:, 0] > end[:-1]
    return np.stack([runs[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


class Cut:
    """Rows sorted by document and version, repeats first and texts last, to one row per text.

    ``settled``: nothing is left to compare. Otherwise a text with candidates comes
    out as it is, with its repeats so far and its candidates' bytes.
    """

    def __init__(self, settled: bool, keep_text: bool) -> None:
        self.settled, self.keep_text = settled, keep_text

    def __call__(self, batches: Batches) -> Batches:
        key, runs, units = None, [], []
        for rows in batches:
            kind, start, shape, anchor, whole, *keys = (
                rows.column(n).to_numpy()
                for n in ("kind", "start", "shape", "anchor", "whole", "doc", *VERSION)
            )
            texts, earlier, carry, void = (
                rows.column(n) for n in ("text", "runs", "carry", "no_id")
            )
            out: list[list] = []
            taken: list[int] = []
            ends = np.flatnonzero(kind == TEXT)
            at = 0
            for place in [*ends.tolist(), len(kind)]:
                first = min(at, place)
                if first == len(kind):
                    break
                own = tuple(int(k[first]) for k in keys)
                if own != key:
                    key, runs, units = own, [], []
                if at < place:
                    is_run = kind[at:place] == REPEAT
                    runs.append(np.stack([start[at:place], whole[at:place]], 1)[is_run])
                    if not is_run.all():
                        units.append(np.stack([anchor[at:place], start[at:place], shape[at:place]], 1)[~is_run])
                if place == len(kind):
                    break
                at = place + 1
                out.append(self.one(key[0], void[place].as_py(), texts[place].as_py() or b"", runs, units, earlier[place].as_py()))
                taken.append(place)
            if out:
                yield self.rows(out, carry.take(pa.array(taken)))

    def one(self, doc, void, text: bytes, runs: list, units: list, earlier: bytes | None) -> list:
        # what repeated rows of one text share is put together once
        for held in (runs, units):
            if len(held) > 1:
                held[:] = [np.unique(np.concatenate(held), axis=0)]
        own = runs[0] if runs else np.zeros((0, 2), np.int64)
        if earlier:
            own = np.concatenate([own, np.frombuffer(earlier, np.int64).reshape(-1, 2)])
        doc_id = None if void else int(doc)
        if units and not self.settled:
            windows = (units[0][:, 2] >> 8) & 255
            open_ = [
                {"anchor": a, "start": s, "shape": h, "bytes": text[s : s + w + SPAN - 1]}
                for (a, s, h), w in zip(units[0].tolist(), windows.tolist())
            ]
            return [doc_id, None, None, None, None, None, None, text, own.tobytes(), open_]
        spans = spans_of(own)
        digest, kept, done = hashlib.sha256(), [], 0
        view = memoryview(text)
        for a, b in spans.tolist():
            kept.append(view[done:a])
            done = b
        kept.append(view[done:])
        for piece in kept:
            digest.update(piece)
        return [
            doc_id,
            len(text),
            int((spans[:, 1] - spans[:, 0]).sum()),
            len(spans),
            digest.hexdigest(),
            b"".join(kept).decode("utf-8", "ignore") if self.keep_text else None,
            [{"start": a, "end": b} for a, b in spans.tolist()] if self.keep_text else None,
            None,
            None,
            None,
        ]

    def rows(self, out: list, carry: pa.Array) -> pa.RecordBatch:
        kinds = [
            pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), SPANS,
            pa.binary(), pa.binary(), OPEN_UNITS,
        ]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "text", "runs", "units"]
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        if self.settled:
            arrays, names = arrays[:7], names[:7]
        return pa.RecordBatch.from_arrays([*arrays, carry], names=[*names, "carry"])


def crowded_anchors(docs: DataFrame) -> list[int]:
    """Anchors with over ``CROWDED`` units, judged by a fixed share of the documents.

    Each stands for over ``CROWDED`` / ``LOOKED_AT`` of the looked-at units, so the
    list is short; a missed one costs balance, not results.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOKED_AT)) == 0)
    counts = map_arrow(some.select("doc_id", "text"), sampled_anchors, "anchor long, n long")
    found = (
        counts.groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") * LOOKED_AT > CROWDED)
        .orderBy(F.desc("n"), "anchor")
        .limit(4096)
    )
    return [row.anchor for row in found.collect()]


def remove_repeats(
    docs: DataFrame, scratch: Scratch, keep_text: bool = True, carry: list[str] | None = None
) -> DataFrame:
    """Each row of ``docs`` without the bytes of ``SPAN``-byte strings that start earlier.

    Earlier: in a smaller doc_id, or at a smaller place of the same doc_id; a null
    doc_id is the smallest. All is judged on the input. Columns: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 (of the remaining bytes), kept (their text, without
    characters of which a part went) and spans (both null unless ``keep_text``), and ``carry``, a struct of the named further columns. Null texts
    are empty; texts under 100 bytes stay whole. Repeated rows get the same result
    each; rows that share a doc_id but not the text are versions of one document, and
    a string at a smaller place of either is the earlier one.
    """
    key = doc_key()
    shared = scratch.table(shared_ids(docs), "shared", keep=True)
    plain = versioned(docs.select("doc_id", key, "text"), shared)
    units = map_arrow(plain.select("doc_id", "text", *VERSION), FindUnits(crowded_anchors(docs)), UNITS)
    is_candidate = F.col("kind") == CANDIDATE
    settled = scratch.table(
        map_arrow(units.repartition("anchor"), settle, UNITS).select(
            "kind",
            "doc",
            *VERSION,
            "start",
            "shape",
            F.when(is_candidate, F.col("anchor")).otherwise(0).alias("anchor"),
            F.when(is_candidate, 0).otherwise(F.col("whole")).alias("whole"),
        ),
        "settled",
    )
    extra = [F.col(f"`{c}`") for c in carry or []]
    carried = F.struct(*(extra or [F.lit(None).cast("byte").alias("none")]))
    texts = docs.select(
        F.lit(TEXT).cast("byte").alias("kind"),
        key,
        F.lit(0).alias("start"),
        F.lit(0).cast("long").alias("shape"),
        F.lit(0).cast("long").alias("anchor"),
        F.lit(0).cast("long").alias("whole"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.lit(None).cast("binary").alias("runs"),
        carried.alias("carry"),
    )
    texts = versioned(texts, shared)
    kind_of_carry = texts.schema["carry"].dataType.simpleString()

    def cut(parts: DataFrame, settled: bool) -> DataFrame:
        schema = f"{DONE}{'' if settled else ', ' + OPEN}, carry {kind_of_carry}"
        return map_arrow(
            parts.repartition("doc", *VERSION).sortWithinPartitions("doc", *VERSION, "kind"),
            Cut(settled, keep_text),
            schema,
        )

    first = scratch.table(cut(settled.unionByName(texts, True), False), "cut", keep=True)
    opened = first.where("units IS NOT NULL")
    candidates = versioned(opened.select(key, "text", "units"), shared).select(
        "doc", *VERSION, F.explode("units").alias("u")
    )
    candidates = candidates.select("u.anchor", "doc", "u.start", "u.shape", *VERSION, "u.bytes")
    more = map_arrow(
        candidates.repartition("anchor").sortWithinPartitions("anchor"), compare, UNITS
    )
    rest = opened.select(
        F.lit(TEXT).cast("byte").alias("kind"),
        key,
        F.lit(0).alias("start"),
        F.lit(0).cast("long").alias("shape"),
        F.lit(0).cast("long").alias("anchor"),
        F.lit(0).cast("long").alias("whole"),
        F.col("doc_id").isNull().alias("no_id"),
        "text",
        "runs",
        "carry",
    )
    rest = versioned(rest, shared)
    more = more.select("kind", "doc", *VERSION, "start", "shape", F.lit(0).cast("long").alias("anchor"), "whole")
    second = cut(more.unionByName(rest, True), True)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "carry"]
    return first.where("units IS NULL").select(*names).unionByName(second.select(*names))


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` cut as ``remove_repeats`` says.

    Null texts become empty. A long column ``n_chars`` is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, scratch, carry=others)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if dict(docs.dtypes).get("n_chars") == "bigint":
        made["n_chars"] = F.length("kept").cast("long")
    return cut.select(*[made.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])
