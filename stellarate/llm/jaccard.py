"""Near copies by word shingles: texts that share ``SIMILARITY`` of their five-word shingles.

A SimHash bounds the bits that differ, not the shingles that are shared, so texts of
a high Jaccard similarity can be many bits apart. Here every text has ``BANDS`` keys,
each of ``ROWS`` min-hashes of its shingle set: two texts of similarity s share a key
but for a share of (1 - s ** ROWS) ** BANDS, 3 in a million at 0.8. Only texts that
share a key with a different text are read again, with their whole shingle sets; what
meets under a key is compared exactly, and a task passes on only a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, Scratch, batch, map_arrow, sliced
from stellarate.llm.simhash import majority, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Texts of one key that are compared in one task; more are dealt to pairs of parts.
KEY_ROWS = 20_000

_rng = np.random.default_rng(8)
FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Matrix (text, band) of keys for groups of consecutive shingle hashes, none empty."""
    begins = np.cumsum(counts) - counts
    out = np.zeros((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        for factor, shift in zip(FACTORS[band], SHIFTS[band]):
            least = np.minimum.reduceat((hashes ^ shift) * factor, begins)
            out[:, band] = mixed(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = mixed(out[:, band] ^ np.uint64(band))
    return out


def grouped(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = [shingle_hashes(t, words) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return np.fromiter((h for own in hashes for h in own), np.uint64, counts.sum()), counts


def _keys(batches: Batches) -> Batches:
    """(digest, text) to (digest, keys); texts without words have none."""
    schema = pa.schema([("digest", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for rows in sliced(batches, 1):
        flat, counts = grouped(rows.column(1).to_pylist(), WORDS)
        some = np.flatnonzero(counts)
        if len(some):
            keys = band_keys(flat, counts[some]).view(np.int64)
            ends = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
            yield batch(
                schema,
                rows.column(0).take(pa.array(some)),
                pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
            )


def _sets(batches: Batches) -> Batches:
    """(digest, text) to (digest, fp, shingles): the SimHash, and the sorted shingle set."""
    schema = pa.schema([("digest", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary())])
    for rows in sliced(batches, 1):
        texts = rows.column(1).to_pylist()
        flat, counts = grouped(texts, 4)
        own = [np.unique(np.array(shingle_hashes(t, WORDS), np.uint64)).tobytes() for t in texts]
        yield batch(schema, rows.column(0), majority(flat, counts).view(np.int64), pa.array(own, pa.binary()))


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs that connect exactly the sets a chain of similar pairs connects.

    Each set is compared with all that follow, but not with those it is connected to.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.concatenate([sets[i] for i in order])
    ends = np.cumsum(size)
    label = np.arange(len(sets))
    found = []
    for i in range(len(sets) - 1):
        # sizes ascend, so only a stretch of them can be similar
        stop = int(np.searchsorted(size, size[i] / similarity + 1e-9, "right"))
        if stop <= i + 1 or (label[i + 1 : stop] == label[i]).all():
            continue
        mine, rest = flat[ends[i] - size[i] : ends[i]], flat[ends[i] : ends[stop - 1]]
        at = np.minimum(np.searchsorted(mine, rest), len(mine) - 1)
        common = np.add.reduceat((mine[at] == rest).astype(np.int64), ends[i : stop - 1] - ends[i])
        near = common >= similarity * (size[i] + size[i + 1 : stop] - common) - 1e-9
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((int(order[i]), int(order[j])))
    return found


def compare(batches: Batches) -> Batches:
    """Rows (key, x, y, fp, shingles) sorted by the first three to edges (a, b) of fingerprints."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(fps: list, sets: list) -> Batches:
        if len(sets) > 1:
            pairs = [(fps[i], fps[j]) for i, j in forest(sets) if fps[i] != fps[j]]
            if pairs:
                yield batch(schema, *map(list, zip(*pairs)))

    last, fps, sets = None, [], []
    for rows in batches:
        for *key, fp, shingles in zip(*(c.to_pylist() for c in rows.columns)):
            if key != last:
                yield from edges(fps, sets)
                last, fps, sets = key, [], []
            fps.append(fp)
            sets.append(np.frombuffer(shingles, np.uint64))
    yield from edges(fps, sets)


def links(docs: DataFrame, scratch: Scratch, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): edges between the SimHash fingerprints of texts of ``SIMILARITY`` or more.

    With the equality of fingerprints they connect whatever a chain of such texts connects.
    """
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("digest"), "text")
    keys = map_arrow(texts, _keys, "digest long, keys array<long>")
    keys = scratch.table(keys.dropDuplicates(["digest"]), "keys")
    rows = keys.select("digest", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = scratch.table(
        rows.join(shared, "key").select(
            "key", "digest", F.ceil(F.col("n") / F.lit(key_rows)).cast("int").alias("parts")
        ),
        "live",
    )
    again = texts.join(live.select("digest").distinct(), "digest", "left_semi")
    sets = map_arrow(again, _sets, "digest long, fp long, shingles binary")
    sets = scratch.table(sets.dropDuplicates(["digest"]), "sets")
    # every two parts of a crowded key meet in one task
    part = F.pmod("digest", "parts").cast("int")
    dealt = live.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    met = dealt.join(sets, "digest").select(
        "key",
        F.least("part", "other").alias("x"),
        F.greatest("part", "other").alias("y"),
        "fp",
        "shingles",
    )
    met = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return map_arrow(met, compare, "a long, b long").distinct()
