"""Token files of directly addressable codes.

An id is split into 8-bit chunks. Level k holds chunk k of every id that has one, as
bytes, with a bitmap that says which of them go on in level k + 1, and a rank
directory: the set bits before each block of 512. The chunk of any token in the next
level is found by its rank, so any token is read without decoding its neighbours.

A shard is one binary value of a Parquet table, which Spark's committed writer puts in
the shared folder; beside it stand the documents it holds. Layout of the binary value,
little-endian: ``DAC1``, ids (u64), levels (u32); then for each level entries (u64),
the chunks, padding to 8 bytes, bitmap words (u64 each, lowest bit first) and one u64
of set bits before each block of 8 words. The last level has no bitmap.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, map_arrow
from stellarate.llm.tokens import encode_column

END_ID = 2
#: Ids of a shard; it holds whole documents and closes once it has as many.
SHARD_IDS = 1 << 20
BLOCK_WORDS = 8
MAGIC = b"DAC1"

SHARDS = "part int, first long, n_ids long, doc_ids array<long>, sizes array<long>, codes binary"


# ---- codes ----


def bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a bitmap, and the set bits before each block of words."""
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(-(-len(bits) // 64), np.uint64)
    words.view(np.uint8)[: len(packed)] = packed
    counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])
    return words, counts[:-1:BLOCK_WORDS].astype(np.uint64)


def write_codes(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk = (rest & 255).astype(np.uint8)
        more = rest > 255
        body = chunk.tobytes() + bytes(-len(chunk) % 8)
        levels.append(struct.pack("<Q", len(chunk)) + body)
        if not more.any():
            break
        words, ranks = bitmap(more)
        levels[-1] += words.tobytes() + ranks.tobytes()
        rest = rest[more] >> np.uint32(8)
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """Random access to the ids of one shard."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.count, levels = struct.unpack_from("<QI", data, 4)
        at = 16
        self.chunks, self.words, self.ranks = [], [], []
        for level in range(levels):
            (entries,) = struct.unpack_from("<Q", data, at)
            at += 8
            self.chunks.append(np.frombuffer(data, np.uint8, entries, at))
            at += entries + -entries % 8
            if level < levels - 1:
                words = -(-entries // 64)
                self.words.append(np.frombuffer(data, np.uint64, words, at))
                at += 8 * words
                blocks = -(-words // BLOCK_WORDS)
                self.ranks.append(np.frombuffer(data, np.uint64, blocks, at))
                at += 8 * blocks

    def rank(self, level: int, index: np.ndarray) -> np.ndarray:
        """Set bits before each place of a level's bitmap."""
        words, ranks = self.words[level], self.ranks[level]
        word = index >> 6
        block = word // BLOCK_WORDS
        out = ranks[block].astype(np.int64)
        for step in range(BLOCK_WORDS):
            inner = block * BLOCK_WORDS + step
            before = inner < word
            out[before] += np.bitwise_count(words[inner[before]])
        mask = (np.uint64(1) << (index & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[word] & mask)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        index = np.asarray(places, np.int64)
        out = np.zeros(len(index), np.uint32)
        rows = np.arange(len(index))
        for level, chunk in enumerate(self.chunks):
            out[rows] |= chunk[index].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.words):
                break
            bit = self.words[level][index >> 6] >> (index & 63).astype(np.uint64)
            on = (bit & np.uint64(1)).astype(bool)
            rows, index = rows[on], self.rank(level, index[on])
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of one stretch: a rank per level, then consecutive chunks."""
        out = np.zeros(stop - start, np.uint32)
        rows = np.arange(stop - start)
        for level, chunk in enumerate(self.chunks):
            out[rows] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.words) or start == stop:
                break
            words = self.words[level][start >> 6 : ((stop - 1) >> 6) + 1]
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")
            on = bits[start & 63 : (start & 63) + stop - start].astype(bool)
            rows = rows[on]
            start = int(self.rank(level, np.array([start]))[0])
            stop = start + len(rows)
        return out


# ---- writing ----


class Tokenize:
    """Texts to (part, doc_id, width, ids), ids in 2 bytes each where all of them fit."""

    def __init__(self, path: str, end_id: int, borders: list[int]) -> None:
        self.path, self.end_id, self.borders = path, end_id, np.array(borders, np.int64)

    def __call__(self, batches: Batches) -> Batches:
        for rows in batches:
            ids, doc = rows.column(1), rows.column(0)
            known = doc.fill_null(-(1 << 63)).to_numpy()
            part = np.searchsorted(self.borders, known, "right").astype(np.int32)
            coded, width = [], []
            for own in encode_column(self.path, ids, self.end_id):
                wide = np.frombuffer(own, "<u4")
                small = wide.max() < 1 << 16
                coded.append(wide.astype("<u2").tobytes() if small else own)
                width.append(2 if small else 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), doc, pa.array(width, pa.int8()), pa.array(coded, pa.binary())],
                names=["part", "doc_id", "width", "ids"],
            )


def shards(batches: Batches) -> Batches:
    """Documents in order to shards; ``first`` counts a part's ids before the shard."""
    part, first, held, docs, total = None, 0, [], [], 0

    def close() -> pa.RecordBatch:
        sizes = [len(h) for h in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([total], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([write_codes(np.concatenate(held))], pa.binary()),
            ],
            names=["part", "first", "n_ids", "doc_ids", "sizes", "codes"],
        )

    for rows in batches:
        own, names = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        for at, doc, width, ids in zip(own, names, rows.column(2).to_pylist(), rows.column(3)):
            if held and (at != part or total >= SHARD_IDS):
                yield close()
                first, held, docs, total = first + total, [], [], 0
            if at != part:
                part, first = at, 0
            held.append(np.frombuffer(ids.as_buffer(), f"<u{width}"))
            docs.append(doc)
            total += len(held[-1])
    if held:
        yield close()


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) as shards under ``path``.

    Documents are dealt to parts of consecutive doc_ids, a few for each shuffle
    partition; a part is written in ascending order by one task. A null doc_id comes
    first, null texts are empty, rows of one doc_id follow each other by their ids.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / parts for i in range(1, parts)]
    borders = docs.select("doc_id").approxQuantile("doc_id", quantiles, 1 / (8 * parts))
    coded = map_arrow(
        docs.select("doc_id", "text"),
        Tokenize(tokenizer, end_id, sorted({int(b) for b in borders})),
        "part int, doc_id long, width byte, ids binary",
        keeps_caches=True,
    )
    ordered = coded.repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    map_arrow(ordered, shards, SHARDS, keeps_caches=True).write.parquet(path)


# ---- reading ----


class Read:
    def __init__(self, before: dict[int, int]) -> None:
        self.before = before

    def documents(self, rows: pa.RecordBatch, at: int) -> Iterator[tuple]:
        part, first, _, docs, sizes, data = (c[at].as_py() for c in rows.columns)
        codes, place = Codes(data), 0
        for doc, size in zip(docs, sizes):
            ids = codes.slice(place, place + size)
            yield doc, self.before[part] + first + place, size, ids
            place += size

    def __call__(self, batches: Batches) -> Batches:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for rows in batches:
            for at in range(rows.num_rows):
                found = [
                    (doc, start, size, zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc, start, size, ids in self.documents(rows, at)
                ]
                arrays = [pa.array(list(c), pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards under ``path``.

    The driver gets one number per part (a few for each shuffle partition).
    """
    found = spark.read.schema(SHARDS).parquet(path)
    totals = found.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, ids = {}, 0
    for part, n in totals:
        before[part] = ids
        ids += n
    return map_arrow(found, Read(before), "doc_id long, start long, n_tokens long, ids_crc32 long", True)
