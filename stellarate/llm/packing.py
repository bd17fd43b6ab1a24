"""Best-fit packing of token ids into sequences: bounded-space online best fit.

Each task packs the documents it reads, in one pass and without a shuffle. It holds a
fixed number of open sequences in a bitset keyed by free space: bit f is set if some
open sequence has f tokens free. A piece goes to the fullest sequence that takes it,
the lowest bit not below its length; when a sequence must be opened and none may be
added, the fullest closes first. Within one Arrow batch long pieces go first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stellarate.llm.cluster import Batches, map_arrow
from stellarate.llm.tokens import encode_column

CAPACITY = 4096
OPEN = 2048
END_ID = 1
#: Pieces passed on at once, by their ids' bytes.
BYTES_AT_ONCE = 4 << 20

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
COLUMNS = (
    "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
)


class OpenSequences:
    """At most ``most`` open sequences of ``capacity`` tokens, numbered from ``first``."""

    def __init__(self, capacity: int, most: int, first: int = 0) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.next, self.capacity
            self.next += 1
        rest = free - length
        if rest:
            self.by_free.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


class Pack:
    def __init__(self, path: str, capacity: int, most: int, end_id: int) -> None:
        self.path, self.capacity, self.most, self.end_id = path, capacity, most, end_id

    def __call__(self, batches: Batches) -> Batches:
        task = TaskContext.get()
        sequences = OpenSequences(
            self.capacity, self.most, (task.partitionId() if task else 0) << 40
        )
        for rows in batches:
            ids_of, doc, piece, start = [], [], [], []
            held = 0
            for place, ids in enumerate(encode_column(self.path, rows.column(1), self.end_id)):
                for number, at in enumerate(range(0, len(ids), 4 * self.capacity)):
                    ids_of.append(ids[at : at + 4 * self.capacity])
                    doc.append(place)
                    piece.append(number)
                    start.append(at // 4)
                held += len(ids)
                if held > BYTES_AT_ONCE:
                    yield self.packed(rows, sequences, ids_of, doc, piece, start)
                    ids_of, doc, piece, start = [], [], [], []
                    held = 0
            if doc:
                yield self.packed(rows, sequences, ids_of, doc, piece, start)

    def packed(self, rows, sequences, ids_of, doc, piece, start) -> pa.RecordBatch:
        length = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        number, offset = np.empty_like(length), np.empty_like(length)
        for at in np.argsort(-length, kind="stable").tolist():
            number[at], offset[at] = sequences.place(int(length[at]))
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(doc)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length),
                pa.array(number),
                pa.array(offset),
                pa.array(ids_of, pa.binary()),
            ],
            schema=SCHEMA,
        )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    open_sequences: int = OPEN,
    end_id: int = END_ID,
) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text), placed in sequences.

    Columns: doc_id, piece (from 0), start (the document's ids before it), length,
    sequence_id, offset (in the sequence, without gaps from 0) and ids
    (little-endian 32-bit). ``tokenizer`` is the path of the tokenizer file. Each
    text is followed by ``end_id``, so null and empty texts give one piece of one id;
    only texts of more than ``capacity`` ids are cut. Null and repeated doc_ids are
    packed like others; no rows give no rows; other columns are not looked at.
    """
    return map_arrow(
        docs.select("doc_id", "text"),
        Pack(tokenizer, capacity, open_sequences, end_id),
        COLUMNS,
        keeps_caches=True,
    )
