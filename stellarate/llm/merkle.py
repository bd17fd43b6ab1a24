"""Merkle manifest of a documents table: block trees in van Emde Boas order, and proofs.

The leaves of a language stand in order of their ids. Every ``2 ** HEIGHT`` neighbours are
one block: a binary tree, stored as one array of digests in van Emde Boas order (a
tree is split at half its height; its top and then its bottom trees stand one after the
other, each laid out the same way). The roots of the blocks are the leaves of the next
tier of blocks, until a language has one block; the roots of the languages, in order of
their names, form a tree in the same manner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, Scratch, batch, join_unique, map_arrow
from stellarate.operators.ordered import numbered

#: A block has ``2 ** HEIGHT`` leaves at most.
HEIGHT = 8
DIGEST = 32
#: Ids whose crc32 this number divides are tampered with in the audit.
TAMPERED = 7
#: Rows of proofs passed on at a time.
ROWS = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a tree is made of. ``pos`` counts from 0 among the ``n`` rows of a ``key``.
NODE = "key string, pos long, n long, digest binary, name string, doc_id long, changed binary"
BLOCK = (
    "key string, block long, n long, rise int, root binary, nodes binary, "
    "entries array<struct<pos: long, digest: binary, name: string, doc_id: long, changed: binary>>"
)
PATHS = "key string, block long, name string, path binary, subroot binary"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


# ---- one block ----


@cache
def address(levels: int, depth: int, index: int) -> int:
    """Place of a node in a tree of ``levels`` levels in van Emde Boas order.

    ``depth`` is 0 at the root; ``index`` counts from the left of that depth.
    """
    if levels == 1:
        return 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = depth - top
    bottom = levels - top
    tree = index >> below
    inside = index & ((1 << below) - 1)
    return (1 << top) - 1 + tree * ((1 << bottom) - 1) + address(bottom, below, inside)


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: sha256 of their hex texts one after the other."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def rise_to_one(leaves: int) -> int:
    """Levels from ``leaves`` nodes up to a single one."""
    return (leaves - 1).bit_length()


class Tree:
    """The nodes of one block in van Emde Boas order; ``rise`` levels above the leaves."""

    def __init__(self, leaves: int, rise: int, nodes: bytes | bytearray | None = None) -> None:
        self.leaves, self.rise, self.levels = leaves, rise, rise + 1
        size = DIGEST * ((1 << self.levels) - 1)
        self.nodes = bytearray(size) if nodes is None else nodes

    def width(self, up: int) -> int:
        """Nodes that stand ``up`` levels above the leaves."""
        return (self.leaves + (1 << up) - 1) >> up

    def at(self, up: int, index: int) -> bytes:
        start = DIGEST * address(self.levels, self.rise - up, index)
        return bytes(self.nodes[start : start + DIGEST])

    def put(self, up: int, index: int, digest: bytes) -> None:
        start = DIGEST * address(self.levels, self.rise - up, index)
        self.nodes[start : start + DIGEST] = digest

    def fill(self, digests: list[bytes]) -> Tree:
        for index, digest in enumerate(digests):
            self.put(0, index, digest)
        for up in range(1, self.levels):
            below = self.width(up - 1)
            for index in range(self.width(up)):
                run = range(2 * index, min(2 * index + 2, below))
                self.put(up, index, joined([self.at(up - 1, child) for child in run]))
        return self

    @property
    def root(self) -> bytes:
        return self.at(self.rise, 0)

    def path(self, index: int) -> bytes:
        """Of each level, a byte (0: no sibling, 1: on the left, 2: on the right) and the sibling."""
        steps = []
        for up in range(self.rise):
            other = (index >> up) ^ 1
            if other >= self.width(up):
                steps.append(b"\0" + bytes(DIGEST))
            else:
                side = b"\1" if other < index >> up else b"\2"
                steps.append(side + self.at(up, other))
        return b"".join(steps)


def steps_of(path: bytes) -> Iterator[tuple[int, bytes]]:
    for start in range(0, len(path), DIGEST + 1):
        yield path[start], path[start + 1 : start + 1 + DIGEST]


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to by its path."""
    for side, other in steps_of(path):
        run = [digest] if side == 0 else [other, digest] if side == 1 else [digest, other]
        digest = joined(run)
    return digest


def proof_digest(path: bytes) -> str:
    return joined([other for side, other in steps_of(path) if side]).hex()


# ---- tiers of blocks ----


class Build:
    """Adds the tree over the entries of each block."""

    def __init__(self, height: int) -> None:
        self.height = height

    def __call__(self, batches: Batches) -> Batches:
        schema = pa.schema([("rise", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary())])
        for rows in batches:
            found: tuple[list, list, list] = ([], [], [])
            for n, entries in zip(rows.column("n").to_pylist(), rows.column("entries").to_pylist()):
                leaves = [e["digest"] for e in entries]
                # the only block of its key ends where one node is left
                rise = rise_to_one(n) if n <= 1 << self.height else self.height
                tree = Tree(len(leaves), rise).fill(leaves)
                for column, value in zip(found, (rise, tree.root, bytes(tree.nodes))):
                    column.append(value)
            own = batch(schema, *found)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("key", "block", "n")), *own.columns, rows.column("entries")],
                names=["key", "block", "n", "rise", "root", "nodes", "entries"],
            )


def tiers(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The blocks over ``nodes`` (columns ``NODE``), tier after tier, each a stored table."""
    out = []
    while True:
        blocks = nodes.groupBy("key", F.shiftright("pos", HEIGHT).alias("block")).agg(
            F.first("n").alias("n"),
            F.sort_array(
                F.collect_list(F.struct("pos", "digest", "name", "doc_id", "changed"))
            ).alias("entries"),
        )
        out.append(scratch.table(map_arrow(blocks, Build(HEIGHT), BLOCK), f"{name}-{len(out)}", keep=True))
        most = out[-1].agg(F.max("n")).first()[0]
        if most is None or most <= 1 << HEIGHT:
            return out
        nodes = out[-1].where(F.col("n") > 1 << HEIGHT).select(
            "key",
            F.col("block").alias("pos"),
            F.shiftright(F.col("n") + (1 << HEIGHT) - 1, HEIGHT).alias("n"),
            F.col("root").alias("digest"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("changed"),
        )


class Unfold:
    """Paths from the leaves of blocks to the root, given those of the blocks' own roots."""

    def entries(self, rows: pa.RecordBatch) -> Iterator[tuple]:
        for row in rows.to_pylist():
            tree = Tree(len(row["entries"]), row["rise"], row["nodes"])
            for index, entry in enumerate(row["entries"]):
                yield row, entry, tree.path(index) + row["path"]

    def pieces(self, batches: Batches) -> Iterator[list[tuple]]:
        held = []
        for rows in batches:
            for found in self.entries(rows):
                held.append(found)
                if len(held) == ROWS:
                    yield held
                    held = []
        if held:
            yield held


class Paths(Unfold):
    """Passes on (key, block, name, path, subroot) for the next lower tier.

    Below a language's root the subroot is known; in the ``crown`` the entries are the subroots.
    """

    def __init__(self, crown: bool) -> None:
        self.crown = crown

    def __call__(self, batches: Batches) -> Batches:
        schema = pa.schema(
            [("key", pa.string()), ("block", pa.int64()), ("name", pa.string()),
             ("path", pa.binary()), ("subroot", pa.binary())]
        )
        for held in self.pieces(batches):
            rows = [
                (
                    row["key"],
                    entry["pos"],
                    entry["name"],
                    path,
                    entry["digest"] if self.crown else row["subroot"],
                )
                for row, entry, path in held
            ]
            yield batch(schema, *[list(c) for c in zip(*rows)])


class Proofs(Unfold):
    """The proof of each leaf, and where the leaf that an auditor sees leads to."""

    def __init__(self, root: bytes) -> None:
        self.root = root

    def __call__(self, batches: Batches) -> Batches:
        schema = pa.schema(
            [("doc_id", pa.int64()), *[(c, pa.string()) for c in
             ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        )
        for held in self.pieces(batches):
            rows = []
            for row, entry, path in held:
                seen = fold(entry["changed"] or entry["digest"], path)
                rows.append(
                    (
                        entry["doc_id"],
                        entry["digest"].hex(),
                        row["subroot"].hex(),
                        self.root.hex(),
                        proof_digest(path),
                        seen.hex(),
                        seen == self.root,
                    )
                )
            yield batch(schema, *[list(c) for c in zip(*rows)])


# ---- the manifest ----


def field(value: Column) -> Column:
    written = value.cast("string")
    length = F.octet_length(written).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(length, F.lit(":"), written))


def leaf_digest(**values: Column) -> Column:
    columns = [values.get(name, F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, changed, row) of each document.

    ``key`` sorts as the languages do, null first; ``changed`` is the leaf after tampering
    with the document, null where it stays as it was; ``row`` tells equal documents apart.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("digest"),
        F.when(chosen & F.col("n_chars").isNotNull(), leaf_digest(n_chars=more)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


@dataclass(frozen=True)
class Manifest:
    """Stored blocks of the languages' trees and of the tree over their roots."""

    trees: list[DataFrame]
    crown: list[DataFrame]
    root: bytes | None


def manifest(docs: DataFrame, scratch: Scratch) -> Manifest:
    """The Merkle manifest of ``docs``; without rows its root is None.

    Leaves of one language ascend by doc_id (null first), equal ids by their digest, so
    repeated rows are leaves next to each other. All five columns may be null; a null
    language is one of its own, before the others. Other columns are not looked at.
    """
    leaves = scratch.table(leaves_of(docs), "leaves")
    placed = numbered(
        leaves, F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row"), name="place"
    )
    placed = scratch.table(placed.drop("row"), "placed")
    keys = placed.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    keys = scratch.table(keys, "keys")
    rows = placed.count()
    nodes = join_unique(placed, keys, "key", keys.select("key", "n"), rows).select(
        "key",
        (F.col("place") - F.col("first")).alias("pos"),
        "n",
        "digest",
        F.lit(None).cast("string").alias("name"),
        "doc_id",
        "changed",
    )
    trees = tiers(nodes, scratch, "tree")
    tops = [t.where(F.col("n") <= 1 << HEIGHT).select(F.col("key").alias("name"), "root") for t in trees]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = numbered(subroots, F.asc("name"), name="pos")
    count = keys.count()
    crown = tiers(
        subroots.select(
            F.lit("").alias("key"),
            "pos",
            F.lit(count).cast("long").alias("n"),
            F.col("root").alias("digest"),
            "name",
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("changed"),
        ),
        scratch,
        "crown",
    )
    top = crown[-1].select("root").first()
    return Manifest(trees, crown, bytes(top[0]) if top else None)


def with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    return blocks.join(above.select("key", "block", "path", "subroot"), ["key", "block"])


def proofs(made: Manifest, scratch: Scratch) -> DataFrame:
    """Every leaf with its proof and the audit of its tampered document (columns ``PROOFS``).

    Siblings are read from the stored blocks, from the top tier down; a block gets the
    path of its own root once, whatever its number of leaves.
    """
    spark = made.trees[0].sparkSession
    if made.root is None:
        return spark.createDataFrame([], PROOFS)
    none = F.lit(b"")
    above = made.crown[-1].select(
        "key", "block", none.alias("path"), F.lit(None).cast("binary").alias("subroot")
    )
    for blocks in reversed(made.crown):
        above = map_arrow(with_paths(blocks, above), Paths(crown=True), PATHS)
    langs = scratch.table(above, "lang-paths", keep=True)
    langs = langs.select(F.col("name").alias("key"), "path", "subroot")
    above = None
    for number in reversed(range(len(made.trees))):
        blocks = made.trees[number]
        tops = blocks.where(F.col("n") <= 1 << HEIGHT).select("key", "block").join(langs, "key")
        above = tops if above is None else tops.unionByName(above.select(*tops.columns))
        joined_up = with_paths(blocks, above)
        if number == 0:
            return map_arrow(joined_up, Proofs(made.root), PROOFS)
        above = scratch.table(map_arrow(joined_up, Paths(crown=False), PATHS), "paths", keep=True)
    raise AssertionError
