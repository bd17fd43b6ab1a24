"""Near copies among embeddings: robust-pruned graphs on overlapping shards, range searches.

Vectors of one label and length are a group. A group is split into overlapping cells about
centres; every cell is a shard, small enough for one task, on which a graph is built.
The edges of all shards are united per vector, and every vector is searched for in its
shards, from medoids outwards as far as the range goes. What is found is verified in
double precision, and the recall is measured against all vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.llm.cluster import Batches, Scratch, batch, join_unique, map_arrow, ship
from stellarate.llm.components import components
from stellarate.llm.vector_graph import BEAM, Graph, build, leaders, searchable

COSINE = 0.93
#: What single precision may take from a similarity.
BLUR = 1e-5
VECTORS = "vec_id long, grp string, code binary"
CELLS = "grp string, node long, n long, code binary, angle double"
FOUND = "a long, b long, links long"


@dataclass(frozen=True)
class Options:
    """``shard_rows``: a shard has twice as many vectors at most.
    ``cells``: most cells a group is split into at a time. ``sample``: vectors per cell, on
    average, that centres are fitted on. ``overlap``: cells that a vector is put into.
    ``part_rows``: vectors of a crowd, or of a group to split, that one task should get.
    ``levels``: times that a group is split; what is still large then is one shard.
    ``audited``: vectors whose links are compared with those to all vectors.
    ``least_recall``: below it, all is done again with twice the overlap and beam, up to ``tries`` times.
    """

    cosine: float = COSINE
    shard_rows: int = 1024
    cells: int = 256
    sample: int = 16
    overlap: int = 2
    beam: int = BEAM
    part_rows: int = 16_384
    levels: int = 4
    audited: int = 512
    least_recall: float = 0.97
    tries: int = 3

    @property
    def crowd(self) -> float:
        """Vectors within this angle of one point are all linked with each other."""
        return acos(self.cosine) / 2 - 1e-6


# ---- vectors ----


class Codes:
    """(vec_id, grp, code): the raw components; without grp where a vector links with nothing."""

    def __call__(self, batches: Batches) -> Batches:
        schema = pa.schema([("vec_id", pa.int64()), ("grp", pa.string()), ("code", pa.binary())])
        for rows in batches:
            groups, codes = [], []
            for label, vector in zip(rows.column("label").to_pylist(), rows.column("vector")):
                part = vector.values
                own = None if part is None or part.null_count else part.to_numpy(zero_copy_only=False)
                if label is None or own is None or not np.isfinite(own).all() or not own.any():
                    groups.append(None)
                    codes.append(None)
                else:
                    groups.append(f"{len(own)}:{label}")
                    codes.append(own.tobytes())
            yield batch(schema, rows.column("vec_id"), groups, codes)


def doubles(codes: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    held = codes.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(np.float64)


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; scaled first, so that no square is out of range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of the rows of unit vectors, pair by pair."""
    return np.einsum("nd,nd->n", left, right)


# ---- cells ----


def fit(kind: str, options: Options):
    """Centres of a group from a sample: leaders that are no crowd together, moved to their means."""

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        vectors = units(doubles(table["code"], kind))
        chosen = vectors[leaders(vectors, np.cos(options.crowd), table["cells"][0].as_py())]
        for _ in range(2):
            own = (vectors @ chosen.T).argmax(axis=1)
            sums = np.zeros_like(chosen)
            np.add.at(sums, own, vectors)
            moved = np.abs(sums).max(axis=1) > 1e-9
            chosen[moved] = units(sums[moved])
        return pa.table(
            {
                "grp": pa.array([table["grp"][0].as_py()], pa.string()),
                "centres": pa.array([chosen.tobytes()], pa.binary()),
                "parts": pa.array([table["parts"][0].as_py()], pa.int32()),
            }
        )

    return centres


def assign(kind: str, options: Options):
    """Puts each vector into the cells of its nearest centres.

    By the triangle inequality nothing in range of a vector is nearest to a centre that is
    farther from it than its own by twice the range; such a cell is left out.
    """

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("grp", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("code", pa.binary()),
             ("angle", pa.float64())]
        )
        if not left.num_rows:
            return schema.empty_table()
        vectors = units(doubles(left["code"], kind))
        centres = np.frombuffer(right["centres"][0].as_py()).reshape(-1, vectors.shape[1])
        like = vectors @ centres.T
        order = np.argsort(-like, axis=1, kind="stable")[:, : options.overlap]
        row = np.repeat(np.arange(len(vectors)), order.shape[1])
        cell = order.ravel()
        angle = np.arccos(np.clip(like[row, cell], -1, 1))
        kept = angle <= np.repeat(angle[:: order.shape[1]], order.shape[1]) + 2 * acos(options.cosine)
        row, cell, angle = row[kept], cell[kept], angle[kept]
        group = left["grp"][0].as_py()
        rows = left.select(["node", "n", "code"]).take(pa.array(row))
        named = pa.array([f"{group}/{c}" for c in cell.tolist()], pa.string())
        return pa.table([named, *rows.columns, pa.array(angle)], schema=schema)

    return cells


def sizes_of(rows: DataFrame, options: Options, last: bool) -> DataFrame:
    """(grp, rows, rest, state) of the cells; ``rest`` is what is no crowd about the centre.

    ``state``: small enough for one graph, ``dense`` if the crowd is at least half, or large.
    """
    crowd = F.coalesce(F.col("angle") <= options.crowd, F.lit(False))
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~crowd).alias("rest"))
    small = (F.col("rows") <= 2 * options.shard_rows) | F.lit(last)
    dense = 2 * F.col("rest") <= F.col("rows")
    return counts.withColumn("state", F.when(small, "small").when(dense, "dense").otherwise("large"))


def split(large: DataFrame, kind: str, options: Options, level: int) -> DataFrame:
    """The rows of large groups, with the sizes of these, dealt to cells."""
    cells = F.least(F.lit(options.cells), F.ceil(4 * F.col("rows") / options.shard_rows)).cast("int")
    parts = F.ceil(F.col("rows") / options.part_rows).cast("int")
    mine = large.select("grp", "node", "n", "code", "rows", cells.alias("cells"), parts.alias("parts"))
    draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) / (1 << 20)
    sample = mine.where(draw * F.col("rows") < options.sample * F.col("cells"))
    found = sample.select("grp", "node", "code", "cells", "parts").groupBy("grp").applyInArrow(
        fit(kind, options), "grp string, centres binary, parts int"
    )
    each = found.select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centres"
    )
    dealt = mine.select(
        "grp",
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        "node",
        "n",
        "code",
    )
    return dealt.groupBy("grp", "part").cogroup(each.groupBy("grp", "part")).applyInArrow(
        assign(kind, options), CELLS
    )


def shards(nodes: DataFrame, kind: str, options: Options, scratch: Scratch) -> DataFrame:
    """The cells, as (role, grp, node, n, code).

    Groups are split until every cell is small, or at least half of it a crowd about its centre.
    ``role``: ``plain`` in a small cell, or in the rest of a dense one, which is a cell of
    its own; ``crowd``; and ``beside`` for what of the rest may link with a crowd.
    """
    rows = nodes.select("grp", "node", "n", "code", F.lit(None).cast("double").alias("angle"))
    reach = acos(options.cosine) + options.crowd + 1e-6
    apart = F.coalesce(F.col("angle") > options.crowd, F.lit(True))
    rest_cell = F.concat("grp", F.lit("#"))
    cells = None
    for level in range(options.levels + 1):
        counts = scratch.table(sizes_of(rows, options, level == options.levels), f"cell-sizes-{level}")
        total = counts.agg(
            F.sum("rows"),
            F.count_if(F.col("state") == "large"),
            F.count_if(F.col("state") == "dense"),
        ).first()
        sizes = counts.select("grp", F.col("rows").alias("n"))
        sized = join_unique(rows, counts, "grp", sizes, total[0] or 0)

        def role(name: str, chosen, grp="grp") -> DataFrame:
            return sized.where(chosen).select(
                F.lit(name).alias("role"), F.expr(grp).alias("grp"), "node", "n", "code"
            )

        dense, fits = F.col("state") == "dense", F.col("rest") <= 2 * options.shard_rows
        found = role("plain", "state = 'small'")
        if total[2]:
            found = (
                found.unionByName(role("crowd", dense & ~apart))
                .unionByName(role("beside", dense & apart & (F.col("angle") <= reach)))
                .unionByName(role("plain", dense & apart & fits, "concat(grp, '#')"))
            )
        cells = found if cells is None else cells.unionByName(found)
        again = sized.where(dense & apart & ~fits).select(
            rest_cell.alias("grp"), "node", "n", "code", F.lit(None).cast("double").alias("angle")
        )
        more = counts.where(dense & ~fits).limit(1).count() if total[2] else 0
        if not total[1] and not more:
            break
        rows = again
        if total[1]:
            large = sized.where("state = 'large'")
            rows = rows.unionByName(split(large, kind, options, level))
        rows = scratch.table(rows, f"cells-{level}")
    return cells


# ---- graphs ----


def edges_of(kind: str, options: Options):
    """The edges of a shard's graph, both ways."""

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        source, target = build(units(doubles(table["code"], kind)).astype(np.float32), beam=options.beam).outgoing()
        grp = table["grp"][0].as_py()
        lists = [node[target[a:b]] for a, b in _runs(source, len(node))]
        return pa.table(
            {
                "node": pa.array(node),
                "near": pa.array(lists, pa.list_(pa.int64())),
                "shard": pa.array([grp] * len(node), pa.string()),
            }
        )

    return edges


def _runs(source: np.ndarray, count: int):
    ends = np.searchsorted(source, np.arange(count + 1))
    return zip(ends[:-1].tolist(), ends[1:].tolist())


def local_graph(node: np.ndarray, near: list, vectors: np.ndarray) -> Graph:
    """The united edges among the vectors of a shard; ``node`` ascends."""
    source = np.repeat(np.arange(len(node)), [len(x) for x in near])
    target = np.concatenate([np.asarray(x, np.int64) for x in near])
    at = np.minimum(np.searchsorted(node, target), len(node) - 1)
    here = node[at] == target
    return searchable(vectors.astype(np.float32), source[here], at[here])


def found_rows(a: list, b: list, links: list) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip((a, b, links), kinds)], names=["a", "b", "links"])


def spanning(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest number that each of ``count`` nodes is connected to by pairs (both ways)."""
    low = np.arange(count)
    while True:
        next_low = low.copy()
        np.minimum.at(next_low, a, low[b])
        next_low = next_low[next_low]
        if (next_low == low).all():
            return low
        low = next_low


def search(kind: str, options: Options):
    """Range searches for every vector of a shard, verified: links per vector and spanning edges.

    A pair that several shards hold counts in the first of them.
    """

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        vectors = units(doubles(table["code"], kind))
        graph = local_graph(node, table["near"].to_pylist(), vectors)
        query, other = graph.within(graph.vectors, options.cosine - BLUR, options.beam)
        true = query != other
        for start in range(0, len(query), 1 << 16):
            cut = slice(start, start + (1 << 16))
            true[cut] &= cosines(vectors[query[cut]], vectors[other[cut]]) >= options.cosine
        query, other = query[true], other[true]
        count = np.int64(len(node))
        pairs = np.unique(np.concatenate([query * count + other, other * count + query]))
        a, b = pairs // count, pairs % count
        low = spanning(a, b, len(node))
        moved = np.flatnonzero(low != np.arange(len(node)))
        grp = table["grp"][0].as_py()
        earlier: dict[str, list[int]] = {}
        for row, held in enumerate(table["shards"].to_pylist()):
            for name in held:
                if name < grp:
                    earlier.setdefault(name, []).append(row)
        own = np.ones(len(a), bool)
        for members in earlier.values():
            there = np.zeros(len(node), bool)
            there[members] = True
            own &= ~(there[a] & there[b])
        weight = np.zeros(len(node), np.int64)
        np.add.at(weight, a[own], n[b[own]])
        return found_rows(
            np.concatenate([node, node[moved]]).tolist(),
            [None] * len(node) + node[low[moved]].tolist(),
            weight.tolist() + [None] * len(moved),
        )

    return links


def crowd_links(kind: str, options: Options):
    """Links of a part of a crowd: with each other by their angles, with what is beside by comparing."""

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return found_rows([], [], [])
        weight, hub, column = (left[c][0].as_py() for c in ("weight", "hub", "column"))
        node, n = left["node"].to_numpy(), left["n"].to_numpy()
        links_of = weight - n if column == 0 else np.zeros(len(node), np.int64)
        a, b, counts = [], [], []
        if right.num_rows:
            vectors = units(doubles(left["code"], kind))
            rest, rest_n = right["node"].to_numpy(), right["n"].to_numpy()
            others = units(doubles(right["code"], kind))
            near = np.zeros(len(rest), np.int64)
            first = np.full(len(rest), -1, np.int64)
            # a pair of two crowds is met in both cells, if both are in both: the first one counts it
            grp, homes = left["grp"][0].as_py(), right["home"].to_pylist()
            held = left["held"].to_pylist()
            doubled = [
                (np.array([h == home for h in homes]), np.array([home in x for x in held]))
                for home in sorted({h for h in homes if h is not None and h < grp})
            ]
            for start in range(0, len(node), 1024):
                cut = slice(start, start + 1024)
                link = vectors[cut] @ others.T >= options.cosine
                for columns, there in doubled:
                    link[np.ix_(there[cut], columns)] = False
                links_of[cut] += link @ rest_n
                near += n[cut] @ link
                some = link.any(axis=0) & (first < 0)
                first[some] = node[cut][link[:, some].argmax(axis=0)]
            joined = near > 0
            a, b, counts = rest[joined].tolist(), first[joined].tolist(), near[joined].tolist()
        whole = len(node)
        return found_rows(
            [*node.tolist(), *node.tolist(), *a, *a],
            [*[None] * whole, *[hub] * whole, *[None] * len(a), *b],
            [*links_of.tolist(), *[None] * whole, *counts, *[None] * len(a)],
        )

    return links


def found_links(nodes: DataFrame, kind: str, options: Options, scratch: Scratch) -> DataFrame:
    """(a, b, links): without b, the weight of vectors linked with a that one shard counts; else an edge."""
    cells = scratch.table(shards(nodes, kind, options, scratch), "members")
    crowded = cells.where("role = 'crowd'").limit(1).count()
    if crowded:
        # one of a crowd belongs to one crowd, and is beside the others that it is in
        homes = cells.where("role != 'plain'").groupBy("node").agg(
            F.min(F.when(F.col("role") == "crowd", F.col("grp"))).alias("home"),
            F.collect_set("grp").alias("held"),
        )
        cells = cells.join(homes, "node", "left").where("home is null or role != 'plain'")
        moved = (F.col("role") == "crowd") & (F.col("home") != F.col("grp"))
        cells = cells.withColumn("role", F.when(moved, "beside").otherwise(F.col("role")))
        cells = scratch.table(cells, "members-once")
    plain = cells.where("role = 'plain'").select("grp", "node", "n", "code")
    edges = plain.select("grp", "node", "code").groupBy("grp").applyInArrow(
        edges_of(kind, options), "node long, near array<long>, shard string"
    )
    united = edges.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        F.sort_array(F.collect_list("shard")).alias("shards"),
    )
    united = scratch.table(united, "graph")
    found = plain.join(united, "node").groupBy("grp").applyInArrow(search(kind, options), FOUND)
    if crowded:
        found = found.unionByName(crowds(cells, kind, options, scratch))
    return scratch.table(found, "found")


def crowds(cells: DataFrame, kind: str, options: Options, scratch: Scratch) -> DataFrame:
    """Links of crowds with themselves and with what is beside them, in parts of bounded size."""
    crowd = F.col("role") == "crowd"
    pieces = F.greatest(F.lit(1), F.ceil(F.count_if(crowd) / options.part_rows)).cast("int")
    columns = F.greatest(F.lit(1), F.ceil(F.count_if(~crowd) / options.part_rows)).cast("int")
    members = cells.where("role != 'plain'")
    sizes = members.groupBy("grp").agg(
        F.count(F.lit(1)).alias("size"),
        pieces.alias("pieces"),
        columns.alias("columns"),
        F.sum(F.when(crowd, F.col("n"))).alias("weight"),
        F.min(F.when(crowd, F.col("node"))).alias("hub"),
    )
    sizes = scratch.table(sizes, "crowds")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    counts = sizes.select("grp", F.col("size").alias("n"))
    placed = join_unique(members, sizes, "grp", counts, total)

    def part(of: str):
        return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    placed = scratch.table(placed, "crowd-parts")
    left = placed.where(crowd).select(
        "grp", part("pieces").alias("piece"), every("columns").alias("column"), "node", "n", "code", "weight", "hub", "held"
    )
    right = placed.where(~crowd).select(
        "grp", every("pieces").alias("piece"), part("columns").alias("column"), "node", "n", "code", "home"
    )
    keys = ["grp", "piece", "column"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(crowd_links(kind, options), FOUND)


# ---- audit ----


class Compared:
    """Weight of the vectors of a batch linked with each audited one, all compared."""

    def __init__(self, audited, kind: str, cosine: float) -> None:
        self.audited, self.kind, self.cosine = audited, kind, cosine

    def __call__(self, batches: Batches) -> Batches:
        asked: dict[str, tuple] = self.audited.value
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
        for rows in batches:
            groups = np.array(rows.column("grp").to_pylist(), object)
            node, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            for grp in sorted(set(groups) & set(asked)):
                some = np.flatnonzero(groups == grp)
                own = units(doubles(rows.column("code").take(pa.array(some)), self.kind))
                ids, vectors = asked[grp]
                link = vectors @ own.T >= self.cosine
                link &= ids[:, None] != node[some][None, :]
                yield batch(schema, ids, link @ n[some])


def recall(nodes: DataFrame, counts: DataFrame, kind: str, options: Options) -> float:
    """Share of the links of ``options.audited`` vectors that were found, weighted as they count.

    The vectors are those with the smallest hash; they are compared with all others.
    """
    order = [F.xxhash64("node", F.lit(options.audited)), "node"]
    chosen = nodes.orderBy(*order).limit(options.audited).select("grp", "node", "code").collect()
    asked = {}
    for grp in sorted({r.grp for r in chosen}):
        own = [r for r in chosen if r.grp == grp]
        asked[grp] = (
            np.array([r.node for r in own], np.int64),
            units(doubles(pa.array([bytes(r.code) for r in own]), kind)),
        )
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    compared = map_arrow(
        nodes.select("grp", "node", "n", "code"), Compared(shared, kind, options.cosine), "node long, links long"
    )
    true = {r.node: r.all for r in compared.groupBy("node").agg(F.sum("links").alias("all")).collect()}
    shared.destroy()
    ids = [r.node for r in chosen]
    found = {r.node: r.links for r in counts.where(F.col("node").isin(ids)).collect()}
    total = sum(true.values())
    return sum(min(found.get(i, 0), true.get(i, 0)) for i in ids) / total if total else 1.0


# ---- the operator ----


def linked(embeddings: DataFrame, scratch: Scratch, options: Options = Options()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null, they are equally long and their
    cosine is at least ``options.cosine``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Equal vectors are one node with a weight, so
    copies are counted and never expanded. A null vec_id lends no id to its component, which is null
    if it has no other; repeated ids and rows are vectors by themselves. ``kept``: vec_id and
    component_id are the same. No rows give no rows; other columns are not looked at.

    Raises if the measured recall stays below ``options.least_recall``.
    """
    ship(embeddings.sparkSession)
    single = embeddings.schema["embedding"].dataType.elementType == T.FloatType()
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    plain = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(f"array<{element}>").alias("vector"),
    )
    coded = map_arrow(plain, Codes(), VECTORS)
    key = F.when(F.col("code").isNotNull(), F.unhex(F.sha2(F.concat("grp", F.lit("|"), "code"), 256)))
    coded = scratch.table(coded.withColumn("key", key), "coded")
    nodes = coded.where("key is not null").groupBy("key").agg(
        F.first("grp").alias("grp"),
        F.first("code").alias("code"),
        F.count(F.lit(1)).alias("n"),
        F.min("vec_id").alias("low"),
    )
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total, rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    for attempt in range(options.tries):
        found = found_links(nodes, kind, options, scratch)
        counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        counts = scratch.table(counts, "counts")
        reached = recall(nodes, counts, kind, options)
        if reached >= options.least_recall:
            break
        options = replace(options, overlap=2 * options.overlap, beam=2 * options.beam)
    else:
        raise RuntimeError(f"recall {reached:.3f} after {options.tries} tries")
    roots = components(found.where("b is not null").select("a", "b"), scratch)
    member = nodes.select("node", "key", "n", "low").join(roots, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    member = scratch.table(member, "members-of-components")
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = join_unique(
        member,
        lows.select("root", "component_id"),
        "root",
        lows.select("root", F.col("m").alias("n")),
        total,
    )
    own = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    named = scratch.table(
        named.select("key", own.alias("n_links"), "component_id"), "named"
    )
    sizes = nodes.select("key", "n")
    joined = join_unique(coded.where("key is not null"), named, "key", sizes, rows)
    alone = coded.where("key is null").select(
        "key", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = joined.select("vec_id", "n_links", "component_id").unionByName(alone.drop("key"))
    return scratch.table(
        both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "linked", keep=True
    )
