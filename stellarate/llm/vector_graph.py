"""A robust-pruned neighbour graph over unit vectors, and searches on many queries at once.

Adjacency is one array: row i has the neighbours of vector i, filled up with -1.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a vector, and candidates among which they are chosen.
DEGREE = 24
CANDIDATES = 64
#: How much closer a chosen neighbour must be to a candidate to make it superfluous.
ALPHA = 1.2
#: Vectors that a search keeps in view.
BEAM = 32
#: Medoids that searches start from, and the similarity from which two would be too close.
MEDOIDS = 32
APART = 0.9
#: Queries searched together, and (query, vector) pairs looked at together.
QUERIES = 256
PAIRS = 1 << 17


def leaders(vectors: np.ndarray, least: float, most: int) -> np.ndarray:
    """Up to ``most`` vectors, in order, of which no two have a similarity of ``least``."""
    chosen: list[int] = []
    near = np.full(len(vectors), -np.inf)
    while len(chosen) < most:
        far = np.flatnonzero(near < least)
        if not len(far):
            break
        chosen.append(int(far[0]))
        near = np.maximum(near, vectors @ vectors[far[0]])
        near[far[0]] = np.inf
    return np.array(chosen, np.int64)


def medoids(vectors: np.ndarray, least: float, most: int = MEDOIDS) -> np.ndarray:
    """For each cluster of ``vectors`` about a leader, the vector closest to its mean."""
    own = (vectors @ vectors[leaders(vectors, least, most)].T).argmax(axis=1)
    found = []
    for cluster in np.unique(own):
        some = np.flatnonzero(own == cluster)
        found.append(some[np.argmax(vectors[some] @ vectors[some].mean(axis=0))])
    return np.array(found, np.int64)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` of the candidates ``found`` (a row per node, -1: none) for each node.

    The closest candidate is taken and those that it is closer to than the node is, by the
    factor ``ALPHA``, are dropped; so again with what is left.
    """
    count = len(nodes)
    pool = vectors[found]
    alive = (found >= 0) & (found != nodes[:, None])
    own = 1 - np.einsum("bd,bcd->bc", vectors[nodes], pool)
    between = 1 - np.einsum("bcd,bed->bce", pool, pool)
    out = np.full((count, degree), -1, np.int64)
    every = np.arange(count)
    for place in range(degree):
        distance = np.where(alive, own, np.inf)
        best = distance.argmin(axis=1)
        taken = alive[every, best]
        if not taken.any():
            break
        out[taken, place] = found[every, best][taken]
        covered = ALPHA * between[every, best] < own
        alive &= ~(covered & taken[:, None])
        alive[every, best] = False
    return out


def widest(found: list[np.ndarray], width: int) -> np.ndarray:
    """Lists of numbers as rows of one array, filled up with -1."""
    out = np.full((len(found), width), -1, np.int64)
    for row, some in enumerate(found):
        out[row, : min(width, len(some))] = some[:width]
    return out


class Graph:
    def __init__(
        self,
        vectors: np.ndarray,
        starts: np.ndarray,
        neighbours: np.ndarray,
        offsets: np.ndarray | None = None,
        edges: np.ndarray | None = None,
    ) -> None:
        self.vectors, self.starts, self.neighbours = vectors, starts, neighbours
        self.offsets, self.edges = offsets, edges

    def beam(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search from the medoids: the ``beam`` best vectors of each query, and who was seen."""
        count, every = len(queries), np.arange(len(queries))
        seen = np.zeros((count, len(self.vectors)), bool)
        best = np.full((count, beam), -1, np.int64)
        like = np.full((count, beam), -np.inf, self.vectors.dtype)
        done = np.ones((count, beam), bool)
        seen[:, self.starts] = True
        first = queries @ self.vectors[self.starts].T
        order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
        width = order.shape[1]
        best[:, :width] = self.starts[order]
        like[:, :width] = first[every[:, None], order]
        done[:, :width] = False
        while True:
            at = np.where(done, -np.inf, like).argmax(axis=1)
            active = np.flatnonzero(~done[every, at])
            if not len(active):
                return best, seen
            node = best[active, at[active]]
            done[active, at[active]] = True
            near = self.neighbours[node]
            new = (near >= 0) & ~seen[active[:, None], near]
            seen[np.repeat(active, new.sum(axis=1)), near[new]] = True
            close = np.einsum("bd,brd->br", queries[active], self.vectors[near])
            close[~new] = -np.inf
            all_like = np.concatenate([like[active], close], axis=1)
            all_node = np.concatenate([best[active], near], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            order = np.argsort(-all_like, axis=1, kind="stable")[:, :beam]
            rows = np.arange(len(active))[:, None]
            like[active], best[active] = all_like[rows, order], all_node[rows, order]
            done[active] = all_done[rows, order] | (like[active] == -np.inf)

    def within(self, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs with a similarity of ``least`` that a range search finds.

        A greedy search leads to each query; from there the search goes on to all neighbours
        of what is in range, until nothing new is.
        """
        pairs = []
        for start in range(0, len(queries), QUERIES):
            some = queries[start : start + QUERIES]
            best, seen = self.beam(some, beam)
            row, place = np.nonzero(best >= 0)
            node = best[row, place]
            while len(row):
                inside = self.likeness(some, row, node) >= least
                row, node = row[inside], node[inside]
                pairs.append((row + start, node))
                row, node = self.around(row, node, seen, best if place is not None else None)
                place = None
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*pairs))

    def outgoing(self) -> tuple[np.ndarray, np.ndarray]:
        """All edges as (source, target)."""
        source, place = np.nonzero(self.neighbours >= 0)
        return source, self.neighbours[source, place]

    def likeness(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), self.vectors.dtype)
        for a in range(0, len(row), PAIRS):
            cut = slice(a, a + PAIRS)
            out[cut] = np.einsum("pd,pd->p", queries[row[cut]], self.vectors[node[cut]])
        return out

    def around(
        self, row: np.ndarray, node: np.ndarray, seen: np.ndarray, first: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of ``node``, both ways, that query ``row`` has not looked at.

        After the greedy search, what it saw but did not keep counts as not looked at.
        """
        if first is not None:
            seen[:] = False
            kept, place = np.nonzero(first >= 0)
            seen[kept, first[kept, place]] = True
        rows, nodes = [], []
        degree = np.diff(self.offsets)[node]
        cuts = np.searchsorted(np.cumsum(degree), np.arange(PAIRS, degree.sum() + PAIRS, PAIRS), "right")
        for a, b in zip([0, *cuts], [*cuts, len(node)]):
            size = degree[a:b]
            if not size.sum():
                continue
            begin = np.cumsum(size) - size
            near = self.edges[np.arange(size.sum()) + np.repeat(self.offsets[node[a:b]] - begin, size)]
            own = np.repeat(row[a:b], size)
            new = ~seen[own, near]
            key = np.unique(own[new] * np.int64(seen.shape[1]) + near[new])
            own, near = key // seen.shape[1], key % seen.shape[1]
            seen[own, near] = True
            rows.append(own)
            nodes.append(near)
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (none, none)


def both_ways(source: np.ndarray, target: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ``count`` nodes, taken in both directions: the list of each node, one after the other."""
    key = np.unique(np.concatenate([source * np.int64(count) + target, target * np.int64(count) + source]))
    node = key // count
    return np.searchsorted(node, np.arange(count + 1)), key % count


def searchable(vectors: np.ndarray, source: np.ndarray, target: np.ndarray) -> Graph:
    """The graph of some edges: greedy search goes by at most two ``DEGREE`` of a node's edges."""
    offsets, edges = both_ways(source, target, len(vectors))
    neighbours = np.full((len(vectors), 2 * DEGREE), -1, np.int64)
    place = np.arange(len(edges)) - np.repeat(offsets[:-1], np.diff(offsets))
    node = np.repeat(np.arange(len(vectors)), np.diff(offsets))
    some = place < 2 * DEGREE
    neighbours[node[some], place[some]] = edges[some]
    return Graph(vectors, medoids(vectors, APART), neighbours, offsets, edges)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> Graph:
    """A graph in which every vector is to be found from the medoids.

    Vectors come in batches that double what is there; each gets the pruned results of its
    own search as neighbours, and becomes a neighbour of these in turn.
    """
    count = len(vectors)
    starts = medoids(vectors, APART)
    neighbours = np.full((count, degree), -1, np.int64)
    graph = Graph(vectors, starts, neighbours)
    order = np.random.default_rng(count).permutation(count)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    ready = min(count, max(len(starts), degree + 1))
    first = order[:ready]
    neighbours[first] = robust_prune(vectors, first, np.tile(first, (ready, 1)), degree)
    while ready < count:
        batch = order[ready : ready + min(ready, QUERIES)]
        best, _ = graph.beam(vectors[batch], max(beam, CANDIDATES))
        # the batch's own vectors are not in the graph yet; near ones must meet as well
        among = vectors[batch] @ vectors[batch].T
        np.fill_diagonal(among, -np.inf)
        mates = np.argsort(-among, axis=1)[:, : min(8, len(batch) - 1)]
        found = np.concatenate([best, batch[mates]], axis=1)
        chosen = robust_prune(vectors, batch, found, degree)
        neighbours[batch] = chosen
        linked(graph, batch, chosen, degree)
        ready += len(batch)
    return graph


def linked(graph: Graph, nodes: np.ndarray, chosen: np.ndarray, degree: int) -> None:
    """Every chosen neighbour gets the node as a neighbour too; full lists are pruned again."""
    row, place = np.nonzero(chosen >= 0)
    target, source = chosen[row, place], nodes[row]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    wanted, first = np.unique(target, return_index=True)
    lists = [
        np.unique(np.concatenate([graph.neighbours[t][graph.neighbours[t] >= 0], some]))
        for t, some in zip(wanted, np.split(source, first[1:]))
    ]
    sizes = np.array([len(x) for x in lists])
    for t, some in zip(wanted[sizes <= degree], [x for x in lists if len(x) <= degree]):
        graph.neighbours[t] = -1
        graph.neighbours[t, : len(some)] = some
    full = np.flatnonzero(sizes > degree)
    for a in range(0, len(full), QUERIES):
        some = full[a : a + QUERIES]
        # the nearest are looked at where a list is long
        held = [nearest(graph.vectors, wanted[i], lists[i], CANDIDATES) for i in some]
        pruned = robust_prune(graph.vectors, wanted[some], widest(held, CANDIDATES), degree)
        graph.neighbours[wanted[some]] = pruned


def nearest(vectors: np.ndarray, node: int, some: np.ndarray, count: int) -> np.ndarray:
    if len(some) <= count:
        return some
    return some[np.argsort(-(vectors[some] @ vectors[node]), kind="stable")[:count]]
