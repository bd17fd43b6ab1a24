"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Scratch, join_unique

MOST_ROUNDS = 60


def _smallest(edges: DataFrame, total: int) -> DataFrame:
    """Each (u, v) with the smallest of u and all its neighbours, as column ``low``."""
    least = (
        edges.groupBy("u")
        .agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count(F.lit(1)).alias("n"))
    )
    return join_unique(edges, least.select("u", "low"), "u", least.select("u", "n"), total)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it is connected to.

    ``edges`` has two columns of one orderable type; direction, repeats, self-loops
    and rows with a null do not matter. Alternating large-star and small-star
    rounds shrink each component to a star in a logarithmic number of rounds; only
    two counters per round reach the driver, and hubs are split by ``join_unique``.
    """
    a, b = (F.col(f"`{name}`") for name in edges.columns)
    links = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = scratch.table(links.distinct(), "links")
    seen, count = None, links.count()
    for _ in range(MOST_ROUNDS if count else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.table(
            _smallest(both, 2 * count)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u != v")
            .distinct(),
            "large",
        )
        small = _smallest(large, 2 * count)
        small = (
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v")))
            .where("u != v")
            .distinct()
        )
        links = scratch.table(small, "small")
        mark = tuple(
            links.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if mark == seen:
            break
        seen, count = mark, mark[0]
    else:
        if count:
            raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
