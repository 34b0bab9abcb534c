"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.tables import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every linked node; root is the smallest node of its component.

    ``links`` has two columns of nodes in either order. Each round takes logarithmically
    fewer steps than a walk; its edges are written to the shared folder, and a lost
    executor repeats one round at most. Minima are combined before the shuffle, so a hub
    does not gather in one task. ``rows``, if known, is how many links there are at most. Nulls and loops
    are left out; no links give no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    edges = saved(edges.distinct(), "links", rows)
    before = None
    while before != (now := _state(edges)):
        # A large star gives up to twice the links, which the small star brings down again.
        before, rows = now, now[0]
        edges = saved(_small_star(saved(_large_star(edges), "links", 2 * rows)), "links", 2 * rows)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
