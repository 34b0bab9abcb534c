"""Shards by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.ranks import ranked
from tracegraph.llm.tables import quoted

# Hexadecimal digits of a digest that make a draw: 52 bits, exact in a double.
DIGITS = 13
# What a row takes besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight (0 takes no rows)."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """Shards 0 to ``shards`` - 1 of weight 1, filled rack by rack, region by region."""
    return [Leaf(s // (racks * per_rack), s // per_rack, s) for s in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """An exponential draw of rate ``weight`` from a digest of key and shard."""
    digest = F.md5(F.concat(key, F.lit(f":{leaf.shard}")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(uniform) / F.lit(float(leaf.weight))


def _chosen(draws: Column, first: Column, size: Column) -> Column:
    """Index of the least of ``size`` draws from ``first`` on; the earliest of equal ones."""
    part = F.slice(draws, first + 1, size)
    return (first + F.array_position(part, F.array_min(part)) - 1).cast("int")


def _extents(sizes: list[int]) -> tuple[Column, Column]:
    """First index and size of consecutive runs."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    return F.array(*[F.lit(s) for s in starts]), F.array(*[F.lit(s) for s in sizes])


def descend(draws: Column, tree: list[Leaf]) -> tuple[list[Column], Column]:
    """Draws of the levels above the shards, and the shard at the end of the descent.

    A node draws the least of its children's draws. The least of exponential draws is an
    exponential draw whose rate is the sum of theirs, so a region is chosen in proportion
    to its weight, then a rack inside it, then a shard inside that. A changed weight
    changes draws on the path from its shard to the root only, and these change by that
    shard's draw alone: rows move into a shard that grows and out of one that shrinks,
    never between others, whatever levels lie above.
    """
    racks = [list(g) for _, g in groupby(tree, key=lambda x: (x.region, x.rack))]
    regions = [list(g) for _, g in groupby(racks, key=lambda r: r[0].region)]
    rack_first, rack_size = _extents([len(r) for r in racks])
    region_first, region_size = _extents([len(r) for r in regions])
    number = len(racks)
    by_rack = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.array_min(F.slice(draws, F.get(rack_first, i) + 1, F.get(rack_size, i))))
    by_region = lambda rack_draws: F.transform(
        F.sequence(F.lit(0), F.lit(len(regions) - 1)),
        lambda i: F.array_min(F.slice(rack_draws, F.get(region_first, i) + 1, F.get(region_size, i))),
    )
    rack_draws = F.col("_rack_draws")
    region = _chosen(by_region(rack_draws), F.lit(0), F.lit(len(regions)))
    rack = _chosen(rack_draws, F.get(region_first, F.col("_region")), F.get(region_size, F.col("_region")))
    leaf = _chosen(draws, F.get(rack_first, F.col("_rack")), F.get(rack_size, F.col("_rack")))
    shard = F.get(F.array(*[F.lit(x.shard) for x in tree]), leaf)
    return [by_rack.alias("_rack_draws"), region.alias("_region"), rack.alias("_rack")], shard


def place(df: DataFrame, key: Column, tree: list[Leaf], name: str) -> DataFrame:
    """``df`` with an int column ``name``: the shard at the end of the descent for ``key``.

    ``key`` is a string; null is a key of its own. Shards of weight 0 take nothing. A row
    costs one digest for each shard and no shuffle.
    """
    live = sorted((x for x in tree if x.weight > 0), key=lambda x: (x.region, x.rack, x.shard))
    if not live:
        raise ValueError("a tree needs a shard with a weight")
    if len({x.shard for x in live}) < len(live):
        raise ValueError("a shard is named twice")
    text = F.coalesce(key, F.lit("-"))
    out = df.withColumn("_draws", F.array(*[_draw(text, x) for x in live]))
    steps, shard = descend(F.col("_draws"), live)
    for step, column in zip(steps, ("_rack_draws", "_region", "_rack")):
        out = out.withColumn(column, step)
    return out.withColumn(name, shard).drop("_draws", "_rack_draws", "_region", "_rack")


def shard_rows(docs: DataFrame, tree: list[Leaf], grown: list[Leaf], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The identifier and the tree alone decide the shard (law ``key``). ``grown_shard`` is the
    shard under the tree ``grown``; if that adds a shard, rows that move all move into it.
    ``size`` is the bytes of the text in UTF-8 (null: none) plus 8, ``text_crc32`` the
    checksum of these bytes (0 for null or empty). Slots of a shard run from 0 without
    gaps, by identifier (nulls first), then size and checksum. Rows that share an
    identifier share a shard and have a slot each, so copies of a row stay. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    body = F.coalesce(quoted(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        quoted(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.col("doc_id").cast("string")
    placed = place(place(rows, key, tree, "shard"), key, grown, "grown_shard")
    slots = ranked(placed, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
