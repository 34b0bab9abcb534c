"""Gapless numbers inside groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.llm.tables import saved


def ranked(df: DataFrame, group: str, order: list[str | Column], name: str, size: str | None = None) -> DataFrame:
    """``df`` with a long column ``name``: the row's place in its group, from 0, in the given order.

    ``size`` names a further column with the number of rows in the group.

    The rows are cut into ranges of (group, order) at sampled splitters, so a group with a
    third of all rows spreads over as many ranges as its share takes. Each range counts its
    rows, the counts of a group's earlier ranges (one number each) give a range its first
    place, and rows are numbered inside (group, range) only. Rows that agree in all of
    ``order`` are told apart by where they were written, so any number of them splits too.

    ``group`` has no nulls; ``df`` has none of the columns _row, _part and _first. Narrow rows
    are meant: they are written twice.
    """
    rows = saved(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranges = saved(rows.repartitionByRange(F.col(group), *order, F.col("_row")).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    all_rows = F.sum("_rows").over(Window.partitionBy(group)).alias(size or "_size")
    first = counts.select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"), all_rows)
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_row")
    numbered = ranges.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(first, [group, "_part"]).withColumn(name, F.col(name) + F.col("_first")).select(*df.columns, name, *([size] if size else []))
