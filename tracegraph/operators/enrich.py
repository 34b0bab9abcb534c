"""Facts about a candidate list: definition, body, neighbours, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.functions import text as tx
from tracegraph.operators import history, traverse
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.shared import first_per_key, materialise, top_k

MAX_NEIGHBOURS = 3
MAX_COMMITS = 5


def enrich(graph: Graph, candidates: DataFrame, max_lines: int = 30, since_days: int = 90) -> DataFrame:
    """One row per ``candidates(cand_id, file, name, line)`` with body, top callers, resolved callees and newest commits.

    A line must lie inside the definition when given. Candidates without a
    definition keep NULLs and say so in ``note``.
    """
    located = symbols_with_path(graph).select(
        F.col("path").alias("file"), "name", "id", "file_id", "kind", "start_line", "end_line", "signature"
    )
    joined = candidates.join(located, ["file", "name"])
    inside = F.col("line").isNull() | F.col("line").between(F.col("start_line"), F.col("end_line"))
    defs, _ = materialise(first_per_key(joined.filter(inside).drop("line"), ["cand_id"], ["start_line", "id"]))
    bodies = defs.join(graph.file_text.select(F.col("id").alias("file_id"), "content"), "file_id").select(
        "cand_id", tx.source_slice(F.col("content"), F.col("start_line"), F.col("end_line"), max_lines).alias("source")
    )
    names = traverse.name_seeds(defs)

    def neighbours(df: DataFrame, alias: str) -> DataFrame:
        best = top_k(df, ["seed_id"], [F.desc("confidence"), F.asc("name"), F.asc("file")], MAX_NEIGHBOURS, rank="r")
        listed = F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda s: s["name"])
        per_name = best.groupBy(F.col("seed_id").alias("name")).agg(listed.alias(alias))
        return defs.select("cand_id", "name").join(per_name, "name").select("cand_id", alias)

    callers = neighbours(traverse.callers_of(graph, names, 1), "callers")
    callees = neighbours(traverse.callees_of(graph, names, 1).filter("resolved"), "callees")
    ranges = defs.select(F.col("cand_id").alias("range_id"), "file_id", "start_line", "end_line")
    newest = history.newest_changes(graph, ranges, since_days, MAX_COMMITS)
    commits = newest.groupBy(F.col("range_id").alias("cand_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("change_rank", "sha"))), lambda s: s["sha"]).alias("commits")
    )
    rows = candidates.select("cand_id", "file", "name").join(defs.drop("file", "name"), "cand_id", "left")
    for part in (bodies, callers, callees, commits):
        rows = rows.join(part, "cand_id", "left")
    return rows.withColumn("note", F.when(F.col("id").isNull(), F.lit("no definition found")).otherwise(F.lit("")))
