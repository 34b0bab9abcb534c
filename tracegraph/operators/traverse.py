"""Bounded graph walks, batched over many seeds.

All walks go level by level. A frame of (seed_id, node_id, depth) holds the
smallest depth of every node; each level joins only the newest nodes with the
adjacency, unions the result in and takes the minimum again, so a level costs
one join and one pre-combined aggregate. Every level is written to the
checkpoint folder: its row count decides how the next join runs (a small
frontier is broadcast and the edge table stays where it is, a large one is
joined salted) and ends the walk once a level adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.shared import first_per_key, materialise
from tracegraph.session import cut_lineage


class Scope:
    """Files a walk may use, apart for every scope: ``files(scope_id, file_id)``; ``key`` gives the scope of a row's seed.

    A walk of many seeds then runs on (seed, node) with each seed held inside its own files.
    """

    def __init__(self, files: DataFrame, key: Column | None = None):
        self.files = files.select(F.col("scope_id").alias("_scope"), F.col("file_id").alias("_file")).distinct()
        self.key = F.col("seed_id") if key is None else key

    def keep(self, rows: DataFrame, file: str, how: str = "left_semi") -> DataFrame:
        """Rows whose file lies in their seed's scope, or with ``left_anti`` the others."""
        keyed = rows.withColumns({"_scope": self.key, "_file": F.col(file)})
        return keyed.join(self.files, ["_scope", "_file"], how).select(*rows.columns)

    def files_of(self, seeds: DataFrame) -> DataFrame:
        """``seeds`` with a row per file of their scope, as file_id. Names are looked up in these files instead of everywhere."""
        keyed = seeds.withColumn("_scope", self.key).join(self.files, "_scope")
        return keyed.select(*seeds.columns, F.col("_file").alias("file_id"))


def with_file(graph: Graph, df: DataFrame, symbol: str, file: str) -> DataFrame:
    """``df`` with the file of a symbol; rows without one are left out."""
    return df.join(graph.symbols.select(F.col("id").alias(symbol), F.col("file_id").alias(file)), symbol)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def seed_frame(graph: Graph, seeds) -> DataFrame:
    """(seed_id, name) from a name, a list of names or a ready frame."""
    if isinstance(seeds, DataFrame):
        return seeds.select("seed_id", "name")
    names = [seeds] if isinstance(seeds, str) else list(seeds)
    spark = graph.symbols.sparkSession
    return spark.createDataFrame([(n, n) for n in names], "seed_id string, name string")


def name_seeds(named: DataFrame) -> DataFrame:
    """(seed_id, name): a seed for every distinct name.

    A walk without a scope starts at all symbols of a name, so seeds that share one have the
    same rows. Many seeds are walked by name, and their results joined back by it.
    """
    return named.filter(F.col("name").isNotNull()).select(F.col("name").alias("seed_id"), "name").distinct()


def seed_nodes(graph: Graph, seeds: DataFrame, within: Scope | None = None) -> DataFrame:
    """Every symbol carrying a seed's name."""
    nodes = graph.symbols.select(F.col("id").alias("node_id"), "name", "file_id")
    found = nodes.join(seeds, "name") if within is None else nodes.join(within.files_of(seeds), ["name", "file_id"])
    return found.select("seed_id", "node_id")


def reach(start: DataFrame, adjacency: DataFrame, levels: int, within: Scope | None = None) -> tuple[DataFrame, int]:
    """(seed_id, node_id, depth) of nodes within ``levels`` hops, and its row count.

    ``adjacency(node_id, next_id)``, with ``within`` also next_file. What was reached is
    only added to: a level writes its new nodes and nothing else.
    """
    frontier, fresh = materialise(start.select("seed_id", "node_id", F.lit(0).alias("depth")).distinct())
    visited, total = frontier, fresh
    for level in range(1, levels + 1):
        step = adjacency.join(frontier.select("seed_id", "node_id"), ["node_id"])
        step = step if within is None else within.keep(step, "next_file")
        step = step.select("seed_id", F.col("next_id").alias("node_id"), F.lit(level).alias("depth"))
        frontier, fresh = materialise(step.distinct().join(visited, ["seed_id", "node_id"], "left_anti"))
        if fresh == 0:
            break
        visited, total = visited.unionByName(frontier), total + fresh
    return visited, total


def call_edges(graph: Graph, min_confidence: float | None = None) -> DataFrame:
    calls = graph.edges.filter(F.col("kind") == "CALLS")
    return calls if min_confidence is None else calls.filter(F.col("confidence") >= min_confidence)


def callers_of(graph: Graph, seeds, depth: int = 2, min_confidence: float = 0.5, within: Scope | None = None) -> DataFrame:
    """Functions that call the seeds, directly or through others, one row per (seed, file, name)."""
    depth = clamp(depth, 1, 5)
    seeds = seed_frame(graph, seeds)
    calls = call_edges(graph, min_confidence).filter(F.col("to_symbol_id").isNotNull())
    adjacency = calls.select(F.col("to_symbol_id").alias("node_id"), F.col("from_symbol_id").alias("next_id"))
    adjacency = adjacency if within is None else with_file(graph, adjacency, "next_id", "next_file")
    reached, n_reached = reach(seed_nodes(graph, seeds, within), adjacency, depth - 1, within)
    hits = calls.select(F.col("to_symbol_id").alias("node_id"), "from_symbol_id", "call_line", "confidence").join(reached, ["node_id"])
    hits = hits if within is None else within.keep(with_file(graph, hits, "from_symbol_id", "_from_file"), "_from_file").drop("_from_file")
    where = symbols_with_path(graph).select(F.col("id"), F.col("name"), F.col("path").alias("file"))
    caller = where.withColumnRenamed("id", "from_symbol_id")
    parent = where.select(
        F.col("id").alias("node_id"), F.col("file").alias("parent_file"), F.col("name").alias("parent_name")
    )
    # One row per calling symbol first: that is what the joins with names carry.
    slim = hits.select(
        "seed_id", "from_symbol_id", (F.col("depth") + 1).alias("depth"), F.col("call_line").alias("line"), "confidence", "node_id"
    )
    best, n_best = materialise(
        first_per_key(slim.withColumn("_c", -F.col("confidence")), ["seed_id", "from_symbol_id"], ["depth", "_c", "line", "node_id"])
    )
    callers = caller.join(best, ["from_symbol_id"])
    parents = parent.join(reached.select("node_id").distinct(), ["node_id"])
    named = callers.join(parents, "node_id")
    keyed = named.select(
        "seed_id", "file", "name", "depth", "_c", "line", "confidence", "parent_file", "parent_name", "from_symbol_id", "node_id"
    )
    return first_per_key(keyed, ["seed_id", "file", "name"], ["depth", "_c", "line", "from_symbol_id", "node_id"]).select(
        "seed_id", "name", "file", "line", "confidence", "depth", "parent_file", "parent_name"
    )


def callees_of(graph: Graph, seeds, depth: int = 1, within: Scope | None = None) -> DataFrame:
    """What the seeds call; unresolved targets, and those outside a scope, stay as leaves with a NULL file."""
    depth = clamp(depth, 1, 4)
    seeds = seed_frame(graph, seeds)
    calls = call_edges(graph)
    start = seed_nodes(graph, seeds, within)
    adjacency = calls.filter(F.col("to_symbol_id").isNotNull()).select(
        F.col("from_symbol_id").alias("node_id"), F.col("to_symbol_id").alias("next_id")
    )
    adjacency = adjacency if within is None else with_file(graph, adjacency, "next_id", "next_file")
    reached, n_reached = reach(start, adjacency, depth - 1, within)
    hits = calls.select(
            F.col("from_symbol_id").alias("node_id"), "to_symbol_id", "to_name", "confidence", "call_line", "resolution_kind"
        ).join(reached, ["node_id"])
    if within is not None:
        found = with_file(graph, hits, "to_symbol_id", "_to_file")
        outside = within.keep(found, "_to_file", "left_anti").withColumn("to_symbol_id", F.lit(None).cast("long"))
        inside = within.keep(found, "_to_file").unionByName(outside).select(*hits.columns)
        hits = hits.filter(F.col("to_symbol_id").isNull()).unionByName(inside)
    files = symbols_with_path(graph).select(F.col("id").alias("to_symbol_id"), F.col("path").alias("file"))
    slim = hits.select(
        "seed_id", "to_symbol_id", "to_name", (F.col("depth") + 1).alias("depth"), (-F.col("confidence")).alias("_c"),
        F.col("call_line").alias("line"), "confidence", "resolution_kind", "node_id",
    )
    best, n_best = materialise(
        first_per_key(
            slim, ["seed_id", "to_symbol_id", "to_name"], ["depth", "_c", "line", F.coalesce("resolution_kind", F.lit("")), "node_id"]
        )
    )
    # NULL targets have no partner: join only the resolved part, keep the rest.
    resolved = files.join(best.filter(F.col("to_symbol_id").isNotNull()), ["to_symbol_id"])
    open_ = best.filter(F.col("to_symbol_id").isNull()).withColumn("file", F.lit(None).cast("string"))
    keyed = resolved.unionByName(open_)
    parent = symbols_with_path(graph).select(
        F.col("id").alias("node_id"), F.col("path").alias("parent_file"), F.col("name").alias("parent_name")
    )
    rows = first_per_key(
        keyed,
        ["seed_id", "file", "to_name"],
        ["depth", "_c", "line", F.coalesce("resolution_kind", F.lit("")), F.coalesce("to_symbol_id", F.lit(-1)), "node_id"],
    )
    parents = parent.join(reached.select("node_id").distinct(), ["node_id"])
    return rows.join(parents, "node_id").select(
        "seed_id", F.col("to_name").alias("name"), "file", "line", "confidence", "depth",
        F.col("to_symbol_id").isNotNull().alias("resolved"), "resolution_kind", "parent_file", "parent_name",
    )


def flow_edges(graph: Graph) -> DataFrame:
    """Resolved calls and producer-to-caller argument flow, one row per (from, to), calls preferred."""
    calls = call_edges(graph).filter(F.col("to_symbol_id").isNotNull()).groupBy("from_symbol_id", "to_symbol_id").agg(
        F.min("call_line").alias("line")
    )
    calls = calls.select(
        F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), F.lit(0).alias("is_arg"), "line"
    )
    args = arg_flow(graph).select("src", "dst", F.lit(1).alias("is_arg"), F.lit(None).cast("int").alias("line"))
    return first_per_key(calls.unionByName(args), ["src", "dst"], ["is_arg"])


def arg_flow(graph: Graph) -> DataFrame:
    """Distinct (src, dst): an identifier argument flows from its producer to the calling symbol."""
    bound = graph.arg_bindings.filter((F.col("source_kind") == "identifier") & F.col("source_symbol_id").isNotNull())
    edges = graph.edges.select(F.col("id").alias("edge_id"), F.col("from_symbol_id").alias("dst"))
    return bound.select("edge_id", F.col("source_symbol_id").alias("src")).join(edges, "edge_id").select("src", "dst").distinct()


def hops_to(graph: Graph, targets: DataFrame, max_depth: int, within: Scope | None = None) -> DataFrame:
    """(seed_id, node_id, hops, arg_hops): shortest flow path from every node to a target.

    ``targets(seed_id, node_id)``. Among shortest paths the one with the fewest
    argument hops counts.
    """
    flow = flow_edges(graph).select(F.col("dst").alias("node_id"), F.col("src").alias("next_id"), "is_arg")
    flow = cut_lineage(flow if within is None else with_file(graph, flow, "next_id", "next_file"))
    frontier, fresh = materialise(targets.select("seed_id", "node_id", F.lit(0).alias("hops"), F.lit(0).alias("arg_hops")).distinct())
    state = frontier
    for level in range(1, max_depth + 1):
        near = flow.join(frontier.select("seed_id", "node_id", "arg_hops"), ["node_id"])
        step = (
            (near if within is None else within.keep(near, "next_file"))
            .groupBy("seed_id", F.col("next_id").alias("node_id"))
            .agg(F.min(F.col("arg_hops") + F.col("is_arg")).alias("arg_hops"))
            .select("seed_id", "node_id", F.lit(level).alias("hops"), "arg_hops")
        )
        frontier, fresh = materialise(step.join(state, ["seed_id", "node_id"], "left_anti"))
        if fresh == 0:
            break
        state = state.unionByName(frontier)
    return state


def path_between(graph: Graph, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """Shortest path of every ``pairs(pair_id, from_name, to_name)``, one row per step.

    Calls come before argument flow on ties, then the smaller parent id. A
    name that is both ends gives a single step. Pairs without a path give no row.
    """
    max_depth = clamp(max_depth, 1, 10)
    names = graph.symbols.select(F.col("id").alias("node_id"), "name")
    starts = pairs.join(names, pairs["from_name"] == names["name"]).select("pair_id", "node_id")
    goals = pairs.join(names, pairs["to_name"] == names["name"]).select("pair_id", "node_id", F.lit(True).alias("is_goal"))
    goals = cut_lineage(goals.distinct())
    flow = cut_lineage(flow_edges(graph).select(F.col("src").alias("node_id"), F.col("dst").alias("next_id"), "is_arg", "line"))
    none = F.lit(None)
    state = cut_lineage(
        starts.distinct().select(
            "pair_id", "node_id", F.lit(0).alias("depth"), none.cast("long").alias("parent_id"), none.cast("int").alias("is_arg"),
            none.cast("int").alias("line"),
        )
    )
    latest = state
    found = cut_lineage(state.join(goals, ["pair_id", "node_id"]).drop("is_goal"))
    for level in range(1, max_depth + 1):
        open_pairs = latest.join(found.select("pair_id").distinct(), "pair_id", "left_anti")
        frontier = open_pairs.select("pair_id", "node_id")
        step = flow.join(frontier, ["node_id"]).select(
            "pair_id", F.col("next_id").alias("node_id"), F.lit(level).alias("depth"), F.col("node_id").alias("parent_id"), "is_arg", "line"
        )
        unseen = step.join(state, ["pair_id", "node_id"], "left_anti")
        latest, fresh = materialise(first_per_key(unseen, ["pair_id", "node_id"], ["depth", F.coalesce("is_arg", F.lit(0)), F.coalesce("parent_id", F.lit(-1))]))
        if fresh == 0:
            break
        state = state.unionByName(latest)
        reached_goal = latest.join(goals, ["pair_id", "node_id"]).drop("is_goal")
        found = cut_lineage(found.unionByName(reached_goal))
    goal = first_per_key(found, ["pair_id"], ["depth", F.coalesce("is_arg", F.lit(0)), F.coalesce("parent_id", F.lit(-1)), "node_id"])
    steps = goal.select("pair_id", "node_id", "depth", "parent_id", "is_arg", "line")
    chain, cursor = steps, steps
    for _ in range(max_depth):
        up = cursor.filter(F.col("parent_id").isNotNull()).select("pair_id", F.col("parent_id").alias("node_id"))
        cursor = cut_lineage(state.join(up, ["pair_id", "node_id"]).select(*steps.columns))
        if cursor.isEmpty():
            break
        chain = chain.unionByName(cursor)
    where = symbols_with_path(graph).select(F.col("id").alias("node_id"), "name", F.col("path").alias("file"), "start_line")
    return chain.join(where, "node_id").select(
        "pair_id", F.col("depth").alias("step"), "name", "file", F.coalesce("line", "start_line").alias("line"),
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("is_arg") == 1, F.lit("ARG_BIND")).otherwise(F.lit("CALLS")).alias("edge_kind"),
    )
