"""Blast radius of a change: callers with risk, tests and recent history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions import paths, signals
from tracegraph.functions.runtime_names import is_runtime_name
from tracegraph.operators import history, packed
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.lookup import first_definitions
from tracegraph.operators.shared import first_per_key, materialise, top_k
from tracegraph.operators.traverse import callers_of, clamp, seed_frame
from tracegraph.operators.wordindex import WordIndex

MAX_TESTS = 8


def unresolved_targets(graph: Graph, nodes: DataFrame, names=None) -> DataFrame:
    """Distinct (file, name, target) of open calls leaving ``nodes(file, name)``; runtime names do not count."""
    located = symbols_with_path(graph).select(F.col("id").alias("from_symbol_id"), F.col("path").alias("file"), "name")
    wanted = located.join(nodes.select("file", "name").distinct(), ["file", "name"], "left_semi")
    open_calls = graph.edges.filter((F.col("kind") == "CALLS") & F.col("to_symbol_id").isNull()).filter(
        ~is_runtime_name("to_name", names)
    )
    return (
        open_calls.select("from_symbol_id", F.col("to_name").alias("target"))
        .distinct()
        .join(wanted, "from_symbol_id")
        .select("file", "name", "target")
        .distinct()
    )


def unresolved_counts(graph: Graph, nodes: DataFrame, names=None) -> DataFrame:
    return unresolved_targets(graph, nodes, names).groupBy("file", "name").agg(F.count(F.lit(1)).alias("n_unresolved"))


def test_index(graph: Graph) -> WordIndex:
    """Index of the test files' texts, a part per file; build it once where many searches follow."""
    return WordIndex.build(graph.file_text.filter(paths.is_test_path(F.col("path"))), "path", "content", part="id")


def tests_mentioning(graph: Graph, names: DataFrame, tests: WordIndex | None = None) -> DataFrame:
    """(name, test_path): indexed test files whose text contains the name; ``tests`` is a stored ``test_index``."""
    return (tests or test_index(graph)).containing(names, "name", "test_path").select("name", "test_path")


def near_test(test_path: Column, file: Column) -> Column:
    """0 when the test sits in the directory of the file or in its tests folder, else 1."""
    here = paths.dirname(file)
    folder = F.when(here == "", F.lit("tests")).otherwise(F.concat(here, F.lit("/tests")))
    test_dir = paths.dirname(test_path)
    return F.when((test_dir == here) | (test_dir == folder), 0).otherwise(1)


def covering_tests(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Up to eight tests per node ``nodes(file, name)``, those next to the file first."""
    mentions = tests_mentioning(graph, nodes.select("name").distinct())
    pairs = nodes.select("file", "name").distinct().join(mentions, "name")
    ranked = pairs.withColumn("near", near_test(F.col("test_path"), F.col("file")))
    return top_k(ranked, ["file", "name"], [F.asc("near"), F.asc("test_path")], MAX_TESTS, rank="test_rank").select(
        "file", "name", paths.basename(F.col("test_path")).alias("test"), "test_path", "test_rank"
    )


def impact(graph: Graph, seeds, depth: int = 3, names=None, since_days: int = 90) -> DataFrame:
    """The seed (distance 0, risk 0) and its callers up to ``depth`` hops, each with a risk in [0, 1].

    A name that is not in the graph is an error when ``seeds`` is a name;
    frames with unknown names simply give no rows for them.
    """
    depth = clamp(int(depth), 1, 5)
    if isinstance(seeds, str) and graph.symbols.filter(F.col("name") == seeds).isEmpty():
        raise ValueError(f"symbol not found: {seeds}")
    seeds = seed_frame(graph, seeds)
    chosen = first_definitions(graph, seeds).select("name", F.col("path").alias("file"), F.col("start_line").alias("line")).join(seeds, "name")
    walked = callers_of(graph, seeds, depth)
    callers, _ = materialise(walked.join(chosen.select("seed_id", "file", "name"), ["seed_id", "file", "name"], "left_anti"))
    nodes = callers.select("file", "name").distinct()
    recent = (
        history.node_changes(graph, nodes, since_days, 3)
        .groupBy("file", "name")
        .agg(F.count_if(F.col("days_ago") <= 30).alias("n_recent"))
    )
    names_seen = nodes.select("name").unionByName(seeds.select("name"))
    tested, _ = materialise(tests_mentioning(graph, names_seen).select("name").distinct().withColumn("has_test", F.lit(True)))
    facts = (
        callers.join(unresolved_counts(graph, nodes, names), ["file", "name"], "left")
        .join(recent, ["file", "name"], "left")
        .join(tested, "name", "left")
    )
    zero = F.lit(0)
    scored = facts.select(
        "seed_id", "name", "file", "line", F.col("depth").alias("distance"),
        F.coalesce("n_unresolved", zero).alias("n_unresolved"), F.coalesce("n_recent", zero).alias("n_recent"),
        F.coalesce("has_test", F.lit(False)).alias("has_test"), "parent_file", "parent_name",
    ).withColumn(
        "risk", signals.risk_score(F.col("n_unresolved"), F.col("n_recent"), F.col("has_test"), F.col("distance"), depth)
    )
    nothing = F.lit(None).cast("string")
    seed_rows = chosen.join(tested, "name", "left").select(
        "seed_id", "name", "file", "line", zero.alias("distance"), zero.cast("long").alias("n_unresolved"), zero.cast("long").alias("n_recent"),
        F.coalesce("has_test", F.lit(False)).alias("has_test"), nothing.alias("parent_file"), nothing.alias("parent_name"),
        F.lit(0.0).alias("risk"),
    )
    return scored.unionByName(seed_rows)


def affected_counts(graph: Graph, names: DataFrame, depth: int = 3) -> DataFrame:
    """(name, affected): how many nodes at a distance above zero ``impact`` has for every distinct name of ``names(name)``; 0 where none."""
    seeds = names.select(F.col("name").alias("seed_id"), "name").distinct()
    chosen = first_definitions(graph, seeds).select(F.col("name").alias("seed_id"), F.col("path").alias("file"), "name")
    counts = packed.caller_counts(graph, packed.numbered(seeds), clamp(int(depth), 1, 5), chosen)
    return seeds.join(counts, "seed_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("affected"))


def impact_summary(nodes: DataFrame) -> DataFrame:
    """Largest risk, largest distance and number of affected nodes per seed."""
    return nodes.groupBy("seed_id").agg(
        F.max("risk").alias("max_risk"), F.max("distance").alias("max_distance"), F.count(F.lit(1)).alias("affected")
    )


def file_rollup(nodes: DataFrame) -> DataFrame:
    """Nodes, largest risk and riskiest node per file."""
    return nodes.groupBy("seed_id", "file").agg(
        F.count(F.lit(1)).alias("n"), F.max("risk").alias("max_risk"),
        F.min_by("name", F.struct(-F.col("risk"), F.col("distance"), F.col("name"))).alias("hottest"),
    )


def untested_callers(nodes: DataFrame, limit: int = 3) -> DataFrame:
    """Riskiest callers without a test, one row per (file, name)."""
    open_ = nodes.filter((F.col("distance") > 0) & ~F.col("has_test"))
    unique = first_per_key(open_.select("file", "name", "line", "risk"), ["file", "name"], [-F.col("risk"), "line"])
    return unique.orderBy(F.desc("risk"), "file", "name").limit(limit)


def total_affected(nodes: DataFrame) -> DataFrame:
    """Non-seed nodes over all seeds; a node reached from two seeds counts twice."""
    return nodes.agg(F.count_if(F.col("distance") > 0).alias("total_affected"))
