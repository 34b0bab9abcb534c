"""Root-cause ranking: candidates around an anchor, seven signals, one score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.config import ScoringConfig
from tracegraph.functions import signals
from tracegraph.operators import history, packed
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.impact import unresolved_targets
from tracegraph.operators.lookup import DEFINITION_ORDER, first_definitions
from tracegraph.operators.shared import first_per_key, materialise, top_k
from tracegraph.operators.traverse import Scope, callees_of, callers_of, hops_to, with_file

WINDOW_DAYS = 90
ROLE_ORDER = {"anchor": 0, "caller": 1, "callee": 2}
MAX_FLOW_HOPS = 4


def anchors(graph: Graph, seeds: DataFrame, within: Scope | None = None) -> DataFrame:
    """(seed_id, name, file, line): the anchor row of every seed ``seeds(seed_id, name[, file, line])``."""
    if "file" in seeds.columns:
        return seeds.select("seed_id", "name", "file", "line")
    if within is not None:
        own = symbols_with_path(graph).join(within.files_of(seeds.select("seed_id", "name")), ["name", "file_id"])
        ordered = own.select(
            "seed_id", F.when(F.col("exported"), 0).otherwise(1).alias("exported_rank"), "path", "start_line", "end_line", "id", "file_id", "kind", "subsystem"
        )
        first = first_per_key(ordered, ["seed_id"], DEFINITION_ORDER).select("seed_id", F.col("path").alias("file"), F.col("start_line").alias("line"))
        return seeds.select("seed_id", "name").join(first, "seed_id", "left").select("seed_id", "name", "file", "line")
    defs = first_definitions(graph, seeds).select("name", F.col("path").alias("file"), F.col("start_line").alias("line"))
    return seeds.select("seed_id", "name").join(defs, "name", "left").select("seed_id", "name", "file", "line")


def collect_candidates(anchor_rows: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """Anchor, callers and callees per seed; the closest role of a (file, name) wins, the anchor always."""

    def shaped(df: DataFrame, role: str, distance) -> DataFrame:
        return df.select("seed_id", "file", "name", F.lit(role).alias("role"), distance.cast("int").alias("distance"), "line")

    near = lambda df: df.filter(F.col("depth") <= 2)
    rows = (
        shaped(anchor_rows, "anchor", F.lit(0))
        .unionByName(shaped(near(callers), "caller", F.col("depth")))
        .unionByName(shaped(near(callees), "callee", F.col("depth")))
    )
    order = F.when(F.col("role") == "anchor", 0).when(F.col("role") == "caller", 1).otherwise(2)
    return first_per_key(rows.withColumn("_o", order), ["seed_id", "file", "name"], ["distance", "_o", F.coalesce("line", F.lit(0))]).drop("_o")


def symbol_meta(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Kind, span and subsystem of the first symbol per (file, name); by name alone where the file is unknown."""
    located = symbols_with_path(graph).select(
        F.col("path").alias("file"), "name", "id", "kind", "subsystem", (F.col("end_line") - F.col("start_line") + 1).alias("loc")
    )
    known = nodes.filter(F.col("file").isNotNull()).select("file", "name").distinct()
    by_file = first_per_key(located.join(known, ["file", "name"], "left_semi"), ["file", "name"], ["id"]).drop("id")
    unknown = nodes.filter(F.col("file").isNull()).select("name").distinct()
    by_name = first_per_key(located.drop("file").join(unknown, "name", "left_semi"), ["name"], ["id"]).drop("id")
    return by_file.unionByName(by_name.withColumn("file", F.lit(None).cast("string")))


def candidate_unresolved(graph: Graph, nodes: DataFrame, names=None) -> DataFrame:
    """Number of distinct open targets per (file, name), by name alone where the file is unknown."""
    known = unresolved_targets(graph, nodes.filter(F.col("file").isNotNull()), names)
    by_file = known.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n_unresolved"))
    unknown = nodes.filter(F.col("file").isNull()).select("name").distinct()
    where = symbols_with_path(graph).join(unknown, "name", "left_semi").select(F.col("path").alias("file"), "name").distinct()
    by_name = (
        unresolved_targets(graph, where, names).select("name", "target").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_unresolved"))
    )
    return by_file.unionByName(by_name.withColumn("file", F.lit(None).cast("string")).select("file", "name", "n_unresolved"))


def candidate_changes(graph: Graph, candidates: DataFrame, since_days: int = WINDOW_DAYS,
                      packed_as: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Newest three commits per (seed, candidate).

    Anchors use the range of their name's first definition, other candidates
    the first symbol of their (file, name).
    """
    keys = ["seed_id", "file", "name"]
    others = (candidates if packed_as is None else packed_as[0]).filter((F.col("role") != "anchor") & F.col("file").isNotNull())
    by_node = history.node_changes(graph, others.select("file", "name").distinct(), since_days)
    near = others.select(*keys).join(by_node, ["file", "name"]) if packed_as is None else packed.near_changes(others, by_node, packed_as[1])
    anchor_rows = candidates.filter(F.col("role") == "anchor").select(*keys)
    defs = first_definitions(graph, anchor_rows).select("name", "file_id", "start_line", "end_line")
    ranges = defs.select(F.col("name").alias("range_id"), "file_id", "start_line", "end_line")
    by_name = history.newest_changes(graph, ranges, since_days).withColumnRenamed("range_id", "name")
    at_anchor = anchor_rows.join(by_name, "name")
    columns = [*keys, "commit_id", "sha", "days_ago", "change_rank"]
    return near.select(*columns).unionByName(at_anchor.select(*columns))


def co_change(candidates: DataFrame, changes: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Bonus per candidate for commits shared with the anchor or with two others, at most 3.

    Commits are counted per seed and the weight joined back; pairs of
    candidates are never formed.
    """
    keys = ["seed_id", "file", "name"]
    members = changes.filter(F.col("days_ago") <= window_days).select(*keys, "commit_id").distinct()
    flagged = _null_safe(members, candidates.select(*keys, (F.col("role") == "anchor").cast("int").alias("is_anchor")), keys)
    clusters = flagged.groupBy("seed_id", "commit_id").agg(F.count(F.lit(1)).alias("n"), F.max("is_anchor").alias("has_anchor"))
    kept = clusters.filter((F.col("n") >= 2) & ((F.col("has_anchor") == 1) | (F.col("n") >= 3)))
    weights = kept.select("seed_id", "commit_id", signals.cluster_weight(F.col("n")).alias("w"))
    return (
        members.join(weights, ["seed_id", "commit_id"])
        .groupBy(*keys)
        .agg(F.least(F.sum("w"), F.lit(3.0)).alias("co_change_score"))
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats a NULL file as the same unknown file on both sides."""
    marked = lambda df: df.withColumn("_file", F.coalesce("file", F.lit("?")))
    rest = [k for k in keys if k != "file"]
    return marked(left).join(marked(right).drop("file"), [*rest, "_file"], how).drop("_file")


def dataflow_hops(graph: Graph, candidates: DataFrame, within: Scope | None = None) -> DataFrame:
    """(seed_id, name, arg_hops) of the shortest flow path from a candidate's name to the anchor's name."""
    anchor_names = candidates.filter(F.col("role") == "anchor").select("seed_id", F.col("name").alias("anchor_name"))
    ids = graph.symbols.select(F.col("id").alias("node_id"), "name")
    targets = anchor_names.join(ids, anchor_names["anchor_name"] == ids["name"]).select("seed_id", "node_id")
    if within is not None:
        targets = within.keep(with_file(graph, targets, "node_id", "_file_id"), "_file_id").drop("_file_id")
    hops = hops_to(graph, targets, MAX_FLOW_HOPS, within)
    sources = (
        candidates.select("seed_id", "name").distinct().join(anchor_names, "seed_id").filter(F.col("name") != F.col("anchor_name"))
        .select("seed_id", "name")
    )
    source_nodes, n = materialise(sources.join(ids, "name"))
    found = hops.join(source_nodes, ["seed_id", "node_id"])
    return found.groupBy("seed_id", "name").agg(F.min(F.struct("hops", "arg_hops")).alias("h")).select("seed_id", "name", F.col("h.arg_hops").alias("arg_hops"))


def score_candidates(graph: Graph, candidates: DataFrame, config: ScoringConfig = ScoringConfig(), legacy: bool = False,
                     dataflow: bool = True, names=None, within: Scope | None = None, packed_as: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates with their seven signals, weighted score and rationale.

    ``packed_as`` holds the same candidates as words with their numbered seeds; what depends on (file, name) alone
    is then joined with words, before seeds are told apart.
    """
    keys = ["seed_id", "file", "name"]
    nodes, n_nodes = materialise((candidates if packed_as is None else packed_as[0]).select("file", "name").distinct())
    changes, _ = materialise(candidate_changes(graph, candidates, packed_as=packed_as))
    newest = changes.groupBy(*keys).agg(
        F.min_by(F.struct("sha", "days_ago"), "change_rank").alias("newest"), F.min("days_ago").alias("min_days")
    )
    rows = _null_safe(candidates if packed_as is None else packed_as[0], symbol_meta(graph, nodes), ["file", "name"], "left")
    rows = _null_safe(rows, candidate_unresolved(graph, nodes, names), ["file", "name"], "left")
    rows = rows if packed_as is None else packed.unpacked(rows, packed_as[1])
    rows = _null_safe(rows, newest, keys, "left")
    rows = _null_safe(rows, co_change(candidates, changes), keys, "left")
    anchor_meta = rows.filter(F.col("role") == "anchor").select("seed_id", F.col("subsystem").alias("anchor_subsystem"))
    rows = rows.join(anchor_meta, "seed_id", "left")
    if dataflow:
        hops = packed.dataflow_hops(graph, candidates, MAX_FLOW_HOPS) if within is None else dataflow_hops(graph, candidates, within)
        rows = rows.join(hops, ["seed_id", "name"], "left")
    else:
        rows = rows.withColumn("arg_hops", F.lit(0))
    is_anchor = F.col("role") == "anchor"
    scored = rows.select(
        *keys, "line", "role", "distance", "kind", "loc", "subsystem",
        F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), F.col("newest.sha").alias("newest_commit"),
        F.col("newest.days_ago").alias("newest_days"), "min_days",
        signals.recency_score(F.col("newest.days_ago"), WINDOW_DAYS).alias("recency_score"),
        signals.proximity_score(F.col("distance")).alias("proximity_score"),
        signals.ambiguity_score(F.col("n_unresolved")).alias("ambiguity_score"),
        F.coalesce("co_change_score", F.lit(0.0)).alias("co_change_score"),
        signals.subsystem_score(F.col("subsystem"), F.col("anchor_subsystem")).alias("subsystem_score"),
        signals.complexity_score(F.coalesce("loc", F.lit(0))).alias("complexity_score"),
        F.when(is_anchor, F.lit(0.0)).otherwise(signals.dataflow_score(F.col("arg_hops"))).alias("dataflow_score"),
    )
    weights = config.scorer.legacy_weights if legacy else config.scorer.calibrated_weights
    scored = scored.withColumn("score", signals.weighted_sum(weights))
    row = {c: F.col(c) for c in scored.columns}
    return scored.withColumn("rationale", signals.rationale(row))


# Scores are compared after rounding so that a different order of summation
# never flips a rank.
SCORE_DIGITS = 9


def rank_order():
    return [
        F.desc(F.round("score", SCORE_DIGITS)), F.asc(F.coalesce("min_days", F.lit(2147483647))), F.asc(F.coalesce("file", F.lit(""))),
        F.asc("name"),
    ]


def candidates_around(graph: Graph, anchor_rows: DataFrame, callee_depth: int = 1, within: Scope | None = None) -> DataFrame:
    """The anchors with their callers and callees."""
    named = anchor_rows.select("seed_id", "name")
    callers = callers_of(graph, named, 2, 0.5, within)
    return collect_candidates(anchor_rows, callers, callees_of(graph, named, callee_depth, within))


def causal_chain(graph: Graph, seeds: DataFrame, top_n: int = 5, config: ScoringConfig = ScoringConfig(), legacy: bool = False,
                 dataflow: bool = True, callee_depth: int = 1, names=None, within: Scope | None = None) -> DataFrame:
    """Ranked candidates per seed ``seeds(seed_id, name[, file, line])``; with ``within`` each seed sees its own files only."""
    anchor_rows, _ = materialise(anchors(graph, seeds, within))
    candidates, _ = materialise(candidates_around(graph, anchor_rows, callee_depth, within))
    scored = score_candidates(graph, candidates, config, legacy, dataflow, names, within)
    return top_k(scored, ["seed_id"], rank_order(), top_n, rank="rank")


def causal_chains_of_many(graph: Graph, seeds: DataFrame, top_n: int = 5, config: ScoringConfig = ScoringConfig(), legacy: bool = False,
                          names=None) -> DataFrame:
    """``causal_chain`` for very many seeds ``seeds(seed_id, name)``: the same rows, by walks of 64 seeds a word."""
    anchor_rows, _ = materialise(anchors(graph, seeds))
    numbered = packed.numbered(anchor_rows.select("seed_id", "name"))
    callers = packed.callers_of(graph, numbered)
    callees = callees_of(graph, anchor_rows.select("seed_id", "name"))
    words, _ = materialise(packed.candidates(anchor_rows, callers, callees, numbered))
    candidates = packed.unpacked(words, numbered)
    scored = score_candidates(graph, candidates, config, legacy, names=names, packed_as=(words, numbered))
    return top_k(scored, ["seed_id"], rank_order(), top_n, rank="rank")


def merge_chains(chains: DataFrame, group: str, top_n: int = 5) -> DataFrame:
    """One list per group: every (file, name) with its best score over the group's seeds."""
    order = [-F.round("score", SCORE_DIGITS), "seed_ord", "rank"]
    best = first_per_key(chains.drop("seed_id"), [group, "file", "name"], order)
    return top_k(
        best, [group], [F.desc(F.round("score", SCORE_DIGITS)), F.asc(F.coalesce("file", F.lit(""))), F.asc("name")], top_n, rank="merged_rank"
    )


def multi_anchor(graph: Graph, seeds: DataFrame, top_n: int = 5, config: ScoringConfig = ScoringConfig(), legacy: bool = False,
                 dataflow: bool = True, names=None, scopes: DataFrame | None = None) -> DataFrame:
    """Chains of many anchors merged per failure.

    ``seeds(failure_id, seed_ord, name, file, line)``. A name that seeds
    several failures is walked once; with ``scopes(scope_id, file_id)`` once per failure,
    inside that failure's files.
    """
    own = ["name", "file", "line"] if scopes is None else ["failure_id", "name", "file", "line"]
    keyed = seeds.withColumn("seed_id", F.struct(*own))
    keyed, _ = materialise(keyed)
    distinct = keyed.select("seed_id", "name", "file", "line").distinct()
    within = None if scopes is None else Scope(scopes, F.col("seed_id.failure_id"))
    chains = causal_chain(graph, distinct, max(top_n * 2, 10), config, legacy, dataflow, names=names, within=within)
    tagged = keyed.select("failure_id", "seed_ord", "seed_id").join(chains, "seed_id")
    return merge_chains(tagged, "failure_id", top_n)


def first_hypothesis(ranked: DataFrame, group: str = "seed_id", rank: str = "rank") -> DataFrame:
    """The one-sentence hypothesis drawn from the best candidate."""
    where = (
        F.when(F.col("file").isNull(), F.lit("unknown location"))
        .when(F.col("line").isNull(), F.col("file"))
        .otherwise(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string")))
    )
    sentence = F.concat(
        F.lit("The root cause is most likely in "), F.col("name"), F.lit(" ("), where, F.lit(") — "), F.col("rationale")
    )
    return ranked.filter(F.col(rank) == 1).select(group, sentence.alias("hypothesis"))


def pick_anchor(graph: Graph, seed_files: DataFrame, scope_files: DataFrame) -> DataFrame:
    """First function, class or const of the seed file, else of the other files in scope, tests last.

    ``seed_files(failure_id, path)``, ``scope_files(failure_id, path)``.
    """
    from tracegraph.functions.paths import is_test_file_name

    eligible = symbols_with_path(graph).filter(F.col("kind").isin("function", "class", "const")).select("path", "name", "start_line", "id")
    first = first_per_key(eligible, ["path"], ["start_line", "id"])
    seed_rows = seed_files.select("failure_id", "path", F.lit(0).alias("tier"))
    other = scope_files.select("failure_id", "path", F.when(is_test_file_name(F.col("path")), 2).otherwise(1).alias("tier"))
    tiers = seed_rows.unionByName(other).groupBy("failure_id", "path").agg(F.min("tier").alias("tier"))
    return first_per_key(tiers.join(first, "path"), ["failure_id"], ["tier", "path"]).select("failure_id", "name", "path", "tier")
