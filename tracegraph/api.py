"""The public entry: one object over a set of graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.config import ScoringConfig, load_config
from tracegraph.functions import paths
from tracegraph.operators import causal, enrich, history, impact, incremental, lookup, resolve, review, scope, textmatch, traverse
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.shared import first_per_key, materialise
from tracegraph.session import tune
from tracegraph.sources import extraction, files, store
from tracegraph.streaming import changes

FAILURE_SCHEMA = "failure_id string, kind string, text string, path string, test_name string, name string, file string"
EMPTY_COMMITS = "commit_id long, sha string, author string, date timestamp, subject string, is_merge boolean"
EMPTY_LINES = "commit_id long, file_id long, start_line int, end_line int"


class CodeGraph:
    """Queries over an indexed code graph. Every method returns a DataFrame unless it says otherwise."""

    def __init__(self, graph: Graph, config: ScoringConfig | None = None):
        self.graph = graph
        self.config = config or load_config()
        tune(graph.symbols.sparkSession)

    # -- building ------------------------------------------------------------

    @classmethod
    def from_sources(cls, sources: DataFrame, commits: DataFrame | None = None, commit_lines: DataFrame | None = None, as_of=None,
                     manifests: DataFrame | None = None, config: ScoringConfig | None = None) -> "CodeGraph":
        """Index ``sources(path, content)`` and resolve its edges. Without history every history query is empty."""
        spark = sources.sparkSession
        tables = extraction.graph_tables(sources, manifests)
        return cls(cls._resolved(spark, tables, commits, commit_lines, as_of), config)

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, scope_paths: list[str] | None = None, max_files: int | None = None, **kwargs) -> "CodeGraph":
        tree = files.read_tree(spark, root, scope_paths, max_files)
        base = paths.basename(F.col("path"))
        manifests = tree.filter(base.isin("package.json", "pyproject.toml")).select("path", "content")
        return cls.from_sources(tree.select("path", "content"), manifests=manifests, **kwargs)

    @classmethod
    def from_store(cls, spark: SparkSession, root: str, repo_id: str, commits=None, commit_lines=None, as_of=None, config=None) -> "CodeGraph":
        tables = {name: store.load_table(spark, root, name, repo_id) for name in extraction.STORED}
        return cls(cls._resolved(spark, tables, commits, commit_lines, as_of), config)

    @classmethod
    def from_snapshot(cls, snapshots, version: int | None = None, commits=None, commit_lines=None, as_of=None, config=None) -> "CodeGraph":
        """The graph of a version of a ``SnapshotStore``, without resolving anything again; later versions do not change it."""
        spark = snapshots.spark
        history_ = {
            "commits": commits if commits is not None else spark.createDataFrame([], EMPTY_COMMITS),
            "commit_lines": commit_lines if commit_lines is not None else spark.createDataFrame([], EMPTY_LINES),
        }
        as_of = as_of if as_of is not None else F.current_timestamp()
        return cls(changes.snapshot_graph(snapshots, snapshots.manifest(version), as_of=as_of, **history_), config)

    def save_snapshot(self, snapshots) -> int:
        """Write this graph as a new version of a ``SnapshotStore``; returns its number."""
        depends = incremental.dependencies(self.graph, *incremental.roots_and_packages(self.graph))
        return snapshots.replace(changes.snapshot_tables(self.graph, depends))

    @staticmethod
    def _resolved(spark, tables, commits, commit_lines, as_of) -> Graph:
        commits = commits if commits is not None else spark.createDataFrame([], EMPTY_COMMITS)
        lines = commit_lines if commit_lines is not None else spark.createDataFrame([], EMPTY_LINES)
        graph = Graph(as_of=as_of if as_of is not None else F.current_timestamp(), commits=commits, commit_lines=lines, **tables)
        manifests = tables["file_text"].filter(F.col("path").endswith("package.json")).select("path", "content")
        done = resolve.resolve(graph, packages=resolve.workspace_packages(manifests))
        graph.symbols, _ = materialise(done["symbols"])
        graph.edges, _ = materialise(done["edges"].drop("line_text"))
        graph.arg_bindings, _ = materialise(done["arg_bindings"])
        return graph

    def save(self, root: str, repo_id: str) -> None:
        store.save_graph({name: getattr(self.graph, name) for name in extraction.STORED}, root, repo_id)

    # -- structure -----------------------------------------------------------

    def definition_of(self, name: str, language: str | None = None, subsystem: str | None = None) -> DataFrame:
        return lookup.definition_of(self.graph, name, language, subsystem)

    def symbols_in_file(self, path: str) -> DataFrame:
        return lookup.symbols_in_file(self.graph, path)

    def callers_of(self, seeds, depth: int = 2, min_confidence: float = 0.5) -> DataFrame:
        return traverse.callers_of(self.graph, seeds, depth, min_confidence)

    def callees_of(self, seeds, depth: int = 1) -> DataFrame:
        return traverse.callees_of(self.graph, seeds, depth)

    def path_between(self, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
        return traverse.path_between(self.graph, pairs, max_depth)

    def recently_changed_near(self, seeds, since_days: int = 90, max_commits: int = 20) -> DataFrame:
        return history.recently_changed_near(self.graph, seeds, since_days, max_commits)

    def summary(self) -> DataFrame:
        return lookup.session_summary(self.graph)

    # -- ranking -------------------------------------------------------------

    def impact(self, seeds, depth: int = 3) -> DataFrame:
        return impact.impact(self.graph, seeds, depth)

    def causal_chain(self, seeds, top_n: int = 5, legacy: bool = False) -> DataFrame:
        return causal.causal_chain(self.graph, traverse.seed_frame(self.graph, seeds), top_n, self.config, legacy)

    def match_text(self, texts: DataFrame, limit: int | None = None) -> DataFrame:
        return textmatch.match_text(self.graph, texts, self.config.matcher, limit)

    def enrich(self, candidates: DataFrame) -> DataFrame:
        return enrich.enrich(self.graph, candidates)

    def review(self, patches: DataFrame) -> dict[str, DataFrame]:
        return review.review(self.graph, patches, self.config)

    # -- failures ------------------------------------------------------------

    def seed_files(self, failures: DataFrame) -> DataFrame:
        """(failure_id, file_id, seed_ord, symbol) of structured failures, by kind."""
        g = self.graph
        known = g.files.select(F.col("id").alias("file_id"), "path")
        traced = scope.trace_seeds(failures.filter(F.col("kind") == "stack-trace").select("failure_id", "text"), g.files)
        by_path = failures.filter(F.col("kind").isin("file", "failing-test")).join(known, "path").select(
            "failure_id", "file_id", F.lit(1).cast("long").alias("seed_ord"), F.lit("").alias("symbol")
        )
        named = failures.filter(F.col("kind") == "symbol").select("failure_id", "name", F.col("file").alias("wanted"))
        defs = symbols_with_path(g).filter(~F.col("kind").isin("param", "local")).select("name", "path", "file_id")
        found = named.join(defs, "name").filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("path")))
        by_name = first_per_key(found.select("failure_id", "file_id", "name", "path"), ["failure_id", "file_id"], ["path"]).select(
            "failure_id", "file_id", F.lit(1).cast("long").alias("seed_ord"), F.col("name").alias("symbol")
        )
        return traced.unionByName(by_path).unionByName(by_name)

    def resolve_scope(self, failures: DataFrame, max_files: int = scope.MAX_FILES, max_loc: int = scope.MAX_LOC, max_depth: int = 2,
                      rejected: bool = False) -> DataFrame:
        """Files to look at per structured failure, within the budget.

        Files that changed together with a seed are seeds as well: their importers come too.
        """
        seeds, _ = materialise(self.seed_files(failures))
        est = self.graph.file_text.select("id", paths.estimated_loc(F.octet_length("content")).alias("est"))
        sized = Graph(files=self.graph.files.join(est, "id"), file_text=self.graph.file_text)
        together, _ = materialise(scope.default_cochange(self.graph, seeds, self.config.retrieval))
        last = seeds.groupBy("failure_id").agg(F.max("seed_ord").alias("_last"))
        later = together.join(last, "failure_id").select("failure_id", "file_id", (F.col("_last") + 1 + F.col("cochange_rank")).alias("seed_ord"))
        every = seeds.select("failure_id", "file_id", "seed_ord").unionByName(later).groupBy("failure_id", "file_id").agg(F.min("seed_ord").alias("seed_ord"))
        return scope.resolve_scope(
            sized, seeds, scope.file_import_edges(self.graph), scope.importers(self.graph, every), together, max_files, max_loc, max_depth,
            F.col("est"), rejected,
        )

    def _anchors(self, structured: DataFrame, seeds: DataFrame, scoped: DataFrame) -> DataFrame:
        """(failure_id, name, path, tier): the symbol a failure names, else the first fit one of its files."""
        primary = scope.primary_symbol(seeds).withColumnRenamed("symbol", "named")
        first = seeds.filter(F.col("seed_ord") == 1).join(self.graph.files.select(F.col("id").alias("file_id"), "path"), "file_id")
        picked = causal.pick_anchor(self.graph, first.select("failure_id", "path"), scoped.select("failure_id", "path"))
        joined = structured.select("failure_id").join(primary, "failure_id", "left").join(picked, "failure_id", "left")
        own = F.col("named").isNotNull()
        return joined.select(
            "failure_id", F.coalesce("named", "name").alias("name"), F.when(~own, F.col("path")).alias("path"), F.when(own, 0).otherwise(F.col("tier")).alias("tier")
        ).filter(F.col("name").isNotNull())

    def rca_notes(self, failures: DataFrame) -> DataFrame:
        """(failure_id, notes) of structured failures: what was not found, widened or cut."""
        structured, _ = materialise(failures.filter(F.col("kind") != "free-text"))
        seeds, _ = materialise(self.seed_files(structured))
        judged, _ = materialise(self.resolve_scope(structured, rejected=True))
        return scope.scope_notes(structured, seeds, judged, self._anchors(structured, seeds, judged.filter(F.col("limit").isNull())))

    def rca(self, failures: DataFrame, top_n: int = 5, legacy: bool = False, dataflow: bool = True) -> DataFrame:
        """Ranked candidates for every failure of the batch: (failure_id, rank, name, file, line, score, rationale...).

        ``failures`` follow FAILURE_SCHEMA. Structured failures are ranked inside their own
        scope: walks stay in its files, calls that leave it count as open. Failures without
        an anchor give no rows.
        """
        failures, _ = materialise(failures)
        structured = failures.filter(F.col("kind") != "free-text")
        seeds, _ = materialise(self.seed_files(structured))
        scoped, _ = materialise(self.resolve_scope(structured))
        files_of = scoped.select(F.col("failure_id").alias("scope_id"), "file_id")
        columns = ["failure_id", "rank", "name", "file", "line", "role", "distance", "score", "rationale"]
        # One anchor for traces, tests and symbols.
        single = self._anchors(structured.filter(F.col("kind") != "file"), seeds, scoped)
        anchors = single.select(F.col("failure_id").alias("seed_id"), "name")
        chains = causal.causal_chain(self.graph, anchors, top_n, self.config, legacy, dataflow, within=traverse.Scope(files_of))
        out = chains.withColumnRenamed("seed_id", "failure_id").select(*columns)
        # Every symbol of the seed files, and of those that changed with them, for file failures.
        by_file = scoped.filter(F.col("stage") <= 1).join(structured.filter(F.col("kind") == "file"), "failure_id", "left_semi")
        file_seeds = scope.seeds_from_scope(self.graph, by_file.select("failure_id", "file_id", F.col("scope_rank").alias("seed_ord")))
        many = causal.multi_anchor(self.graph, file_seeds, top_n, self.config, legacy, dataflow, scopes=files_of)
        out = out.unionByName(many.drop("rank").withColumnRenamed("merged_rank", "rank").select(*columns))
        # Text matches for prose.
        texts = failures.filter(F.col("kind") == "free-text").select(F.col("failure_id").alias("text_id"), "text")
        prose = textmatch.free_text_rca(self.graph, texts, top_n, self.config, dataflow)
        lit = F.lit
        return out.unionByName(
            prose.select("failure_id", "rank", "name", "file", "line", lit("anchor").alias("role"), lit(0).alias("distance"), "score", "source")
            .withColumnRenamed("source", "rationale")
        )
