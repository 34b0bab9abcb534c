"""File change events: debouncing in batch and stream, incremental upkeep of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegraph.operators.graph import Graph
from tracegraph.operators.shared import first_per_key, materialise

BUCKET = "1 hour"


def debounce(events: DataFrame, gap: str = "150 milliseconds", bucket: str = BUCKET) -> DataFrame:
    """Events ``(repo, ts, ...)`` with the start of their burst; a burst ends after ``gap`` without events.

    Bursts are found inside time buckets first, so one busy repository spreads
    over many tasks. Only one row per bucket then decides whether a bucket
    continues the burst of the one before.
    """
    keys = ["repo", "_bucket"]
    limit = F.expr(f"INTERVAL {gap}")
    bucketed = events.withColumn("_bucket", F.window("ts", bucket)["start"])
    in_bucket = Window.partitionBy(*keys).orderBy("ts")
    before = F.lag("ts").over(in_bucket)
    opened = bucketed.withColumn("_opens", before.isNotNull() & (F.col("ts") > before + limit))
    running = in_bucket.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = opened.withColumn("_local", F.max(F.when(F.col("_opens"), F.col("ts"))).over(running))
    summary = local.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max("_local").alias("_last_open"))
    across = Window.partitionBy("repo").orderBy("_bucket")
    starts_new = F.lag("_last").over(across).isNull() | (F.col("_first") > F.lag("_last").over(across) + limit)
    flagged = summary.withColumn("_own", F.when(starts_new, F.col("_first")))
    # Start of the burst that is open when a bucket ends, and the one inherited from before.
    carried = F.max(F.coalesce("_last_open", "_own")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    inherited = flagged.withColumn("_inherited", F.coalesce("_own", carried)).select(*keys, "_inherited")
    return (
        local.join(inherited, keys)
        .withColumn("session_start", F.coalesce("_local", "_inherited"))
        .drop("_bucket", "_opens", "_local", "_inherited")
    )


def latest_actions(bursts: DataFrame) -> DataFrame:
    """Last action per file and burst."""
    return first_per_key(
        bursts.select("repo", "session_start", "path", "action", "ts", "event_id"), ["repo", "session_start", "path"],
        [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")],
    )


def burst_stream(events: DataFrame, gap: str = "150 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """Closed bursts of a change stream: (repo, session_start, session_end, n_events). ``events(repo, path, action, ts)``.

    Append-mode session windows need a watermark, so events later than ``lateness``
    are missing from these counts. Changed files are not found through them: ``follow``
    hands every event to the upkeep with the micro-batch it arrives in. The state holds
    bounds and a count per open burst, never its files, so a busy repository costs no
    more than a quiet one.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("session"), "repo")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("repo", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_events")
    )


def burst_files(bursts: DataFrame, events: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Distinct (repo, session_start, path) of closed bursts, read back from the stored events in ``foreachBatch``.

    Joined on repository and time bucket, so one repository spreads over many keys.
    """
    step = F.expr(f"INTERVAL {bucket}")
    slot = lambda c: F.window(c, bucket)["start"]
    spans = bursts.withColumn("_from", slot("session_start")).withColumn("_to", slot("session_end"))
    keyed = spans.withColumn("_bucket", F.explode(F.sequence("_from", "_to", step))).drop("_from", "_to")
    tagged = events.select("repo", "path", "ts", slot("ts").alias("_bucket"))
    inside = (F.col("ts") >= F.col("session_start")) & (F.col("ts") < F.col("session_end"))
    return tagged.join(keyed, ["repo", "_bucket"]).filter(inside).select("repo", "session_start", "path").distinct()


EVENT_SCHEMA = "repo string, path string, action string, ts timestamp, event_id long"


def change_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of change events from JSON lines that a watcher appends as files below ``path``."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def follow(events: DataFrame, upkeep, checkpoint: str, once: bool = False):
    """Start keeping a graph in step with a change stream; returns the streaming query.

    A micro-batch is a burst: its files are taken once, however many events they have.
    Events that come late are in the batch they come with, so none is lost. ``once``
    handles what is there and stops.
    """
    writer = events.writeStream.foreachBatch(upkeep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class GraphUpkeep:
    """foreachBatch sink that keeps stored graph tables in step with changed files.

    ``read_sources(paths)`` gives (path, content) of files that still exist;
    files that do not come back are deleted. Raw rows are stored and
    resolution is derived from them, so a replayed batch ends in the same
    state.
    """

    def __init__(self, root: str, repo_id: str, read_sources):
        self.root, self.repo_id, self.read_sources = root, repo_id, read_sources

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from tracegraph.sources import extraction, store
        from tracegraph.session import cut_lineage

        spark = batch.sparkSession
        paths = cut_lineage(batch.select("path").distinct())
        if paths.isEmpty():
            return
        fresh = extraction.graph_tables(self.read_sources(paths))
        touched = paths.select(extraction.file_key(F.col("path")).alias("file_id"))
        current = {n: store.load_table(spark, self.root, n, self.repo_id) for n in extraction.STORED}
        old_symbols = current["symbols"].join(touched, "file_id", "left_semi").select("id")
        old_edges = current["raw_edges"].join(old_symbols.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")
        merged = {
            "files": store.replace_files(current["files"], touched.select(F.col("file_id").alias("id")), fresh["files"], "id"),
            "file_text": store.replace_files(current["file_text"], touched.select(F.col("file_id").alias("id")), fresh["file_text"], "id"),
            "symbols": store.replace_files(current["symbols"], touched, fresh["symbols"]),
            "imports": store.replace_files(current["imports"], touched, fresh["imports"]),
            "raw_edges": store.replace_files(
                current["raw_edges"], old_symbols.select(F.col("id").alias("from_symbol_id")), fresh["raw_edges"], "from_symbol_id"
            ),
            "params": store.replace_files(current["params"], old_symbols.select(F.col("id").alias("symbol_id")), fresh["params"], "symbol_id"),
            "arg_bindings": store.replace_files(
                current["arg_bindings"], old_edges.select(F.col("id").alias("edge_id")), fresh["arg_bindings"], "edge_id"
            ),
        }
        # Reading and overwriting the same folder: pin the new state first.
        pinned = {name: cut_lineage(df) for name, df in merged.items()}
        store.save_graph(pinned, self.root, self.repo_id)


def snapshot_tables(graph: Graph, dependencies: DataFrame) -> dict[str, DataFrame]:
    """The tables of a resolved graph as a snapshot store keeps them: each with the file a row belongs to."""
    owner = graph.symbols.select(F.col("id").alias("_symbol"), "file_id")

    def by_symbol(df: DataFrame, key: str) -> DataFrame:
        return df.join(owner.withColumnRenamed("_symbol", key), key).select(*df.columns, "file_id")

    edges = by_symbol(graph.edges, "from_symbol_id")
    place = edges.select(F.col("id").alias("edge_id"), "file_id").distinct()
    return {
        "files": graph.files.withColumn("file_id", F.col("id")), "file_text": graph.file_text.withColumn("file_id", F.col("id")),
        "symbols": graph.symbols, "imports": graph.imports, "params": by_symbol(graph.params, "symbol_id"), "raw_edges": by_symbol(graph.raw_edges, "from_symbol_id"),
        "edges": edges, "arg_bindings": graph.arg_bindings.join(place, "edge_id").select(*graph.arg_bindings.columns, "file_id"),
        "dependencies": dependencies,
    }


def snapshot_graph(store, manifest: dict | None = None, **history) -> Graph:
    """The graph of a version, resolved as it was stored."""
    manifest = manifest or store.manifest()
    plain = {"symbols", "imports", "dependencies"}
    tables = {n: store.load(n, manifest) if n in plain else store.load(n, manifest).drop("file_id") for n in manifest["tables"]}
    return Graph(**tables, **history)


class IncrementalUpkeep:
    """foreachBatch sink that brings a snapshot store to the state of changed files.

    A burst reads its files, finds whose edges can resolve differently, resolves these and
    writes their buckets; the new version of all tables appears at once. A batch that was
    already made is skipped, one that died half-way left nothing visible and runs again.
    ``read_sources(paths)`` gives (path, content) of files that still exist.
    """

    def __init__(self, store, read_sources):
        self.store, self.read_sources = store, read_sources

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from tracegraph.operators import incremental
        from tracegraph.session import cut_lineage
        from tracegraph.sources import extraction

        manifest = self.store.manifest()
        if manifest["batch"] is not None and manifest["batch"] >= epoch:
            return
        paths, n = materialise(batch.select("path").distinct())
        if n == 0:
            return
        touched, _ = materialise(paths.select(extraction.file_key(F.col("path")).alias("file_id")))
        old = snapshot_graph(self.store, manifest)
        fresh = {k: v for k, v in extraction.graph_tables(self.read_sources(paths)).items() if k in extraction.STORED}
        blank = F.lit(None).cast("long")
        old.arg_bindings = old.arg_bindings.withColumn("source_symbol_id", blank)
        gone_symbols, _ = materialise(old.symbols.join(touched, "file_id", "left_semi").select("id"))
        gone_edges = old.raw_edges.join(gone_symbols.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi").select("id")
        keys = {
            "files": ("id", touched.select(F.col("file_id").alias("id"))), "file_text": ("id", touched.select(F.col("file_id").alias("id"))),
            "symbols": ("file_id", touched), "imports": ("file_id", touched),
            "raw_edges": ("from_symbol_id", gone_symbols.select(F.col("id").alias("from_symbol_id"))),
            "params": ("symbol_id", gone_symbols.select(F.col("id").alias("symbol_id"))),
            "arg_bindings": ("edge_id", gone_edges.select(F.col("id").alias("edge_id"))),
        }
        merged = {}
        for name, (key, gone) in keys.items():
            table = getattr(old, name)
            merged[name] = table.join(gone, key, "left_anti").select(*table.columns).unionByName(fresh[name].select(*table.columns))
        new = Graph(**merged)
        roots, packages = incremental.roots_and_packages(new)
        change = incremental.resolve_change(old, new, touched, self.store.load("dependencies", manifest), py_roots=roots, packages=packages)
        affected = change["affected"]
        depends = incremental.dependencies(new, roots, packages, affected)
        part = Graph(
            files=fresh["files"], file_text=fresh["file_text"], imports=fresh["imports"], params=fresh["params"], raw_edges=fresh["raw_edges"],
            symbols=cut_lineage(change["symbols"]), edges=cut_lineage(change["edges"].drop("line_text")), arg_bindings=cut_lineage(change["arg_bindings"]),
        )
        rows = snapshot_tables(part, depends)
        rows["symbols"] = rows["symbols"].join(touched, "file_id", "left_semi")
        reach = {"edges": affected, "arg_bindings": affected, "dependencies": affected}
        self.store.update(manifest, {name: (reach.get(name, touched), df) for name, df in rows.items()}, epoch)
