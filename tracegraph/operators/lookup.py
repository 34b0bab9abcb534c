"""Point queries: definitions, symbols of a file, graph export, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions import paths, signals
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.shared import first_per_key, top_k

DEFINITION_ORDER = ["exported_rank", "path", "start_line", "id"]


def definition_of(graph: Graph, name: str, language: str | None = None, subsystem: str | None = None) -> DataFrame:
    """Definitions of a name, exported ones first, then by path and line."""
    found = graph.symbols.filter(F.col("name") == name)
    files = graph.files
    if language is not None:
        files = files.filter(F.col("language") == language)
    if subsystem is not None:
        files = files.filter(F.col("subsystem") == subsystem)
    joined = found.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "language", "subsystem"), "file_id")
    return joined.select(
        "name", "kind", "file", "start_line", "end_line", "signature", "exported", "language", "subsystem"
    ).orderBy(F.desc("exported"), "file", "start_line")


def first_definitions(graph: Graph, names: DataFrame) -> DataFrame:
    """First definition of every name of ``names(name)``."""
    wanted = names.select("name").distinct()
    defs = symbols_with_path(graph).join(wanted, "name", "left_semi")
    keyed = defs.select(
        "name", F.when(F.col("exported"), 0).otherwise(1).alias("exported_rank"), "path", "start_line", "end_line",
        "id", "file_id", "kind", "subsystem",
    )
    return first_per_key(keyed, ["name"], DEFINITION_ORDER).drop("exported_rank")


def symbols_in_file(graph: Graph, path: str) -> DataFrame:
    files = graph.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
    return (
        graph.symbols.join(files, "file_id")
        .orderBy("start_line", "id")
        .select("name", "kind", "start_line", "end_line", "signature", "exported")
    )


def search_symbols(graph: Graph, fragment: str, limit: int = 12) -> DataFrame:
    """First symbols whose name contains the fragment, ignoring case."""
    hit = F.contains(F.lower("name"), F.lit(fragment.lower()))
    return graph.symbols.filter(hit).orderBy("id").limit(limit).select("id", "name", "kind")


def graph_export(graph: Graph, max_symbols: int = 800) -> dict[str, DataFrame]:
    """The most prominent symbols with their files and outgoing edges.

    ``symbols`` holds the top rows by exported, then span; ``files`` the parsed
    files they live in; ``edges`` what leaves them, with targets outside the
    selection set to NULL; ``summary`` whether anything was left out.
    """
    limit = max(50, min(5000, max_symbols))
    parent = graph.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    span = F.col("end_line") - F.col("start_line")
    chosen = graph.symbols.orderBy(F.desc("exported"), span.desc(), "id").limit(limit)
    symbols = chosen.join(parent, "parent_id", "left").select(
        "id", "name", "kind", "file_id", "start_line", "end_line", "signature", "exported", "parent_name"
    )
    ids = chosen.select("id")
    files = graph.files.filter(F.col("language") != "unparsed").join(
        chosen.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi"
    )
    kept_target = ids.select(F.col("id").alias("to_symbol_id"), F.lit(True).alias("_kept"))
    edges = (
        graph.edges.join(ids.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")
        .join(kept_target, "to_symbol_id", "left")
        .withColumn("to_symbol_id", F.when(F.col("_kept"), F.col("to_symbol_id")))
        .select("id", "from_symbol_id", "to_symbol_id", "to_name", "kind", "confidence", "call_line")
    )
    summary = graph.symbols.agg(F.count(F.lit(1)).alias("total_symbols")).select(
        "total_symbols", (F.col("total_symbols") > limit).alias("truncated")
    )
    return {"symbols": symbols, "files": files, "edges": edges, "summary": summary}


def session_summary(graph: Graph, primary_symbol: str | None = None) -> DataFrame:
    """Counts of the graph tables; unparsed files are listed apart."""
    counts = [
        graph.files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language") == "unparsed").alias("u")).select(
            F.stack(F.lit(2), F.lit("files"), F.col("n"), F.lit("unparsed_files"), F.col("u")).alias("metric", "value")
        )
    ]
    for label, df in (("symbols", graph.symbols), ("edges", graph.edges), ("imports", graph.imports)):
        counts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(label).alias("metric"), "value"))
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def degrees(graph: Graph) -> DataFrame:
    """Edges touching every symbol that has any; a self-call counts twice."""
    ends = graph.edges.select(F.col("from_symbol_id").alias("id")).unionByName(
        graph.edges.filter(F.col("to_symbol_id").isNotNull()).select(F.col("to_symbol_id").alias("id"))
    )
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def file_degrees(graph: Graph, limit: int = 30) -> DataFrame:
    """Files with the highest total degree."""
    per_file = graph.symbols.join(degrees(graph), "id").groupBy("file_id").agg(F.sum("degree").alias("degree"))
    return per_file.orderBy(F.desc("degree"), "file_id").limit(limit)


def label_candidates(graph: Graph, per_file: int = 5, files: int = 30, limit: int = 80, anchor_id: int | None = None) -> DataFrame:
    """Symbols worth a label: the best connected of the best connected files, the anchor first."""
    wanted = file_degrees(graph, files).select("file_id")
    nodes = graph.symbols.join(F.broadcast(wanted), "file_id", "left_semi").join(degrees(graph), "id")
    top = top_k(nodes.select("id", "name", "file_id", "degree"), ["file_id"], [F.desc("degree"), F.asc("id")], per_file)
    first = F.when(F.col("id") == anchor_id, 0).otherwise(1) if anchor_id is not None else F.lit(0)
    return top.orderBy(first, F.desc("degree"), "id").limit(limit)


def file_clusters(graph: Graph, positions: DataFrame, limit: int = 24) -> DataFrame:
    """Centre of every file with two placed symbols or more. ``positions(id, x, y)``."""
    placed = graph.symbols.filter(~F.col("kind").isin("param", "local")).join(positions, "id")
    return (
        placed.groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        .filter(F.col("size") >= 2)
        .orderBy(F.desc("size"), "file_id")
        .limit(limit)
    )


def phantom_nodes(graph: Graph) -> DataFrame:
    """Unresolved call targets as nodes, one per name."""
    return graph.edges.filter(F.col("to_symbol_id").isNull()).select(F.col("to_name").alias("name")).distinct()


def folders(graph: Graph) -> DataFrame:
    """Every directory of the indexed files with its parent ('' at the top)."""
    exploded = graph.files.select(F.explode(paths.prefixes(F.col("path"))).alias("folder")).distinct()
    return exploded.select("folder", paths.basename(F.col("folder")).alias("name"), paths.dirname(F.col("folder")).alias("parent"))


def contains_edges(graph: Graph) -> DataFrame:
    """Folder to folder, folder to file, file to symbol."""
    tree = folders(graph).filter(F.col("parent") != "").select(
        F.concat(F.lit("d:"), F.col("parent")).alias("source"), F.concat(F.lit("d:"), F.col("folder")).alias("target")
    )
    parent = paths.dirname(F.col("path"))
    in_folder = graph.files.filter(parent != "").select(
        F.concat(F.lit("d:"), parent).alias("source"), F.concat(F.lit("f:"), F.col("id").cast("string")).alias("target")
    )
    in_file = graph.symbols.select(
        F.concat(F.lit("f:"), F.col("file_id").cast("string")).alias("source"),
        F.concat(F.lit("s:"), F.col("id").cast("string")).alias("target"),
    )
    return tree.unionByName(in_folder).unionByName(in_file)


def node_styles(graph: Graph) -> DataFrame:
    loc = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    return graph.symbols.select("id", signals.node_size(loc).alias("size"))


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that start in ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")


def session_discovery(files: DataFrame, limit: int = 200) -> DataFrame:
    """Stores found in a listing ``files(path)``; hidden directories are skipped."""
    hidden = F.exists(F.split(paths.dirname(F.col("path")), "/"), lambda seg: seg.startswith("."))
    return files.filter(F.col("path").endswith(".sqlite") & ~hidden).orderBy("path").limit(limit)
