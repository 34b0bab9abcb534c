"""From source files to graph tables.

Reading one file is a small Python helper applied per row; identities,
parents, promotion of parameters and everything between files are joins and
projections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions import text as tx
from tracegraph.functions.paths import dirname, language_of, prefixes
from tracegraph.operators.shared import first_per_key
from tracegraph.sources.python_source import python_facts
from tracegraph.sources.typescript_source import typescript_facts

# Language name -> function(source) with symbols, edges, imports and params.
EXTRACTORS: dict[str, Callable] = {"python": python_facts, "typescript": typescript_facts}

# Source text whose facts one worker holds at a time: as Python objects they take some
# fifty times its size. A file counts as a line at least.
FACT_BYTES, LINE_BYTES = 256 << 10, 64

STORED = ["files", "file_text", "symbols", "raw_edges", "imports", "params", "arg_bindings"]

FACTS_SCHEMA = """
    path string, language string, content string,
    symbols array<struct<idx:int,name:string,kind:string,parent_idx:int,start_line:int,end_line:int,signature:string,exported:boolean,type_text:string>>,
    edges array<struct<from_idx:int,to_name:string,kind:string,call_line:int,line_text:string,
        args:array<struct<position:int,source_kind:string,source_text:string>>>>,
    imports array<struct<local_name:string,source_module:string,source_name:string,kind:string>>,
    params array<struct<owner_idx:int,position:int,name:string,type_text:string,has_default:boolean>>, error string"""


def register(language: str, extractor: Callable) -> None:
    """Add a language; ``functions.fixed`` maps file extensions to it."""
    EXTRACTORS[language] = extractor


def fact_batches(batches: Iterator[pd.DataFrame], extractors: dict[str, Callable]) -> Iterator[pd.DataFrame]:
    """Nested rows of the files (path, language, content), in parts of about FACT_BYTES of source."""
    empty = dict(symbols=[], edges=[], imports=[], params=[])
    for batch in batches:
        rows, size = [], 0
        for path, language, content in zip(batch["path"], batch["language"], batch["content"]):
            found, error = None, None
            try:
                found = extractors[language](content) if language in extractors and content else None
            except Exception as failure:  # noqa: BLE001 - one file must not end the job
                error = f"{type(failure).__name__}: {failure}"[:200]
            part = {k: getattr(found, k) for k in empty} if found else empty
            rows.append(dict(path=path, language=language, content=content, error=error, **part))
            size += len(content) + LINE_BYTES
            if size > FACT_BYTES:
                yield pd.DataFrame(rows, columns=["path", "language", "content", *empty, "error"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "language", "content", *empty, "error"])


def facts(sources: DataFrame) -> DataFrame:
    """One nested row per file ``sources(path, content)``; unknown languages keep an empty row.

    A file without content has the language ``unparsed``; one whose extraction fails keeps
    an empty row that says why in ``error``.
    """
    extractors = dict(EXTRACTORS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fact_batches(batches, extractors)

    known = F.when(F.col("content").isNull(), F.lit("unparsed")).otherwise(language_of(F.col("path")))
    rows = sources.select("path", known.alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    return rows.mapInPandas(read, FACTS_SCHEMA)


def file_key(path: Column) -> Column:
    return F.xxhash64(path)


def subsystems(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Name of the nearest package manifest above each file, else its top directory, else 'root'.

    ``manifests(path, content)`` are package.json and pyproject.toml files.
    """
    base = F.substring_index("path", "/", -1)
    name = F.when(base == "package.json", F.get_json_object("content", "$.name")).when(
        base == "pyproject.toml", F.nullif(F.regexp_extract("content", r"(?m)^\s*name\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    )
    named = manifests.select(dirname(F.col("path")).alias("dir"), name.alias("subsystem"), F.when(base == "package.json", 0).otherwise(1).alias("prio"))
    best = first_per_key(named.filter((F.length("subsystem") > 0) & (F.col("dir") != "")), ["dir"], ["prio"]).drop("prio")
    dirs = files.select("path", F.explode(prefixes(F.col("path"))).alias("dir"))
    nearest = first_per_key(dirs.join(best, "dir").withColumn("d", F.length("dir")), ["path"], [-F.col("d")]).select("path", "subsystem")
    top = F.when(dirname(F.col("path")) == "", F.lit("root")).otherwise(F.substring_index("path", "/", 1))
    return files.select("path").join(nearest, "path", "left").select("path", F.coalesce("subsystem", top).alias("subsystem"))


def graph_tables(sources: DataFrame, manifests: DataFrame | None = None, cached: DataFrame | None = None) -> dict[str, DataFrame]:
    """All stored tables of ``sources(path, content)``.

    ``cached`` are nested fact rows of unchanged files; only the other sources
    are read again.
    """
    from tracegraph.session import cut_lineage

    fresh = facts(sources)
    nested = cut_lineage(fresh if cached is None else fresh.unionByName(cached.select(*fresh.columns)))
    fid = file_key(F.col("path"))
    files = nested.select(
        fid.alias("id"), "path", "language",
        F.when(dirname(F.col("path")) == "", F.lit("root")).otherwise(F.substring_index("path", "/", 1)).alias("subsystem"),
        tx.line_count(F.col("content")).alias("loc"),
    )
    if manifests is not None:
        files = files.drop("subsystem").join(subsystems(files, manifests), "path").select("id", "path", "language", "subsystem", "loc")

    def symbol_id(idx: Column) -> Column:
        return F.xxhash64(F.col("path"), F.lit("symbol"), idx)

    flat = nested.select("path", fid.alias("file_id"), F.explode("symbols").alias("s"))
    symbols = flat.select(
        symbol_id(F.col("s.idx")).alias("id"), "file_id", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"),
        F.when(F.col("s.parent_idx").isNotNull(), symbol_id(F.col("s.parent_idx"))).alias("parent_id"), "s.start_line", "s.end_line", "s.signature",
        "s.exported", "s.type_text",
    )
    owned = nested.select("path", fid.alias("file_id"), "symbols", F.explode("params").alias("p"))
    owner = F.element_at("symbols", F.col("p.owner_idx") + 1)
    param_id = F.xxhash64(F.col("path"), F.lit("param"), F.col("p.owner_idx"), F.col("p.position"), F.col("p.name"))
    promoted = owned.select(
        param_id.alias("id"), "file_id", F.col("p.name").alias("name"), F.lit("param").alias("kind"), symbol_id(F.col("p.owner_idx")).alias("parent_id"),
        owner["start_line"].alias("start_line"), owner["end_line"].alias("end_line"), F.lit(None).cast("string").alias("signature"),
        F.lit(False).alias("exported"), F.col("p.type_text").alias("type_text"),
    )
    params = owned.select(
        param_id.alias("id"), symbol_id(F.col("p.owner_idx")).alias("symbol_id"), "p.position", "p.name", "p.type_text", "p.has_default"
    )
    calls = nested.select("path", F.posexplode("edges").alias("n", "e"))
    edge_id = F.concat(F.xxhash64("path").cast("string"), F.lit("-"), F.col("n").cast("string"))
    raw_edges = calls.select(
        edge_id.alias("id"), symbol_id(F.col("e.from_idx")).alias("from_symbol_id"), F.lit(None).cast("long").alias("to_symbol_id"), "e.to_name", "e.kind",
        F.lit(1.0).alias("confidence"), "e.call_line", F.lit(None).cast("string").alias("resolution_kind"), "e.line_text",
    )
    arg_bindings = calls.select(edge_id.alias("edge_id"), F.explode("e.args").alias("a")).select(
        "edge_id", "a.position", "a.source_kind", "a.source_text", F.lit(None).cast("long").alias("source_symbol_id")
    )
    imports = nested.select("path", fid.alias("file_id"), F.posexplode("imports").alias("n", "i")).select(
        F.col("n").cast("long").alias("id"), "file_id", "i.local_name", "i.source_module", "i.source_name", "i.kind"
    )
    tables = {"files": files, "symbols": symbols.unionByName(promoted), "raw_edges": raw_edges, "imports": imports, "params": params, "arg_bindings": arg_bindings}
    # Spark knows the bytes of the nested rows as stored, which says nothing about the rows
    # they unfold to: without the hint joins would broadcast all symbols.
    return {name: df.hint("merge") for name, df in tables.items()} | {
        "file_text": nested.select(fid.alias("id"), "path", "language", "content"), "facts": nested,
    }
