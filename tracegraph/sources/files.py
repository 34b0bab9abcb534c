"""Source trees as rows: listing, ignore rules, contents."""

from __future__ import annotations

import os
import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.functions import paths


def ignore_pattern(rule: str) -> str | None:
    """Regular expression of one ignore rule; NULL for comments and negations."""
    rule = rule.strip()
    if not rule or rule.startswith(("#", "!")):
        return None
    anchored = "/" in rule.rstrip("/")
    folder_only = rule.endswith("/")
    body = re.escape(rule.strip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    start = "^" if anchored else "(^|/)"
    return start + body + ("/" if folder_only else "(/|$)")


def ignored(path, rules: list[str]):
    patterns = [p for p in map(ignore_pattern, rules) if p]
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def scan_listing(listing: DataFrame, scope: list[str] | None = None, max_files: int | None = None, gitignore: list[str] = ()) -> DataFrame:
    """(path, language...) of a listing ``(path, ...)`` without ignored directories and files.

    ``scope`` keeps exact files or everything below a directory; ``max_files``
    keeps the first ones by path.
    """
    path = F.col("path")
    kept = listing.filter(~paths.in_ignored_dir(path) & ~ignored(path, list(gitignore)))
    if scope:
        inside = F.lit(False)
        for s in scope:
            inside = inside | (path == s) | path.startswith(s.rstrip("/") + "/")
        kept = kept.filter(inside)
    kept = kept.withColumn("language", paths.language_of(path))
    return kept.orderBy("path").limit(max_files) if max_files is not None else kept


ENTRY_SCHEMA = "path string, is_dir boolean, n_bytes long"


def list_tree(spark: SparkSession, root: str, gitignore: list[str] = ()) -> DataFrame:
    """(path, n_bytes) of every file below ``root``, listed one directory level per job.

    The built-in file sources hide names that start with '.' or '_', which
    would lose package markers. Ignored directories are not entered, and neither
    are links that lead back to a directory above them. ``root`` is a path or URI
    every executor can reach.
    """
    from tracegraph.session import cut_lineage

    def list_dirs(batches):
        fs, base = _filesystem(root)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in batches:
            rows = []
            for directory in batch["path"]:
                prefix = directory + "/" if directory else ""
                for info in fs.get_file_info(pafs.FileSelector(f"{base}/{directory}".rstrip("/"), allow_not_found=True)):
                    is_dir = info.type == pafs.FileType.Directory
                    if is_dir and local and _leads_back(f"{base}/{prefix}{info.base_name}"):
                        continue
                    rows.append((prefix + info.base_name, is_dir, info.size or 0))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "n_bytes"])

    files = None
    level = spark.createDataFrame([("",)], "path string")
    while True:
        entries = cut_lineage(level.repartition("path").mapInPandas(list_dirs, ENTRY_SCHEMA))
        here = entries.filter(~F.col("is_dir")).select("path", "n_bytes")
        files = here if files is None else files.unionByName(here)
        slashed = F.concat(F.col("path"), F.lit("/x"))
        level = entries.filter(F.col("is_dir") & ~paths.in_ignored_dir(slashed) & ~ignored(F.concat("path", F.lit("/")), list(gitignore))).select("path")
        if level.isEmpty():
            return files


def _leads_back(path: str) -> bool:
    """Whether a directory is a link to one above itself, which would never end."""
    if not os.path.islink(path):
        return False
    above, target = os.path.realpath(os.path.dirname(path)), os.path.realpath(path)
    return above == target or above.startswith(target.rstrip("/") + "/")


def _filesystem(root: str):
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        return fs, base.rstrip("/")
    return pafs.LocalFileSystem(), root.rstrip("/")


READ_BYTES = 16 << 20


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """``listing(path, language, n_bytes)`` with the content of every file.

    A file that cannot be read, or is not UTF-8, stays as a row without content. Rows are
    handed on after every ``READ_BYTES``, however large a batch of paths is.
    """

    def read(batches):
        fs, base = _filesystem(root)
        for batch in batches:
            rows, size = [], 0
            for path, language, n_bytes in zip(batch["path"], batch["language"], batch["n_bytes"]):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    content = None
                rows.append((path, language, content, n_bytes))
                size += n_bytes
                if size > READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "language", "content", "n_bytes"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "language", "content", "n_bytes"])

    return listing.select("path", "language", "n_bytes").mapInPandas(read, "path string, language string, content string, n_bytes long")


def ignore_rules(root: str) -> list[str]:
    fs, base = _filesystem(root)
    if fs.get_file_info(f"{base}/.gitignore").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{base}/.gitignore") as stream:
        return stream.read().decode("utf-8", errors="replace").splitlines()


def read_tree(spark: SparkSession, root: str, scope: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """(path, language, content, n_bytes) of the files below ``root``; only kept files are opened."""
    rules = ignore_rules(root)
    return read_files(scan_listing(list_tree(spark, root, rules), scope, max_files, rules), root)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and corrupt lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
