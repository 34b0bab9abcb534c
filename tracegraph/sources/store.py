"""Writing, replacing and caching graph tables."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 7
TABLES = ["files", "symbols", "edges", "imports", "params", "arg_bindings", "file_text"]


def save_graph(tables: dict[str, DataFrame], root: str, repo_id: str) -> None:
    """Replace one repository's tables; other repositories stay untouched.

    A repository is one folder of each table and is overwritten as such, so a table
    without rows leaves none behind.
    """
    for name, df in tables.items():
        folder = f"{root}/{name}/repo_id={quote(repo_id, safe='')}"
        df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(folder)


def load_table(spark: SparkSession, root: str, name: str, repo_id: str | None = None) -> DataFrame:
    """One table of one repository; a different schema version is refused."""
    df = spark.read.parquet(f"{root}/{name}")
    if repo_id is not None:
        df = df.filter(F.col("repo_id") == repo_id)
    other = df.filter(F.col("schema_version") != SCHEMA_VERSION).select("schema_version").limit(1).collect()
    if other:
        raise ValueError(f"{root}/{name} has schema version {other[0][0]}, expected {SCHEMA_VERSION}; index again")
    return df.drop("schema_version", "repo_id")


def repositories(spark: SparkSession, root: str) -> DataFrame:
    """Repositories found in a store."""
    return spark.read.parquet(f"{root}/files").select("repo_id").distinct()


def replace_files(table: DataFrame, touched: DataFrame, fresh: DataFrame | None, key: str = "file_id") -> DataFrame:
    """The table without the rows of ``touched`` files plus the new rows; None only deletes."""
    kept = table.join(touched, key, "left_anti")
    return kept if fresh is None else kept.unionByName(fresh.select(*table.columns))


def drop_symbols(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges after symbols are gone: outgoing ones vanish, incoming ones lose their target."""
    kept = edges.join(removed.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_anti")
    flags = removed.select(F.col("id").alias("to_symbol_id"), F.lit(True).alias("_gone")).distinct()
    return (
        kept.join(flags, "to_symbol_id", "left")
        .withColumn("to_symbol_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("to_symbol_id")))
        .select(*edges.columns)
    )


def cache_split(current: DataFrame, cache: DataFrame) -> dict[str, DataFrame]:
    """Files whose cached extraction is still valid, and the others. ``(path, sha)`` on both sides."""
    return {"hits": current.join(cache, ["path", "sha"]), "misses": current.join(cache.select("path", "sha"), ["path", "sha"], "left_anti")}


def parse_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a ``value`` column of JSON lines; blank and corrupt lines are dropped."""
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    )
    return parsed.filter(F.col("r._corrupt").isNull() & F.col("r").isNotNull()).select("r.*").drop("_corrupt")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side file that may be missing."""
    from tracegraph.sources.files import _exists

    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
