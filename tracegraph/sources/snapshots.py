"""Versions of a repository's tables that switch together.

Tables are Parquet folders cut by file into buckets. A version is one small JSON file that
names the folder of every bucket of every table; it becomes the newest by being renamed to
the next free number, which one writer alone can win. Readers stay with the version they
opened, a writer that dies leaves folders no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegraph.sources.store import SCHEMA_VERSION

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class SnapshotStore:
    """The versions below ``root``. Every table has a column ``file_id``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- files ---------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Contents of a version, the newest by default; an empty store has version 0 without tables."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "schemas": {}, "buckets": self.buckets, "batch": None, "schema_version": SCHEMA_VERSION}
        stream = self._fs().open(self._path(f"_versions/{version:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"{self.root} has schema version {found['schema_version']}, expected {SCHEMA_VERSION}; index again")
        return found

    # -- reading -------------------------------------------------------------

    def load(self, table: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, all of it or some buckets."""
        manifest = manifest or self.manifest()
        schema = StructType.fromJson(manifest["schemas"][table])
        folders = [f"{self.root}/{folder}" for b, folder in manifest["tables"][table].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------

    def _write(self, tables: dict[str, DataFrame], buckets: int) -> dict[str, dict[str, str]]:
        """The tables in a new folder, one subfolder per bucket that has rows."""
        folder, found = f"data/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            bucketed = df.withColumn("_bucket", F.pmod("file_id", F.lit(buckets)).cast("int"))
            bucketed.repartition("_bucket", F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}/{name}")
            parts = [n for n in self._names(f"{folder}/{name}") if n.startswith("_bucket=")]
            found[name] = {n[len("_bucket="):]: f"{folder}/{name}/{n}" for n in parts}
        return found

    def _publish(self, manifest: dict, base: int) -> int:
        """Make a manifest version ``base`` + 1; fails if that exists."""
        manifest = {**manifest, "version": base + 1}
        draft, final = self._path(f"_drafts/{uuid.uuid4().hex}.json"), self._path(f"_versions/{base + 1:012d}.json")
        fs = self._fs()
        fs.mkdirs(final.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, options)
        except Exception as error:
            if fs.exists(final):
                fs.delete(draft, False)
                raise Conflict(f"version {base + 1} of {self.root} was made by another writer") from error
            raise
        return base + 1

    def replace(self, tables: dict[str, DataFrame], batch: int | None = None) -> int:
        """A version that holds these tables and nothing else."""
        base = max(self.versions(), default=0)
        manifest = self.manifest(0)
        manifest |= {"tables": self._write(tables, self.buckets), "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}, "batch": batch}
        return self._publish(manifest, base)

    def update(self, manifest: dict, changes: dict[str, tuple[DataFrame, DataFrame]], batch: int | None = None) -> int:
        """The version after ``manifest`` in which some files' rows are others.

        ``changes`` gives per table the files (file_id) whose rows go and the rows that come.
        Only their buckets are written again; the others are named as they are.
        """
        n = manifest["buckets"]
        written, tables = {}, {name: dict(parts) for name, parts in manifest["tables"].items()}
        for name, (gone, fresh) in changes.items():
            slots = gone.select("file_id").unionByName(fresh.select("file_id")).select(F.pmod("file_id", F.lit(n)).cast("int").alias("b")).distinct()
            hit = [r.b for r in slots.collect()]  # at most as many as there are buckets
            if not hit:
                continue
            kept = self.load(name, manifest, hit).join(gone.select("file_id").distinct(), "file_id", "left_anti")
            schema = StructType.fromJson(manifest["schemas"][name])
            written[name] = kept.select(*schema.fieldNames()).unionByName(fresh.select(*schema.fieldNames()))
            for b in hit:
                tables[name].pop(str(b), None)
        for name, parts in self._write(written, n).items():
            tables[name] |= parts
        return self._publish({**manifest, "tables": tables, "batch": batch if batch is not None else manifest["batch"]}, manifest["version"])

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions before the newest ``keep``, and folders that none of the kept ones names; returns how many folders went.

        Not to be run while a writer works: its folders have no version yet.
        """
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        named = {folder.split("/")[1] for v in kept for parts in self.manifest(v)["tables"].values() for folder in parts.values()}
        for v in versions[: len(versions) - len(kept)]:
            self._fs().delete(self._path(f"_versions/{v:012d}.json"), False)
        gone = [name for name in self._names("data") if name not in named]
        for name in gone:
            self._fs().delete(self._path(f"data/{name}"), True)
        return len(gone)
