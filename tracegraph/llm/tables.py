"""Reading tables, and writing intermediate ones where every executor can reach them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracegraph.session import checkpoint_dir, shuffles_deleted

# A key with more than this share of the rows counts as hot. At most 1 / HOT_SHARE
# keys can exceed it, so a table of the hot keys is small at every input size.
HOT_SHARE = 0.001


def quoted(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among those of ``gone``, a frame of one column; rows without a key stay.

    The keys are written first: Spark knows their size then, and leaves the rows where they
    are if it is below its threshold for broadcasts.
    """
    name = unused("_gone", df.columns)
    return df.join(saved(gone.toDF(name).distinct(), "gone"), quoted(key) == quoted(name), "left_anti")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder of spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


# Rows of a narrow table per written file, where their number is known.
ROWS_PER_FILE = 500_000


def saved(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again.

    Later steps read the files, so a lost executor repeats none of the work before them.
    ``rows`` is what a narrow table holds at most; it is then written in so many files as
    that takes, instead of one for each of many small tasks.
    """
    path = shared_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_counts(df: DataFrame, key: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """(key, pieces) of the keys with more than ``share`` of ``total`` rows.

    ``pieces`` says into how many parts a key's rows are to be split; over all
    hot keys the parts number at most 1 / share.
    """
    limit = max(1.0, total * share)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return counts.select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("pieces"))


def map_texts(df: DataFrame, keep: list[str], text: str, compute: Callable, fields: str, rows: int = 2000) -> DataFrame:
    """``keep`` columns unchanged, then the columns of ``compute(texts)``.

    ``compute`` gets a list of texts (None for null) and returns one sequence per
    field of ``fields`` (a DDL string). Batches are cut to ``rows`` texts, so what a
    worker holds does not depend on the size of the input.
    """
    # Plain names on the way in, whatever the columns are called.
    source = df.select(*[quoted(c) for c in keep], quoted(text)).toDF(*[f"c{i}" for i in range(len(keep))], "text")
    kept = df.select(*[quoted(c) for c in keep]).schema
    made = StructType.fromDDL(fields)
    types = [f.type for f in to_arrow_schema(made)]
    names = [*keep, *made.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = compute(part.column(len(keep)).to_pylist())
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(c, type=t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, StructType([*kept.fields, *made.fields]))


def keep_texts(df: DataFrame, text: str, wanted: Callable) -> DataFrame:
    """The rows for which ``wanted(texts)``, one boolean per text, is true; columns unchanged."""
    name = unused("_kept", df.columns)
    marked = map_texts(df, df.columns, text, lambda texts: [wanted(texts)], f"{name} boolean")
    return marked.filter(quoted(name)).drop(name)


def sample_rows(df: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows, the same number for every label; all of a rare label.

    A row is drawn by a hash of its contents, so a repeated job draws the same rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    each = rows / max(1, len(counts))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(draw < share)
