"""Shuffle files of a step are deleted once its table is written."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracegraph.llm.tables import saved
from tracegraph.session import SHUFFLE_CLEANUP, cut_lineage


def shuffle_bytes(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in blocks for f in Path(d.getPath()).rglob("shuffle_*") if f.exists())


@pytest.mark.parametrize("keep", [cut_lineage, lambda df: saved(df, "test")])
def test_a_written_step_leaves_no_shuffle_files(spark, keep):
    before = shuffle_bytes(spark)
    sums = spark.range(400_000).groupBy((F.col("id") % 100_000).alias("k")).agg(F.max(F.xxhash64("id")).alias("s"))
    kept = keep(sums)
    for _ in range(50):
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before
    assert kept.count() == 100_000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
