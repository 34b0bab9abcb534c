"""Rows unfolded from a small table are never broadcast."""

from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import functions as F

from tracegraph.llm import simhash


def plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_variants_and_masks_join_by_shuffle(spark):
    prints = spark.range(0, 2000).select(F.xxhash64("id").alias("fp"))
    found = simhash.buckets(prints)
    assert "BroadcastExchange" not in plan(found)
    assert "BroadcastExchange" not in plan(simhash._stars(found))


def test_buckets_hold_shared_variants(spark):
    rows = spark.createDataFrame([(0,), (1,), (1 << 40,)], "fp long")
    got = {(r["slot"], r["fp"], r["n"]) for r in simhash.buckets(rows).collect()}
    # 0 and 1 differ in bit 0 of the low half; 0 and 2^40 in the high half only.
    low = {(s, fp, 2) for s in range(1, 32) for fp in (0, 1 << 40)} | {(0, fp, 3) for fp in (0, 1, 1 << 40)}
    assert got == low | {(32, 0, 2), (32, 1, 2)}
