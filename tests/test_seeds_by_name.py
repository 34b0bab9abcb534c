"""Seeds that share a name are walked once."""

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import enrich, traverse
from tracegraph.plans import QUERIES
from tracegraph.sources.starview import StarGraph

# The smaller tables have no name twice.
SMALL, DIRECTORY = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture()
def starts(monkeypatch):
    """(rows, symbols) each walk begins with."""
    seen, plain = [], traverse.seed_nodes

    def counted(graph, seeds, within=None):
        nodes = plain(graph, seeds, within)
        seen.append((nodes.count(), nodes.select("node_id").distinct().count()))
        return nodes

    monkeypatch.setattr(traverse, "seed_nodes", counted)
    return seen


def test_callers_of_all_classes_are_found_by_name(spark, starts):
    g = StarGraph(spark, DIRECTORY)
    got = QUERIES["g01_callers_of_all_classes"](spark, DIRECTORY).collect()
    assert starts and all(n == symbols for n, symbols in starts)
    seeds = g.symbols.filter("kind = 'class'").select(F.col("id").alias("seed_id"), "name")
    want = traverse.callers_of(g, seeds).groupBy("seed_id", "depth").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_neighbours_of_candidates_are_found_by_name(spark, starts):
    g = StarGraph(spark, SMALL)
    located = g.symbols.filter("kind = 'class'").join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    plain = located.select(F.col("id").alias("cand_id"), "file", "name", F.lit(None).cast("int").alias("line"))
    again = plain.unionByName(plain.withColumn("cand_id", -F.col("cand_id") - 1)).unionByName(plain.withColumn("cand_id", F.col("cand_id") + 10**6))
    rows = {r["cand_id"]: (r["name"], r["callers"], r["callees"]) for r in enrich.enrich(g, again).collect()}
    assert starts and all(n == symbols for n, symbols in starts)
    assert len(rows) == 3 * plain.count() and any(callers for _, callers, _ in rows.values())
    assert all(rows[k] == rows[-k - 1] == rows[k + 10**6] for k in rows if 0 <= k < 10**6)
