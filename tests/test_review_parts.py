"""Affected nodes of pull requests are counted by name, without a row per pull request and node."""

from pyspark.sql import functions as F

from tracegraph.operators import impact, review, traverse
from tracegraph.sources.starview import StarGraph

DIRECTORY = "/root/testdata/sf0.001"


def test_affected_equals_counting_the_nodes(spark):
    g = StarGraph(spark, DIRECTORY)
    parts = review.review(g, g.patches.filter("pr_id % 40 = 0"), parts=("nodes", "affected"))
    want = parts["nodes"].groupBy("pr_id").agg(F.count_if(F.col("distance") > 0)).collect()
    assert want and sorted(map(tuple, parts["affected"].collect())) == sorted(map(tuple, want))


def test_affected_does_not_walk_with_a_row_per_node(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a walk with a row per seed and node")

    monkeypatch.setattr(traverse, "reach", refuse)
    monkeypatch.setattr(impact, "callers_of", refuse)
    g = StarGraph(spark, DIRECTORY)
    assert review.review(g, g.patches.filter("pr_id = 40"), parts=("affected",))["affected"].count() == 1
