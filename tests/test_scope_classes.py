"""Failures with equal seeds share one scope, and names are looked up inside it."""

from pyspark.sql import functions as F

from tracegraph.operators import history, scope, traverse
from tracegraph.operators.graph import Graph

SEEDS = [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("c", 2, 1), ("c", 1, 2), ("d", 3, 1)]


def frame(spark, rows=SEEDS):
    return spark.createDataFrame(rows, "failure_id string, file_id long, seed_ord long")


def graph(spark):
    files = spark.createDataFrame([(i, f"src/mod_{i}.ts", "typescript", 10) for i in range(1, 8)], "id long, path string, language string, loc int")
    return Graph(files=files)


def test_equal_lists_are_resolved_once(spark):
    seeds = frame(spark)
    imports = spark.createDataFrame([(1, 4, 0), (2, 5, 0), (4, 6, 0), (3, 1, 0), (5, 4, 0)], "from_file long, to_file long, spec_pos int")
    reverse = frame(spark, [("a", 7, 1), ("b", 7, 1), ("c", 7, 2), ("a", 6, 1), ("b", 6, 1)])
    members, own = scope.seed_classes(seeds)
    assert {(r.failure_id, r.class_id) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert own.count() == 5
    rows = lambda s: {tuple(r) for r in s.collect()}
    whole = scope.resolve_scope(graph(spark), seeds, imports, reverse, max_files=5)
    shared = scope.for_members(scope.resolve_scope(graph(spark), own, imports, reverse, max_files=5), members)
    assert rows(whole) == rows(shared)
    of_a = {(r.file_id, r.stage, r.scope_rank) for r in whole.collect() if r.failure_id == "a"}
    assert of_a == {(1, 0, 1), (2, 0, 2), (4, 2, 3), (5, 2, 4), (6, 3, 5)}


def test_classes_are_told_apart_by_symbol(spark):
    seeds = frame(spark).withColumn("symbol", F.when(F.col("failure_id") == "b", None).otherwise(F.lit("f")))
    members, own = scope.seed_classes(seeds, "symbol")
    assert {(r.failure_id, r.class_id) for r in members.collect()} == {(i, i) for i in "abcd"}
    assert own.columns == ["failure_id", "symbol", "file_id", "seed_ord"]


def test_cochange_is_counted_per_file(spark, monkeypatch):
    asked = []
    found = spark.createDataFrame([(1, 5, 3, 1), (1, 6, 2, 2), (2, 5, 2, 1)], "seed_id long, file_id long, n long, cochange_rank long")
    monkeypatch.setattr(history, "cochanged_files", lambda g, seeds, *rest: asked.append(seeds.count()) or found)
    got = {tuple(r) for r in scope.default_cochange(graph(spark), frame(spark)).collect()}
    assert asked == [3]
    assert got == {("a", 5, 1001), ("a", 6, 1002), ("b", 5, 1001), ("b", 6, 1002), ("c", 5, 1001), ("c", 6, 2002)}


def test_names_are_looked_up_in_the_files_of_a_scope(spark):
    symbols = spark.createDataFrame([(i, i % 50, "same") for i in range(1000)], "id long, file_id long, name string")
    within = traverse.Scope(spark.createDataFrame([("s", 3), ("t", 4), ("t", 5)], "scope_id string, file_id long"))
    seeds = spark.createDataFrame([("s", "same"), ("t", "same")], "seed_id string, name string")
    nodes = traverse.seed_nodes(Graph(symbols=symbols), seeds, within)
    assert {(r.seed_id, r.node_id % 50) for r in nodes.collect()} == {("s", 3), ("t", 4), ("t", 5)} and nodes.count() == 60
    # The symbols are joined once, with the files, and not first with every seed of their name.
    joins = [line for line in nodes._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert any("name" in j and "file_id" in j for j in joins)
