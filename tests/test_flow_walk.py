"""A flow walk ends for a seed when all its names are met."""

from pyspark.sql import functions as F

from tracegraph.operators import causal, packed
from tracegraph.operators.graph import Graph


def test_settled_seeds_walk_no_further(spark, monkeypatch):
    # 10 -> 9 -> ... -> 1 -> 0; 2 also hands an argument to 0's caller, and two symbols are called n3.
    symbols = spark.createDataFrame([(i, f"n{i}", i) for i in range(11)] + [(20, "n3", 20)], "id long, name string, file_id long")
    calls = [(f"e{i}", i + 1, i, "CALLS", 1.0, 1) for i in range(10)] + [("x", 30, 40, "CALLS", 1.0, 1), ("y", 1, 40, "CALLS", 1.0, 2), ("z", 20, 2, "CALLS", 1.0, 2)]
    edges = spark.createDataFrame(calls, "id string, from_symbol_id long, to_symbol_id long, kind string, confidence double, call_line int")
    args = spark.createDataFrame([("y", "identifier", 2)], "edge_id string, source_kind string, source_symbol_id long")
    graph = Graph(symbols=symbols, edges=edges, arg_bindings=args)
    rows = [("a", "n0", "anchor"), ("a", "n1", "caller"), ("a", "n2", "caller"), ("a", "len", "callee"), ("b", "n1", "anchor"), ("b", "n2", "caller")]
    candidates = spark.createDataFrame(rows, "seed_id string, name string, role string")
    levels = []
    monkeypatch.setattr(packed, "without", lambda bits, seen, f=packed.without: levels.append(1) or f(bits, seen))
    found = lambda df: {tuple(r) for r in df.select("seed_id", "name", "arg_hops").collect()}
    got = found(packed.dataflow_hops(graph, candidates, 4))
    assert got == found(causal.dataflow_hops(graph, candidates)) == {("a", "n1", 0), ("a", "n2", 0), ("b", "n2", 0)}
    # A level masks seen bits once, earlier ways once when it is written and once when it settles, and open bits once.
    assert len(levels) == 2 * 4
    deeper = candidates.unionByName(spark.createDataFrame([("b", "n5", "caller"), ("a", "n3", "caller")], candidates.schema))
    assert found(packed.dataflow_hops(graph, deeper, 4)) == found(causal.dataflow_hops(graph, deeper))
