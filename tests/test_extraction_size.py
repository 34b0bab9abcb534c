"""Memory of extraction: facts leave a worker in small parts, joins of unfolded rows are not broadcast."""

import pandas as pd

from tracegraph.sources import extraction


def test_facts_leave_in_small_parts():
    code = "".join(f"def f{i}(a, b=1):\n    x = a\n    g(x, h(b))\n\n" for i in range(16))
    files = pd.DataFrame({"path": [f"m{i}.py" for i in range(3000)], "language": "python", "content": code})
    sizes = [len(part) for part in extraction.fact_batches(iter([files]), extraction.EXTRACTORS)]
    assert sum(sizes) == 3000
    assert max(sizes) * len(code) <= extraction.FACT_BYTES + len(code)
    empty = pd.concat([files.assign(content="")] * 4)
    assert max(len(part) for part in extraction.fact_batches(iter([empty]), extraction.EXTRACTORS)) <= extraction.FACT_BYTES // extraction.LINE_BYTES + 1


def test_unfolded_rows_are_not_broadcast(spark):
    rows = [(f"m{i}.py", f"def f{i}(a):\n    g(a)\n") for i in range(50)]
    tables = extraction.graph_tables(spark.createDataFrame(rows, "path string, content string"))
    owner = tables["symbols"].select("id", "file_id").toDF("from_symbol_id", "file_id")
    where = tables["files"].select("id", "path").toDF("file_id", "path")
    found = tables["arg_bindings"].join(tables["raw_edges"].withColumnRenamed("id", "edge_id"), "edge_id").join(owner, "from_symbol_id").join(where, "file_id")
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3
