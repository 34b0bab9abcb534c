"""Command line: index a source tree and ask about it.

    python -m tracegraph ROOT define NAME
    python -m tracegraph ROOT callers NAME [DEPTH]
    python -m tracegraph ROOT callees NAME [DEPTH]
    python -m tracegraph ROOT impact NAME
    python -m tracegraph ROOT summary
    python -m tracegraph ROOT rca symbol:NAME | file:PATH | test:PATH | TEXT
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from tracegraph.api import FAILURE_SCHEMA, CodeGraph
from tracegraph.functions.parsing import failure_spec
from tracegraph.render import table
from tracegraph.session import local_session


def failure_row(spark, root: str, spec: str):
    on_disk = (Path(root) / spec).is_file()
    parsed = spark.range(1).select(failure_spec(F.lit(spec), F.lit(on_disk)).alias("f")).first()["f"]
    kind, value = parsed["kind"], parsed["value"]
    row = dict.fromkeys(("failure_id", "kind", "text", "path", "test_name", "name", "file"))
    row.update(failure_id="cli", kind=kind)
    if kind == "symbol":
        row["name"] = value
    elif kind in ("file", "failing-test"):
        row["path"] = value
    else:
        row["text"] = (Path(root) / spec).read_text() if kind == "stack-trace" else value
    return spark.createDataFrame([tuple(row.values())], FAILURE_SCHEMA)


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print(__doc__)
        return 2
    root, command, *rest = argv
    spark = local_session("tracegraph-cli")
    graph = CodeGraph.from_tree(spark, root)
    depth = int(rest[1]) if len(rest) > 1 and rest[1].isdigit() else None
    commands = {
        "define": lambda: graph.definition_of(rest[0]),
        "callers": lambda: graph.callers_of(rest[0], depth or 2),
        "callees": lambda: graph.callees_of(rest[0], depth or 1),
        "impact": lambda: graph.impact(rest[0]).orderBy(F.desc("risk"), "distance", "file", "name"),
        "summary": graph.summary,
        "rca": lambda: graph.rca(failure_row(spark, root, " ".join(rest))).orderBy("rank"),
    }
    if command not in commands:
        print(__doc__)
        return 2
    print(table(commands[command]()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
