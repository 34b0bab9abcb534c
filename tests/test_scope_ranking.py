"""Ranking inside a failure's own files, and what is said about its scope."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracegraph.api import FAILURE_SCHEMA, CodeGraph
from tracegraph.operators import traverse
from tracegraph.sources.extraction import file_key

SOURCES = {
    "app/__init__.py": "",
    "app/entry.py": "from .core import save\n\ndef handle(x):\n    return save(x)\n",
    "app/core.py": "from .disk import write\n\ndef save(x):\n    return write(x)\n",
    "app/disk.py": "def write(x):\n    return flush(x)\n\ndef flush(x):\n    return x\n",
    "app/far.py": "import app.core\n\ndef elsewhere(x):\n    return flush(x)\n",
    "app/twin.py": "def lonely(x):\n    return 1\n",
    "app/bare.py": "VALUE = 1\n",
    "lib/other.py": "from app.disk import flush\n\ndef outside(x):\n    return flush(x)\n",
}
WHEN = datetime.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def code(spark):
    commits = [(i, f"sha{i}", "dev", WHEN - datetime.timedelta(days=i), "fix", False) for i in range(1, 5)]
    lines = spark.createDataFrame([(i, p, 1, 2) for i in range(1, 5) for p in ("app/core.py", "app/twin.py")], "commit_id long, path string, start_line int, end_line int")
    return CodeGraph.from_sources(
        spark.createDataFrame(list(SOURCES.items()), "path string, content string"),
        spark.createDataFrame(commits, "commit_id long, sha string, author string, date timestamp, subject string, is_merge boolean"),
        lines.withColumn("file_id", file_key(F.col("path"))).drop("path"), as_of=F.lit(WHEN),
    )


def failures(spark, *rows):
    return spark.createDataFrame([(i, k, t, p, None, n, None) for i, k, t, p, n in rows], FAILURE_SCHEMA)


def test_walks_stay_in_their_scope(code, spark):
    graph = code.graph
    ids = {r.path: r.id for r in graph.files.collect()}
    scopes = [("wide", p) for p in ids] + [("narrow", "app/disk.py"), ("narrow", "app/core.py")]
    within = traverse.Scope(spark.createDataFrame([(s, ids[p]) for s, p in scopes], "scope_id string, file_id long"))
    seeds = spark.createDataFrame([("wide", "write"), ("narrow", "write")], "seed_id string, name string")
    found = {(r.seed_id, r.name) for r in traverse.callers_of(graph, seeds, 3, within=within).collect()}
    assert found == {("wide", "save"), ("wide", "handle"), ("narrow", "save")}
    seeds = spark.createDataFrame([("wide", "handle"), ("narrow", "handle"), ("narrow", "save")], "seed_id string, name string")
    leaves = {(r.seed_id, r.name, r.file) for r in traverse.callees_of(graph, seeds, within=within).collect()}
    assert leaves == {("wide", "save", "app/core.py"), ("narrow", "write", "app/disk.py")}
    only = traverse.Scope(spark.createDataFrame([("narrow", ids["app/core.py"])], "scope_id string, file_id long"))
    leaf = traverse.callees_of(graph, seeds.filter("name = 'save'"), within=only).collect()
    assert [(r.name, r.file, r.resolved) for r in leaf] == [("write", None, False)]


def test_failures_are_ranked_in_their_own_files(code, spark):
    rows = failures(
        spark, ("trace", "stack-trace", '  File "app/disk.py", line 2, in write\n', None, None), ("file", "file", None, "app/core.py", None),
        ("symbol", "symbol", None, None, "handle"),
    )
    out, scopes = code.rca(rows, top_n=20).collect(), code.resolve_scope(rows).collect()
    files = {}
    for r in scopes:
        files.setdefault(r.failure_id, set()).add(r.path)
    for r in out:
        assert r.file is None or r.file in files[r.failure_id]
    names = {i: {r.name for r in out if r.failure_id == i} for i in files}
    assert "outside" not in names["trace"] or "lib/other.py" in files["trace"]
    assert "app/twin.py" in files["file"] and "lonely" in names["file"]  # it changed together with the seed
    assert {"handle", "save"} <= names["symbol"]


def test_notes(code, spark):
    rows = failures(
        spark, ("gone", "file", None, "app/no.py", None), ("lost", "stack-trace", "no frames here", None, None), ("who", "symbol", None, None, "nobody"),
        ("file", "file", None, "app/core.py", None), ("bare", "failing-test", None, "app/bare.py", None), ("good", "file", None, "app/disk.py", None),
    )
    notes = {r.failure_id: r.notes for r in code.rca_notes(rows).collect()}
    assert notes["gone"][0] == "no such file: app/no.py" and notes["lost"][0] == "the trace names no file of the repository"
    assert notes["who"][0] == "nothing defines the symbol nobody"
    assert all(len(notes[i]) == 2 for i in ("gone", "lost", "who"))
    assert notes["file"] == ["files that changed together with the seeds: 1"] and notes["good"] == []
    assert notes["bare"] == ["no symbol in scope can be the anchor"]
    cut = code.resolve_scope(rows.filter("failure_id = 'file'"), max_files=2, rejected=True).collect()
    assert [r.limit for r in sorted(cut, key=lambda r: r.scope_rank)] == [None, None, "files"]
