"""Extraction, resolution on real snippets, storage, upkeep."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tracegraph import CodeGraph
from tracegraph.api import FAILURE_SCHEMA
from tracegraph.sources import extraction, files, store
from tracegraph.sources.python_source import python_facts
from tracegraph.sources.typescript_source import typescript_facts
from tracegraph.functions.runtime_names import runtime_names
from tracegraph.operators import scope
from tracegraph.operators.graph import Graph
from tracegraph.streaming.changes import GraphUpkeep, burst_files, burst_stream, change_events, follow

SOURCES = {
    "web/a.ts": 'export function foo(x: number): number {\n  return x;\n}\nexport class Greeter {\n  greet() { return "hi"; }\n}\n',
    "web/b.ts": 'import { foo, Greeter } from "./a.js";\nexport function bar() {\n  const g = make();\n  foo(1);\n  g.greet();\n}\n',
    "web/flow.ts": (
        "export function save(user) { return user; }\n"
        "export function handleRequest(req) {\n  const user = parseRequest(req);\n  save(user);\n}\n"
        "export function parseRequest(req) { return handleRequest(req); }\n"
    ),
    "pkg/__init__.py": "",
    "pkg/transform.py": "class Transformer:\n    def apply(self, key):\n        return normalize_key(key)\n\ndef normalize_key(key):\n    return key.lower()\n",
    "pkg/ingest.py": (
        "from .transform import normalize_key, Transformer\nfrom pkg.db import Conn\n\ndef ingest(rows):\n    t = Transformer()\n    for r in rows:\n"
        "        t.apply(r)\n        validate(r)\n    return normalize_key(rows)\n\ndef validate(row):\n    len(row)\n    row.anything()\n    missing_fn(row)\n"
    ),
    "pkg/db.py": (
        "class Conn:\n    def execute(self, sql): return sql\n    def commit(self): return None\n\ndef outer(db: Conn):\n    db.execute('q')\n"
        "    local: Conn = make()\n    local.commit()\n"
    ),
    "pkg/tests/test_ingest.py": "from pkg.ingest import ingest\n\ndef test_it():\n    ingest([])\n",
    "notes.md": "# nothing\n",
}


@pytest.fixture(scope="module")
def code(spark):
    return CodeGraph.from_sources(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))


def names(df, column="name"):
    return sorted(r[column] for r in df.select(column).collect())


def test_definition_and_file_symbols(code):
    row = code.definition_of("foo").collect()
    assert len(row) == 1
    assert (row[0].kind, row[0].file, row[0].start_line, row[0].exported, row[0].language) == ("function", "web/a.ts", 1, True, "typescript")
    found = {r.name: r.kind for r in code.symbols_in_file("web/a.ts").collect()}
    assert found["Greeter"] == "class" and found["greet"] == "method"


def test_callees_and_callers(code):
    assert {"foo", "greet", "make"} <= set(names(code.callees_of("bar")))
    assert {"apply", "validate", "normalize_key", "Transformer"} <= set(names(code.callees_of("ingest")))
    assert {"apply", "ingest"} <= set(names(code.callers_of("normalize_key")))
    assert code.callers_of("no_such_name").count() == 0


def test_receiver_types_resolve_methods(code):
    edges = code.graph.edges.join(code.graph.symbols.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller")), "from_symbol_id")
    rows = {r.to_name: r for r in edges.filter("caller = 'outer'").collect()}
    assert rows["execute"].to_symbol_id is not None and rows["execute"].resolution_kind is None
    assert rows["commit"].to_symbol_id is not None


def test_open_calls_are_classified(code):
    rows = {r.to_name: r.resolution_kind for r in code.graph.edges.filter("to_symbol_id IS NULL AND kind = 'CALLS'").collect()}
    assert rows["len"] == "stdlib" and rows["anything"] == "instance_method" and rows["missing_fn"] == "unknown"


def test_path_follows_calls(code, spark):
    pairs = spark.createDataFrame([(1, "parseRequest", "save"), (2, "save", "nowhere"), (3, "save", "save")], "pair_id int, from_name string, to_name string")
    rows = code.path_between(pairs).orderBy("pair_id", "step").collect()
    assert [r.name for r in rows if r.pair_id == 1] == ["parseRequest", "handleRequest", "save"]
    assert [r.edge_kind for r in rows if r.pair_id == 1] == [None, "CALLS", "CALLS"]
    assert [r.name for r in rows if r.pair_id == 3] == ["save"]
    assert not [r for r in rows if r.pair_id == 2]


def test_impact_and_unknown_name(code):
    rows = {r.name: r for r in code.impact("normalize_key").collect()}
    assert rows["normalize_key"].distance == 0 and rows["ingest"].distance == 1
    assert rows["ingest"].has_test
    with pytest.raises(ValueError):
        code.impact("no_such_name")


def test_unparsed_file_keeps_a_row(code):
    row = code.graph.files.filter("path = 'notes.md'").first()
    assert row.language == "unparsed" and row.loc == 2


def test_rca_by_kind(code, spark):
    rows = [
        ("sym", "symbol", None, None, None, "normalize_key", None),
        ("trace", "stack-trace", '  File "pkg/ingest.py", line 5, in ingest\n', None, None, None, None),
        ("file", "file", None, "pkg/transform.py", None, None, None),
        ("prose", "free-text", "normalize_key breaks while ingest runs", None, None, None, None),
        ("none", "symbol", None, None, None, "no_such_name", None),
    ]
    out = code.rca(spark.createDataFrame(rows, FAILURE_SCHEMA)).collect()
    by = {}
    for r in out:
        by.setdefault(r.failure_id, []).append(r)
    assert {"sym", "trace", "file", "prose"} == set(by)
    assert any(r.name == "normalize_key" for r in by["sym"]) and any(r.name == "ingest" for r in by["trace"])
    assert sorted(r.rank for r in by["sym"]) == list(range(1, len(by["sym"]) + 1))


def test_typescript_locals_and_arguments():
    f = typescript_facts(
        "function foo(items) {\n  const { a, b: c, ...rest } = items;\n  for (const v of items) { go(v); }\n  for (let i = 0, j = 1; i < 3; i++) {}\n"
        '  target(user.id, "literal", computeX());\n  this.hidden();\n  new Thing();\n  items.each(() => { const inner = 1; });\n}\n'
    )
    assert sorted(s["name"] for s in f.symbols if s["kind"] == "local") == ["a", "c", "i", "j", "rest", "v"]
    args = next(e["args"] for e in f.edges if e["to_name"] == "target")
    assert [a["source_kind"] for a in args] == ["member", "literal", "call"]
    assert {"hidden", "Thing"}.isdisjoint(e["to_name"] for e in f.edges)


def test_python_locals_imports_and_broken_file():
    f = python_facts(
        "import os\nimport numpy as np\nfrom .m import x as y, z\nfrom q import *\ndef foo(a, *, k=1):\n    b, c = 1, 2\n    obj.attr = 3\n    try:\n        pass\n"
        "    except IOError as ioe:\n        pass\n    with open(a) as fh:\n        _ = fh\n    [n for n in a]\n"
    )
    kinds = {s["name"]: s["type_text"] for s in f.symbols if s["kind"] == "local"}
    assert kinds == {"b": None, "c": None, "ioe": "IOError", "fh": None}
    assert [(i["local_name"], i["kind"]) for i in f.imports] == [("np", "namespace"), ("y", "from"), ("z", "from")]
    assert [(p["name"], p["has_default"]) for p in f.params] == [("a", False), ("k", True)]
    assert python_facts("def broken(:\n").symbols == []


def test_tree_scan_honours_ignore_rules(spark, tmp_path):
    for path, content in {**SOURCES, "node_modules/x.ts": "function no() {}", "gen/out.ts": "function gen() {}"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    (tmp_path / ".gitignore").write_text("gen/\n# comment\n")
    found = names(files.read_tree(spark, str(tmp_path)), "path")
    assert "web/a.ts" in found and not [p for p in found if p.startswith(("node_modules", "gen"))]
    assert names(files.read_tree(spark, str(tmp_path), ["pkg"], 3), "path") == sorted(p for p in SOURCES if p.startswith("pkg/"))[:3]


def test_store_round_trip_version_and_isolation(code, spark, tmp_path):
    root = str(tmp_path / "store")
    code.save(root, "one")
    code.save(root, "two")
    code.save(root, "one")
    assert sorted(r.repo_id for r in store.repositories(spark, root).collect()) == ["one", "two"]
    again = CodeGraph.from_store(spark, root, "one")
    assert again.graph.symbols.count() == code.graph.symbols.count()
    assert names(again.callees_of("bar")) == names(code.callees_of("bar"))
    spark.range(1).select(F.lit(3).alias("schema_version"), F.lit("one").alias("repo_id")).write.parquet(str(tmp_path / "old/files"))
    with pytest.raises(ValueError):
        store.load_table(spark, str(tmp_path / "old"), "files", "one")


def test_cache_reads_only_changed_files(spark):
    src = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    before = extraction.graph_tables(src)
    changed = src.filter("path = 'web/b.ts'")
    after = extraction.graph_tables(changed, cached=before["facts"].join(changed, "path", "left_anti"))
    key = lambda t: sorted(map(str, t.collect()))
    for name in extraction.STORED:
        assert key(before[name]) == key(after[name])


def test_upkeep_stream_equals_full_index(spark, tmp_path):
    root, events, ckpt = str(tmp_path / "store"), tmp_path / "events", str(tmp_path / "ckpt")
    events.mkdir()
    start = CodeGraph.from_sources(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))
    start.save(root, "r")
    now = dict(SOURCES)
    now["web/b.ts"] = 'import { foo } from "./a.js";\nexport function renamed() {\n  foo(2);\n}\n'
    del now["pkg/db.py"]
    current = spark.createDataFrame(list(now.items()), "path string, content string")
    spark.createDataFrame([("web/b.ts",), ("pkg/db.py",)], "path string").coalesce(1).write.json(str(events / "b1"))
    stream = spark.readStream.schema("path string").json(str(events / "b1"))
    sink = GraphUpkeep(root, "r", lambda paths: current.join(paths, "path"))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = CodeGraph.from_store(spark, root, "r"), CodeGraph.from_sources(current)
    for table in ("files", "symbols", "edges", "imports"):
        rows = lambda g: sorted(map(str, getattr(g.graph, table).select(*getattr(want.graph, table).columns).collect()))
        assert rows(got) == rows(want), table
    assert names(got.definition_of("renamed")) == ["renamed"]


def test_debounced_stream_groups_bursts(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    ms = lambda n: t0 + datetime.timedelta(milliseconds=n)
    rows = [("r", "a", "modify", ms(0)), ("r", "b", "modify", ms(100)), ("r", "c", "modify", ms(1000)), ("r", "z", "modify", ms(600000))]
    spark.createDataFrame(rows, "repo string, path string, action string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    got = set()

    def sink(closed, epoch):
        got.update((r.session_start, r.path) for r in burst_files(closed, stored).collect())

    q = burst_stream(stream).writeStream.foreachBatch(sink).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == {(ms(0), "a"), (ms(0), "b"), (ms(1000), "c")}


def test_deep_trees_and_links_back(spark, tmp_path):
    deep = tmp_path
    for k in range(70):
        deep = deep / f"d{k}"
    deep.mkdir(parents=True)
    (deep / "last.py").write_text("x = 1\n")
    (tmp_path / "d0" / "up").symlink_to(tmp_path)
    found = [r.path for r in files.list_tree(spark, str(tmp_path)).collect()]
    assert found == ["/".join(f"d{k}" for k in range(70)) + "/last.py"]


def test_unreadable_files_keep_a_row(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"def f():\n    return '\xff'\n")
    (tmp_path / "b.py").write_text("def g():\n    return 1\n")
    rows = {r.path: r for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert rows["a.py"].content is None and rows["b.py"].content
    tables = extraction.graph_tables(files.read_tree(spark, str(tmp_path)).select("path", "content"))
    assert {r.path: r.language for r in tables["files"].collect()} == {"a.py": "unparsed", "b.py": "python"}


def test_a_bad_statement_costs_only_itself():
    facts = python_facts("import os\n\ndef one():\n    helper()\n\nprint 1\n\n@wrap\ndef two(a):\n    return one()\n")
    assert [(s["name"], s["start_line"]) for s in facts.symbols if s["kind"] == "function"] == [("one", 3), ("two", 9)]
    assert {"helper", "one"} <= {e["to_name"] for e in facts.edges}


def test_broken_snippets_do_not_end_the_job(spark):
    broken = {"a.ts": "const f = function(a", "b.ts": "const f = function", "c.ts": "class A { x(", "d.ts": "function ok() { go(); }"}
    rows = extraction.facts(spark.createDataFrame(list(broken.items()), "path string, content string")).collect()
    assert {r.path for r in rows} == set(broken) and [s.name for r in rows if r.path == "d.ts" for s in r.symbols] == ["ok"]

    def fails(source):
        raise KeyError(source)

    extraction.register("rust", fails)
    try:
        row = extraction.facts(spark.createDataFrame([("a.rs", "fn")], "path string, content string")).first()
        assert row.language != "rust" or "KeyError" in row.error
    finally:
        del extraction.EXTRACTORS["rust"]


def test_a_large_file_takes_linear_time():
    text = "export function foo(a, b) {\n  const x = bar(a);\n  for (const v of b) { go(v.y); }\n  return x;\n}\n" * 21000
    start = time.time()
    facts = typescript_facts(text)
    assert len(facts.edges) == 42000 and facts.edges[-1]["call_line"] == 5 * 20999 + 3
    assert time.time() - start < 30


def test_an_emptied_table_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", "m", "a", "named")], "id long, file_id long, local_name string, source_module string, source_name string, kind string")
    for repo in ("r/1", "r2"):
        store.save_graph({"imports": rows}, str(tmp_path), repo)
    store.save_graph({"imports": rows.limit(0)}, str(tmp_path), "r/1")
    assert store.load_table(spark, str(tmp_path), "imports", "r/1").count() == 0
    assert store.load_table(spark, str(tmp_path), "imports", "r2").count() == 1


def test_seeds_stay_beyond_the_budget(spark):
    paths_ = [(k, f"f{k}.py", 10) for k in range(6)]
    graph = Graph(files=spark.createDataFrame(paths_, "id long, path string, loc int"))
    seeds = spark.createDataFrame([("x", k, k + 1) for k in range(4)], "failure_id string, file_id long, seed_ord long")
    imports = spark.createDataFrame([(0, 4, 0), (1, 5, 0)], "from_file long, to_file long, spec_pos int")
    out = {r.file_id for r in scope.resolve_scope(graph, seeds, imports, max_files=2).collect()}
    assert out == {0, 1, 2, 3}
    assert {r.file_id for r in scope.resolve_scope(graph, seeds, imports, max_files=5).collect()} == {0, 1, 2, 3, 4}


def test_late_events_reach_the_upkeep(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name, when in (("1.json", "2024-01-02T00:00:00Z"), ("2.json", "2023-01-01T00:00:00Z")):
        (tmp_path / "in" / name).write_text(f'{{"repo": "r", "path": "{name}.py", "action": "change", "ts": "{when}", "event_id": 1}}\n')
        query = follow(change_events(spark, str(tmp_path / "in")), lambda batch, epoch: seen.extend(r.path for r in batch.collect()), str(tmp_path / "state"), once=True)
        query.awaitTermination(120)
    assert seen == ["1.json.py", "2.json.py"]


def test_runtime_names():
    known = set(runtime_names())
    assert {"query", "first", "merge", "findOne", "aggregate", "prepare", "spawn", "createReadStream", "unlinkSync", "len", "useState", "HTTPException"} <= known
    assert not {"normalize_key", "handleRequest", "ingest", "computeTotals", "UserService", "fetchUser", "processOrder"} & known
    assert len(known) > 800
