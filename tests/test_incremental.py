"""Resolution after changes against a full run, and versions that switch together."""

import random

import pytest
from pyspark.sql import functions as F

from tracegraph.api import CodeGraph
from tracegraph.sources.snapshots import Conflict, SnapshotStore
from tracegraph.streaming.changes import IncrementalUpkeep

NAMES = ["save", "load", "run", "Store", "Cache", "merge"]


def module(rng, language, stems):
    """A small file with imports, a class, functions and calls."""
    a, b, c, d = rng.sample(NAMES, 4)
    other = rng.choice(stems)
    if language == "py":
        where = rng.choice([f".{other}", f"pkg.{other}", f"lib.{other}"])
        return f"""from {where} import {a}\n\nclass {c}:\n    def {b}(self, x):\n        return self.{d}(x)\n\n    def {d}(self, y):\n        return {a}(y)\n
def use_{b}(store: {c}):\n    value = store.{b}(1)\n    {a}(value)\n    return use_{d}(value)\n"""
    where = rng.choice([f"./{other}.js", f"./{other}", "tools"])
    return f"""import {{ {a} }} from "{where}";\nexport class {c} {{\n  {b}(x: number) {{ return this.{d}(x); }}\n  {d}(y: number) {{ return {a}(y); }}\n}}\n
export function use_{b}(s: {c}) {{\n  const v = s.{b}(2);\n  {a}(v);\n  return v;\n}}\n"""


def edits(rng, now):
    """A burst of edits on (path, content); returns the paths it touches."""
    stems, touched = ["one", "two", "three", "four"], set()
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["edit", "edit", "add", "delete", "body"])
        if kind == "delete" and len(now) > 3:
            path = rng.choice(sorted(now))
            del now[path]
        elif kind == "body" and any(p.endswith(".py") for p in now):
            path = rng.choice(sorted(p for p in now if p.endswith(".py")))
            now[path] = now[path] + "\n# a remark\n"
        else:
            folder, language = rng.choice([("pkg", "py"), ("lib", "py"), ("web", "ts")])
            path = f"{folder}/{rng.choice(stems)}.{language}"
            now[path] = module(rng, language, stems)
        touched.add(path)
    return touched


def rows_of(graph, table, drop=()):
    df = getattr(graph, table)
    columns = sorted(c for c in df.columns if c not in ("line_text", *drop))
    return sorted(map(str, df.select(*columns).collect()))


def test_random_edits_equal_a_full_run(spark, tmp_path):
    rng = random.Random(11)
    now = {"pkg/__init__.py": "", "web/a.ts": module(rng, "ts", ["one"])}
    for path in ("pkg/one.py", "pkg/two.py", "lib/one.py", "web/one.ts"):
        now[path] = module(rng, path[-2:], ["one", "two"])
    frame = lambda: spark.createDataFrame(list(now.items()), "path string, content string")
    snapshots = SnapshotStore(spark, str(tmp_path / "versions"), buckets=8)
    CodeGraph.from_sources(frame()).save_snapshot(snapshots)
    for step in range(3):
        touched = edits(rng, now)
        if step == 1:
            now["lib/__init__.py"] = ""
            touched.add("lib/__init__.py")
        if step == 2:
            now["web/package.json"] = '{"name": "tools"}'
            now["web/index.ts"] = module(rng, "ts", ["one"])
            touched |= {"web/package.json", "web/index.ts"}
        upkeep = IncrementalUpkeep(snapshots, lambda paths: frame().join(paths, "path"))
        upkeep(spark.createDataFrame([(p,) for p in touched], "path string"), step)
        got, want = CodeGraph.from_snapshot(snapshots).graph, CodeGraph.from_sources(frame()).graph
        for table in ("files", "symbols", "edges", "arg_bindings", "imports", "params", "raw_edges"):
            drop = ("subsystem",) if table == "files" else ()
            assert rows_of(got, table, drop) == rows_of(want, table, drop), (step, table, touched)
    assert snapshots.manifest()["batch"] == 2
    before = snapshots.versions()
    upkeep(spark.createDataFrame([("pkg/one.py",)], "path string"), 2)
    assert snapshots.versions() == before


def test_a_change_without_effect_elsewhere_writes_its_own_buckets_only(spark, tmp_path):
    now = {f"pkg/m{i}.py": f"def f{i}(x):\n    return g{i}(x)\n" for i in range(40)}
    now["pkg/m0.py"] = "from .m1 import f1\n\ndef f0(x):\n    return f1(x)\n"
    snapshots = SnapshotStore(spark, str(tmp_path / "versions"), buckets=64)
    CodeGraph.from_sources(spark.createDataFrame(list(now.items()), "path string, content string")).save_snapshot(snapshots)
    first = snapshots.manifest()

    def burst(path, content, epoch):
        now[path] = content
        upkeep = IncrementalUpkeep(snapshots, lambda paths: spark.createDataFrame(list(now.items()), "path string, content string").join(paths, "path"))
        upkeep(spark.createDataFrame([(path,)], "path string"), epoch)
        last, older = snapshots.manifest(), snapshots.manifest(snapshots.versions()[-2])
        return {t: {b for b in {*last["tables"][t], *older["tables"][t]} if last["tables"][t].get(b) != older["tables"][t].get(b)} for t in last["tables"]}

    slot = {r.path: str(r.b) for r in snapshots.load("files").select("path", F.pmod("file_id", F.lit(64)).alias("b")).collect()}
    assert burst("pkg/m7.py", "def f7(x):\n    return h7(x)\n", 0)["edges"] <= {slot["pkg/m7.py"]}
    changed = burst("pkg/m1.py", "def before():\n    pass\n\ndef f1(x):\n    return 1\n", 1)
    assert changed["edges"] == {slot["pkg/m1.py"], slot["pkg/m0.py"]} or changed["edges"] == {slot["pkg/m0.py"]}
    assert all(b <= {slot["pkg/m0.py"], slot["pkg/m1.py"]} for b in changed.values())
    assert snapshots.load("edges", first).count() == 40  # an old version stays as it was
    graph = CodeGraph.from_snapshot(snapshots)
    assert [r.name for r in graph.callers_of("f1").collect()] == ["f0"]


def test_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "v"), buckets=4)
    assert store.versions() == [] and store.manifest()["version"] == 0
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "file_id long, value string")
    none = rows(1).limit(0)
    assert store.replace({"a": rows(1, 2, 3), "b": none}) == 1
    pinned = store.manifest()
    gone = spark.createDataFrame([(2,)], "file_id long")
    assert store.update(pinned, {"a": (gone, rows(9)), "b": (gone, rows(2))}) == 2
    values = lambda t, m=None: sorted(r.file_id for r in store.load(t, m).collect())
    assert values("a") == [1, 3, 9] and values("b") == [2]
    assert values("a", pinned) == [1, 2, 3] and values("b", pinned) == []
    with pytest.raises(Conflict):  # a second writer that began at the same version
        store.update(pinned, {"a": (gone, none)})
    assert values("a") == [1, 3, 9]

    class Dies(SnapshotStore):
        def _publish(self, manifest, base):
            raise RuntimeError("gone between tables and version")

    with pytest.raises(RuntimeError):
        Dies(spark, store.root, 4).update(store.manifest(), {"a": (gone, rows(7))})
    assert store.versions() == [1, 2] and values("a") == [1, 3, 9]
    assert store.vacuum(keep=1) >= 2
    assert store.versions() == [2] and values("a") == [1, 3, 9] and values("b") == [2]
    assert store.update(store.manifest(), {"a": (spark.createDataFrame([(1,), (3,), (9,)], "file_id long"), none)}) == 3
    assert values("a") == []
