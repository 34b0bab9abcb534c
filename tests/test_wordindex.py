"""The word index against plain `in`, also after parts were replaced and when read back."""

import random

from tracegraph.operators.wordindex import WordIndex

PIECES = ["save", "saver", "re_save", "x1", "a", "é", "数据", " ", " ", ".", "->", "\n", "__", "(", "Save", "1", "foo bar", "$"]
NEEDLES = ["save", "a", "x1", "e s", "->", ".", "数", "é", "re_save", "save(", "(save", "foo bar", "bar", "_", "missing", "", " ", "1 a", "\n", "r.x", None]


def text_of(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))


def rows_with(spark, rows):
    return spark.createDataFrame(rows, "id long, part long, text string")


def expected(rows):
    return sorted({(i, n) for i, _, t in rows if t is not None for n in NEEDLES if n and n in t})


def found(spark, index):
    needles = spark.createDataFrame([(n,) for n in NEEDLES + ["save"]], "n string")
    return sorted((r.id, r.n) for r in index.containing(needles, "n", "id").collect())


def test_index_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 7, text_of(rng)) for i in range(80)] + [(100, 1, None), (101, 2, ""), (102, None, "save a"), (103, 3, "save " * 5000)]
    index = WordIndex.build(rows_with(spark, rows), "id", "text", part="part")
    assert found(spark, index) == expected(rows)
    index.save(str(tmp_path / "index"))
    stored = WordIndex.load(spark, str(tmp_path / "index"))
    assert found(spark, stored) == expected(rows)
    fresh = [(1, 1, "foo bar saver"), (300, 1, "数据 x1"), (301, 9, "->")]
    changed = [r for r in rows if r[1] not in (1, 2, 9)] + fresh
    parts = spark.createDataFrame([(1,), (2,), (9,)], "part long")
    after = stored.replace(parts, WordIndex.build(rows_with(spark, fresh), "id", "text", part="part"))
    assert found(spark, after) == expected(changed)


def test_empty_tables(spark):
    empty = WordIndex.build(rows_with(spark, []), "id", "text")
    assert found(spark, empty) == []
    none = spark.createDataFrame([], "n string")
    assert WordIndex.build(rows_with(spark, [(1, None, "save")]), "id", "text").containing(none, "n").count() == 0
