"""Shards, conversation repair and the Merkle manifest against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import conversations, decontaminate, langid, lines, merkle, shards, simhash
from tracegraph.llm.queries import GROWN, QUERIES, SHARDS
from tracegraph.llm.ranks import ranked
from tracegraph.llm.tables import table

DIRECTORY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_part` string, `a.b` int, shard int, `_draws` int, key string"
ODD = [
    (i, t, "en", s, n, "x", 1, 7, 0, "k")
    for i, t, s, n in [
        (1, None, None, None), (2, "", "s", 0), (None, "No Id", "s", 5), (3, "Same ROW", "", 3), (3, "Same ROW", "", 3), (3, "Same ROW", "", 3),
        (4, "Été 中文 \U0001f600", "é", 1), (5, "x" * 200_000, "z", 1), (6, "tail", "z", -7),
    ]
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# numbers inside groups


def test_ranked_splits_one_key_of_equal_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id") % 7).otherwise(7).cast("string").alias("g"), (F.col("id") % 2).alias("v"))
    got = ranked(df.repartition(5), "g", ["v"], "n").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.g].append((r.n, r.v))
    for rows in by.values():
        assert [n for n, _ in sorted(rows)] == list(range(len(rows)))
        assert [v for _, v in sorted(rows)] == sorted(v for _, v in rows)


# shards


def brute_shard(doc_id, tree):
    def draw(leaf):
        u = int(hashlib.md5(f"{'-' if doc_id is None else doc_id}:{leaf.shard}".encode()).hexdigest()[: shards.DIGITS], 16)
        return -math.log((u + 0.5) / 16**shards.DIGITS) / leaf.weight

    nodes = [x for x in tree if x.weight > 0]
    for level in ("region", "rack", "shard"):
        best = collections.defaultdict(lambda: math.inf)
        for x in nodes:
            best[getattr(x, level)] = min(best[getattr(x, level)], draw(x))
        chosen = min(best, key=best.get)
        nodes = [x for x in nodes if getattr(x, level) == chosen]
    return nodes[0].shard


def test_shard_rows(spark, odd, empty):
    tree = shards.layout(SHARDS)
    for df in (odd, table(spark, DIRECTORY, "documents")):
        rows = collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        got = shards.shard_rows(df, tree, [*tree, GROWN]).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
            {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): n for (i, t), n in rows.items()}
        )
        by = collections.defaultdict(list)
        for r in got:
            assert r.shard == brute_shard(r.doc_id, tree) and r.grown_shard == brute_shard(r.doc_id, [*tree, GROWN])
            assert r.grown_shard in (r.shard, SHARDS) and r.law == "key"
            by[r.shard].append(r.slot)
        assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert shards.shard_rows(empty, tree, tree).count() == 0


def test_changed_weights_move_rows_of_their_subtree_only(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    base = shards.layout(12, racks=2, per_rack=3)

    def placed(tree):
        return {r.k: r.at for r in shards.place(ids, F.col("k"), tree, "at").collect()}

    before = placed(base)
    sizes = collections.Counter(before.values())
    assert all(abs(n - 20_000 / 12) < 5 * math.sqrt(20_000 / 12) for n in sizes.values())
    heavy = placed([shards.Leaf(x.region, x.rack, x.shard, 3.0 if x.rack == 1 else 1.0) for x in base])
    moved = {k for k in before if before[k] != heavy[k]}
    assert moved and all(heavy[k] in (3, 4, 5) and before[k] not in (3, 4, 5) for k in moved)
    drained = placed([shards.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 7 else 1.0) for x in base])
    assert {k for k in before if before[k] != drained[k]} == {k for k in before if before[k] == 7}
    weights = collections.Counter(heavy.values())
    assert abs(sum(weights[s] for s in (3, 4, 5)) / 20_000 - 0.5) < 0.02


def test_bad_trees(spark):
    with pytest.raises(ValueError):
        shards.place(spark.range(1), F.lit("x"), [shards.Leaf(0, 0, 0, 0.0)], "at")
    with pytest.raises(ValueError):
        shards.place(spark.range(1), F.lit("x"), [shards.Leaf(0, 0, 0), shards.Leaf(0, 1, 0)], "at")


# Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings(levels, at, fan):
    out = []
    for level in levels[:-1]:
        start = at // fan * fan
        out.append((level[start:at], level[at + 1 : start + fan]))
        at //= fan
    return out


def brute_manifest(rows, tamper, fan=16):
    groups = collections.defaultdict(list)
    for r in rows:
        leaf = digest("".join(field(v) for v in r))
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = brute_tree([g[2] for g in groups[s]], fan)
    top = brute_tree([trees[s][-1][0] for s in order], fan)
    out = []
    for n, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(groups[s]):
            path = siblings(trees[s], at, fan) + siblings(top, n, fan)
            cur = digest("".join(field(v) for v in tamper(r)))
            for left, right in path:
                cur = digest("".join([*left, cur, *right]))
            proof = digest("".join("".join(a + b) for a, b in path))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out, key=str)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tampered(r):
    return (*r[:4], lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


def manifest_rows(df, fan):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(df, F.when(drawn, low).otherwise(F.col("text")), fan_out=fan)
    proof = F.sha2(merkle.proof_text(F.col("path")), 256)
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("fan", [16, 3])
def test_manifest(spark, odd, fan):
    for df in (odd, table(spark, DIRECTORY, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))):
        rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
        assert manifest_rows(df, fan) == brute_manifest(rows, tampered, fan)


def test_manifest_of_little(spark, empty, odd):
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(odd.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].path == [] and one[0].leaf == one[0].subroot == one[0].root and one[0].verified
    same = merkle.manifest(odd.filter("doc_id = 3"), fan_out=2).collect()
    assert len(same) == 3 and all(r.verified for r in same)


def test_some_requests_only(spark):
    leaves = spark.createDataFrame([("a", i, digest(str(i)), 100) for i in range(100)], "key string, rank long, digest string, n long")
    levels, tops = merkle.build(leaves, 3)
    asked = leaves.filter("rank IN (0, 41, 99)").select("key", "rank", F.col("digest").alias("request"))
    got = merkle.descend(levels, tops.withColumn("path", F.array().cast(merkle.PATH)), asked, 3)
    folded = got.select("rank", "top", merkle.fold(F.col("request"), F.col("path")).alias("root")).collect()
    assert sorted(r["rank"] for r in folded) == [0, 41, 99] and all(r.root == r.top for r in folded)


# conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def least(rows, faults):
    """Cheapest cost and least audit by a table from the end, with the repaired lines."""
    end = {0: (0, ""), 3: (0, "")}
    table_ = [None] * (len(rows) + 1)

    def insert(cells):
        for _ in range(2):
            for s in range(4):
                to = (2, 2, 3, 2)[s]
                if to in cells:
                    cost, audit = cells[to]
                    cells[s] = min(cells.get(s, (math.inf, "")), (cost + 3, "I" + audit))
        return cells

    table_[-1] = insert(dict(end))
    for i in range(len(rows) - 1, -1, -1):
        cells, after = {}, table_[i + 1]
        for s in range(4):
            options = [(4, "D", s)]
            extra = 3 if faults[i] == "truncated" else 0
            if faults[i] not in ("blank", "duplicate"):
                initial = rows[i][2][:1]
                if initial == "s" and s == 0:
                    options.append((extra, "K", 1))
                if initial == "u" and s != 2:
                    options.append((extra, "K", 2))
                if initial == "a" and s == 2:
                    options.append((extra, "K", 3))
                options.append((3 + extra, "R", (2, 2, 3, 2)[s]))
            found = [(c + after[t][0], letter + after[t][1]) for c, letter, t in options if t in after]
            if found:
                cells[s] = min(found)
        table_[i] = insert(cells)
    cost, audit = table_[0][0]
    lines, state, i = [], 0, 0
    for letter in audit:
        if letter in "IR":
            state = (2, 2, 3, 2)[state]
            role = "user" if state == 2 else "assistant"
            lines.append(f"{role}:{rows[i][3] if letter == 'R' else ''}")
        elif letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[rows[i][2][0]]
            lines.append(f"{rows[i][2]}:{rows[i][3]}")
        i += letter != "I"
    return cost, audit, digest("\n".join(lines))


def brute_repair(rows):
    kept = collections.defaultdict(list)
    for r in rows:
        kept[r[0]]
    for r in brute_damage(rows):
        kept[r[0]].append(r)
    out = []
    for conv, group in kept.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], digest(r[3])))
        seen, faults = set(), []
        for r in group:
            solid = r[3].rstrip(conversations.SPACE)
            fault = "blank" if not solid else "duplicate" if (r[2], r[3]) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((r[2], r[3]))
            faults.append(fault)
        turns = {r[1] for r in group if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *least(group, faults)))
    return sorted(out, key=str)


CONVERSATION = "conv_id long, turn long, role string, text string, `same` int, `a.b` string, part int, conv string"


def random_rows(seed, conversations_, longest):
    rng, out = random.Random(seed), []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "Ursel"])
            text = rng.choice(["Yes.", "No", "", " \n", None, "Why?", "Fine. ", f"Text {turn}!", f"Text {turn}"])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn * 3]), role, text, 1, "x", 2, "y"))
    return out


@pytest.mark.parametrize("block, fan_out", [(1024, 1024), (3, 2), (1, 3)])
def test_repair_report(spark, block, fan_out):
    rows = random_rows(block, 60, 12) + random_rows(7, 2, 150)
    df = spark.createDataFrame(rows, CONVERSATION).repartition(4)
    got = sorted(map(tuple, conversations.repair_report(df, block, fan_out).collect()), key=str)
    assert got == brute_repair([r[:4] for r in rows])


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, DIRECTORY, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, DIRECTORY)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)


def test_repair_of_repeated_rows_and_of_nothing(spark):
    rows = [(5, 0, "user", "Hi.", 1, "x", 2, "y")] * 700 + [(5, 1, "assistant", "z" * 100_000, 1, "x", 2, "y")]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(4)
    got = sorted(map(tuple, conversations.repair_report(df, 16, 4).collect()), key=str)
    assert got == brute_repair([r[:4] for r in rows])
    assert conversations.repair_report(df.limit(0)).count() == 0


def test_repaired_rows_have_legal_roles(spark):
    rows = random_rows(3, 40, 9)
    source = spark.createDataFrame(rows, CONVERSATION).select("conv_id", "turn", "role", "text")
    ordered, edits, _ = conversations.plan_repairs(conversations.damage(source))
    by = collections.defaultdict(dict)
    for r in conversations.repaired_rows(ordered, edits).collect():
        by[r.conv][r.place] = r.role[0]
    for places in by.values():
        roles = "".join(places[i] for i in range(len(places)))
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_paths_rank_nodes_by_their_least_audit():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 16, n) for n in (1, 5, 40)]
    found = conversations.Paths(blocks, np.repeat(conversations.ENDING[None], 3, axis=0), np.array([True, True, True]))
    for block, (places, letters, _) in zip(blocks, found.walk(np.zeros(3, dtype=int))):
        names = {0: "sound", 1: "truncated", 2: "blank", 3: "duplicate"}
        rows = [(0, i, "suat"[k % 4], "x") for i, k in enumerate(block)]
        assert "".join(conversations.LETTERS[x] for x in letters) == least(rows, [names[k // 4] for k in block])[1]
        assert places == sorted(places)


# names of extra columns


def test_extra_columns_may_have_any_name(spark):
    names = ["_gone", "_id", "_stays", "_clean", "_kept", "_GONE_", "_kept_", "a.b"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names)
    texts = ["The first text of all of these, about one thing.", "The first text of all of these, about one thing.", "Another one\nof two lines", None]
    docs = spark.createDataFrame([(i, t, "en", *range(len(names))) for i, t in enumerate(texts)], schema)
    items = spark.createDataFrame([(1, "Another one of two lines")], "item_id long, text string")
    stages = {
        "near": simhash.drop_near_duplicates(docs), "copies": lines.drop_near_copies(docs), "lines": lines.drop_similar_lines(docs),
        "language": langid.drop_unidentified(docs), "benchmark": decontaminate.drop_contaminated(docs, items),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(list(r)[3:] == list(range(len(names))) for r in rows), name
    assert {r.doc_id for r in stages["near"].collect()} == {0, 2, 3} == {r.doc_id for r in stages["copies"].collect()}
