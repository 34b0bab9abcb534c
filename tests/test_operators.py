"""Operators against brute force and against known scores."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracegraph.config import ScoringConfig, Weights, load_config, merge
from tracegraph.functions import parsing, paths, signals
from tracegraph.functions import text as tx
from tracegraph.operators import causal, evaluate, shared
from tracegraph.operators.graph import Graph
from tracegraph.streaming.changes import debounce

AS_OF = datetime.datetime(2024, 6, 1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    needles = sorted({word(rng.randint(1, 12)) for _ in range(60)})
    hay = [(i, word(rng.randint(0, 60))) for i in range(40)]
    got = shared.substring_join(
        spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame(hay, "id int, t string"), "id", "t"
    )
    want = sorted((i, n) for (i, t), n in itertools.product(hay, needles) if n in t)
    assert sorted((r.id, r.n) for r in got.collect()) == want


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(2)
    span = lambda: (lambda a: (a, a + rng.randint(0, 150)))(rng.randint(1, 300))
    left = [(i, rng.randint(0, 2), *span()) for i in range(60)]
    right = [(i, rng.randint(0, 2), *span()) for i in range(60)]
    a = spark.createDataFrame(left, "l int, k int, ls int, le int")
    b = spark.createDataFrame(right, "r int, k int, rs int, re int")
    got = sorted((r.l, r.r) for r in shared.overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re")).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])


def test_salted_join_keeps_every_row(spark):
    many = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id")
    few = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = shared.salted_join(many, few, ["k"])
    assert shared.hot_keys(many, ["k"]).collect() == [(7,)]
    assert got.count() == 60000 and got.filter("v <> k * 2").count() == 0
    assert got.agg(F.count_distinct("id")).first()[0] == 60000


def test_debounce_equals_sequential_pass(spark):
    rng = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for repo in "ab":
        t = 0.0
        for i in range(200):
            t += rng.choice([1, 60, 700, 4000, 9000])
            rows.append((repo, t0 + datetime.timedelta(seconds=t), f"p{i % 5}"))
    want = {}
    for repo in "ab":
        start = last = None
        for _, ts, path in sorted(r for r in rows if r[0] == repo):
            if last is None or ts - last > datetime.timedelta(minutes=10):
                start = ts
            last = ts
            want[(repo, ts, path)] = start
    got = debounce(spark.createDataFrame(rows, "repo string, ts timestamp, path string"), "10 minutes").collect()
    assert {(r.repo, r.ts, r.path): r.session_start for r in got} == want


def scoring_graph(spark, caller_age=3):
    df = spark.createDataFrame
    symbols = [(1, 1, "A", "function", None, 1, 10), (2, 1, "B", "function", None, 20, 29), (3, 1, "C", "function", None, 40, 49)]
    edges = [("e1", 2, 1, "A", "CALLS"), ("e2", 2, None, "mystery_one", "CALLS"), ("e3", 2, None, "mystery_two", "CALLS"), ("e4", 2, None, "len", "CALLS")]
    return Graph(
        as_of=F.lit(AS_OF).cast("timestamp"),
        files=df([(1, "src/a.ts", "typescript", "core", 60)], "id long, path string, language string, subsystem string, loc int"),
        symbols=df(symbols, "id long, file_id long, name string, kind string, parent_id long, start_line int, end_line int").withColumns(
            {"signature": F.lit(""), "exported": F.lit(True), "type_text": F.lit(None).cast("string")}
        ),
        edges=df(edges, "id string, from_symbol_id long, to_symbol_id long, to_name string, kind string").withColumns(
            {"confidence": F.lit(1.0), "call_line": F.lit(1), "resolution_kind": F.lit(None).cast("string")}
        ),
        arg_bindings=df([], "edge_id string, position int, source_kind string, source_text string, source_symbol_id long"),
        commits=df(
            [(1, "abcdef1234", "dev", AS_OF - datetime.timedelta(days=caller_age), "change", False)],
            "commit_id long, sha string, author string, date timestamp, subject string, is_merge boolean",
        ),
        commit_lines=df([(1, 1, 22, 23)], "commit_id long, file_id long, start_line int, end_line int"),
    )


@pytest.mark.parametrize("legacy,low,high", [(False, 0.88, 1.0), (True, 5.5, 6.0)])
def test_known_scores(spark, legacy, low, high):
    g = scoring_graph(spark)
    seeds = spark.createDataFrame([("s", "A")], "seed_id string, name string")
    rows = {r.name: r for r in causal.causal_chain(g, seeds, legacy=legacy).collect()}
    assert low < rows["B"].score < high
    assert round(rows["B"].score, 3) == (5.851 if legacy else 0.947)
    assert rows["B"].n_unresolved == 2 and rows["B"].newest_days == 3
    assert rows["B"].rationale.startswith("Modified 3 days ago in commit abcdef1")
    assert "C" not in rows


def test_hypothesis_sentence(spark):
    ranked = spark.createDataFrame([("s", 1, "A", "x.ts", 3, "Because.")], "seed_id string, rank int, name string, file string, line int, rationale string")
    assert causal.first_hypothesis(ranked).first().hypothesis == "The root cause is most likely in A (x.ts:3) — Because."


def test_co_change_gate_and_weight(spark):
    cands = spark.createDataFrame([("s", "f", n, "anchor" if n == "A" else "caller") for n in "ABCD"], "seed_id string, file string, name string, role string")
    changes = spark.createDataFrame(
        [("s", "f", n, 1, 5) for n in "ABD"] + [("s", "f", n, 2, 5) for n in "BC"] + [("s", "f", n, 3, 100) for n in "AB"],
        "seed_id string, file string, name string, commit_id long, days_ago int",
    )
    got = {r.name: r.co_change_score for r in causal.co_change(cands, changes).collect()}
    assert got == {"A": 1.0, "B": 1.0, "D": 1.0}


def test_tokenizer(spark):
    r = one(spark, i=tx.identifier_tokens(F.lit("athlete silently gets the wrong plan when sport is cycling sport")),
            l=tx.literal_tokens(F.lit("""value "10k" and 'a' or 'it\\'s' "10k" """)), u=tx.identifier_tokens(F.lit('see "hidden words" shown')))
    assert r.i == ["athlete", "silently", "gets", "wrong", "plan", "sport", "cycling"]
    assert r.l == ["10k", "it\\'s"] and r.u == ["see", "shown"]


@pytest.mark.parametrize("token,want", [
    ("sendMessage", ["send", "message"]), ("send_message_safe", ["send", "message", "safe"]), ("ABCThing", ["abc", "thing"]), ("id", []),
    ("fetch_planned_events", ["fetch", "planned", "events"]), ("Login", ["login"]),
])
def test_split_compound(spark, token, want):
    assert one(spark, s=tx.split_compound(F.lit(token))).s == want


@pytest.mark.parametrize("line,name,want", [
    ("  self.do_thing()", "do_thing", "self"), ("self._db.commit()", "commit", None), ("users[0].rename(x)", "rename", None),
    ("make().execute(q)", "execute", None), ("db.execute (q)", "execute", "db"), ("x = 1", "execute", None),
])
def test_call_receiver(spark, line, name, want):
    row = spark.createDataFrame([(line, name)], "line string, name string").select(parsing.call_receiver("line", "name").alias("r")).first()
    assert row.r == want


@pytest.mark.parametrize("type_text,want", [
    ("Conn", "Conn"), ("Optional[Conn]", "Conn"), ("Conn | None", "Conn"), ('"Conn"', "Conn"), ("list[Conn]", None), ("A | B", None),
])
def test_bare_type(spark, type_text, want):
    assert one(spark, t=parsing.bare_type(F.lit(type_text))).t == want


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("../a", "../a"), ("a/b/../../c", "c"), ("a", "a"), ("a/../../b", "../b")])
def test_normalize(spark, path, want):
    assert one(spark, p=paths.normalize(F.lit(path))).p == want


def test_git_blob_id_of_known_content(spark):
    r = one(spark, e=parsing.git_blob_sha(F.lit("")), h=parsing.git_blob_sha(F.lit("hello\n")))
    assert (r.e, r.h) == ("e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a")


def test_days_round_half_up_and_bad_dates(spark):
    at = lambda h: F.lit(AS_OF - datetime.timedelta(hours=h)).cast("timestamp")
    r = one(spark, a=signals.days_between(F.lit(AS_OF).cast("timestamp"), at(12)), b=signals.days_between(F.lit(AS_OF).cast("timestamp"), at(-12)),
            c=signals.days_between(F.lit(AS_OF).cast("timestamp"), F.lit(None).cast("timestamp")))
    assert (r.a, r.b, r.c) == (1, 0, 0)


def test_fit_separates_and_paths_agree(spark):
    rng = random.Random(5)
    rows = [(f"e{i // 5}", i % 5 + 1, int(i % 5 == 2), float(3 * (i % 5 == 2)), rng.choice([0.5, 1.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "entry_id string, candidate_rank int, label int, a double, b double")
    w, bias, _ = evaluate.fit_weights(df, ["a", "b"])
    assert w[0] > 1.0 and evaluate.clip([-1.0, 2.0]) == [0.0, 2.0]
    ranks = evaluate.gold_ranks(df, evaluate.dot(["a", "b"], w, bias))
    assert {r["rank"] for r in ranks.collect()} == {1}


def test_keep_rule():
    before = {"text": 0.2, "trace": 0.5}
    assert evaluate.keep_or_discard(before, {"text": 0.22, "trace": 0.49})
    assert not evaluate.keep_or_discard(before, {"text": 0.22, "trace": 0.40})
    assert not evaluate.keep_or_discard(before, {"text": 0.205, "trace": 0.5})


def test_config_overlay_and_bad_file(tmp_path, capsys):
    cfg = merge({"matcher": {"name_match_weight": 9}, "scorer": {"calibrated_weights": {"recency": 1}}})
    assert cfg.matcher.name_match_weight == 9 and cfg.matcher.subname_match_weight == 1.0
    assert cfg.scorer.calibrated_weights.recency == 1 and cfg.scorer.legacy_weights == Weights()
    bad = tmp_path / "c.json"
    bad.write_text("{nope")
    assert load_config(str(bad)) == ScoringConfig() and "ignored" in capsys.readouterr().err
