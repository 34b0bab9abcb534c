"""Walks, resolution, history, impact and scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.functions import parsing, paths
from tracegraph.functions.runtime_names import runtime_names
from tracegraph.operators import causal, history, impact, incremental, lookup, resolve, scope, traverse
from tracegraph.operators.graph import Graph, symbols_with_path
from tracegraph.operators.shared import first_per_key, materialise, overlap_join
from tracegraph.plans.lookups import COCHANGE_SQL, FIRST_DEF_SQL, NAME, PATH, RECENT_SQL, RUNTIME, TEST_SQL
from tracegraph.plans.registry import query, sql_list


def callers_sql(name: str, depth: int, min_confidence: float = 0.5) -> str:
    """CTEs ending in ``callers``: one row per (file, name) at its smallest depth."""
    return f"""
    calls AS (SELECT * FROM edges WHERE kind = 'CALLS' AND to_symbol_id IS NOT NULL AND confidence >= {min_confidence}),
    walk(id, d) AS (
        SELECT id, 0 FROM symbols WHERE name = '{name}'
        UNION SELECT c.from_symbol_id, w.d + 1 FROM walk w JOIN calls c ON c.to_symbol_id = w.id WHERE w.d < {depth - 1}),
    reached AS (SELECT id, min(d) AS d FROM walk GROUP BY id),
    callers AS (
        SELECT * FROM (
            SELECT s.name, f.path AS file, c.call_line AS line, c.confidence, r.d + 1 AS depth, pf.path AS parent_file, p.name AS parent_name,
                   row_number() OVER (PARTITION BY f.path, s.name ORDER BY r.d, c.confidence DESC, c.call_line, s.id, r.id) AS rn
            FROM reached r JOIN calls c ON c.to_symbol_id = r.id
            JOIN symbols s ON s.id = c.from_symbol_id JOIN files f ON f.id = s.file_id
            JOIN symbols p ON p.id = r.id JOIN files pf ON pf.id = p.file_id) x WHERE rn = 1)"""


def callees_sql(name: str, depth: int) -> str:
    return f"""
    out_calls AS (SELECT * FROM edges WHERE kind = 'CALLS'),
    down(id, d) AS (
        SELECT id, 0 FROM symbols WHERE name = '{name}'
        UNION SELECT c.to_symbol_id, w.d + 1 FROM down w JOIN out_calls c ON c.from_symbol_id = w.id
        WHERE w.d < {depth - 1} AND c.to_symbol_id IS NOT NULL),
    reached_down AS (SELECT id, min(d) AS d FROM down GROUP BY id),
    callees AS (
        SELECT * FROM (
            SELECT c.to_name AS name, f.path AS file, c.call_line AS line, c.confidence, r.d + 1 AS depth,
                   c.to_symbol_id IS NOT NULL AS resolved, c.resolution_kind,
                   row_number() OVER (PARTITION BY coalesce(f.path, '?'), c.to_name
                       ORDER BY r.d, c.confidence DESC, c.call_line, coalesce(c.resolution_kind, ''), coalesce(c.to_symbol_id, -1), r.id) AS rn
            FROM reached_down r JOIN out_calls c ON c.from_symbol_id = r.id
            LEFT JOIN symbols s ON s.id = c.to_symbol_id LEFT JOIN files f ON f.id = s.file_id) x WHERE rn = 1)"""


CALLER_COLUMNS = "name, file, line, confidence, depth, parent_file, parent_name"


@query("g01_callers_of", f"WITH {callers_sql(NAME, 2)} SELECT '{NAME}' AS seed_id, {CALLER_COLUMNS} FROM callers")
def g01(g):
    return traverse.callers_of(g, NAME)


@query("g01_callers_of_depth5", f"WITH {callers_sql(NAME, 5)} SELECT '{NAME}' AS seed_id, {CALLER_COLUMNS} FROM callers")
def g01_deep(g):
    return traverse.callers_of(g, NAME, depth=5)


@query("g01_callers_strict", f"WITH {callers_sql(NAME, 2, 0.9)} SELECT '{NAME}' AS seed_id, {CALLER_COLUMNS} FROM callers")
def g01_strict(g):
    return traverse.callers_of(g, NAME, depth=2, min_confidence=0.9)


@query("g01_callers_of_all_classes", """
    WITH calls AS (SELECT * FROM edges WHERE kind = 'CALLS' AND to_symbol_id IS NOT NULL AND confidence >= 0.5),
    seeds AS (SELECT c.id AS seed_id, s.id FROM symbols c JOIN symbols s ON s.name = c.name WHERE c.kind = 'class'),
    level1 AS (SELECT DISTINCT seed_id, c.from_symbol_id AS id FROM seeds JOIN calls c ON c.to_symbol_id = seeds.id),
    expanded AS (SELECT seed_id, id, min(d) AS d FROM (SELECT seed_id, id, 0 AS d FROM seeds UNION ALL SELECT seed_id, id, 1 FROM level1) x GROUP BY ALL),
    named AS (SELECT e.seed_id, s.name, s.file_id, min(e.d) + 1 AS depth FROM expanded e JOIN calls c ON c.to_symbol_id = e.id
              JOIN symbols s ON s.id = c.from_symbol_id GROUP BY ALL)
    SELECT seed_id, depth, count(*) AS n FROM named GROUP BY ALL""")
def g01_batch(g):
    seeds = g.symbols.filter(F.col("kind") == "class").select(F.col("id").alias("seed_id"), "name")
    per_name = traverse.callers_of(g, traverse.name_seeds(seeds)).groupBy(F.col("seed_id").alias("name"), "depth").agg(F.count(F.lit(1)).alias("n"))
    return seeds.join(per_name, "name").select("seed_id", "depth", "n")


@query("g02_callees_of", f"""
    WITH {callees_sql(NAME, 1)}
    SELECT name, coalesce(file, '?') AS file, line, confidence, depth, resolved, coalesce(resolution_kind, '') AS resolution_kind FROM callees""")
def g02(g):
    return _callee_rows(traverse.callees_of(g, NAME))


@query("g02_callees_of_depth3", f"""
    WITH {callees_sql(NAME, 3)}
    SELECT name, coalesce(file, '?') AS file, line, confidence, depth, resolved, coalesce(resolution_kind, '') AS resolution_kind FROM callees""")
def g02_deep(g):
    return _callee_rows(traverse.callees_of(g, NAME, depth=3))


def _callee_rows(df):
    return df.select(
        "name", F.coalesce("file", F.lit("?")).alias("file"), "line", "confidence", "depth", "resolved",
        F.coalesce("resolution_kind", F.lit("")).alias("resolution_kind"),
    )


PAIRS = [(1, NAME, "rapid_bolt_9"), (2, "small_widget_0", "slow_spring_1"), (3, "tiny_widget_5", "tiny_widget_5"), (4, "small_bolt_8", "no_such_name")]
FLOW_SQL = """
    flow AS (SELECT from_symbol_id AS src, to_symbol_id AS dst FROM edges WHERE kind = 'CALLS' AND to_symbol_id IS NOT NULL
             UNION SELECT b.source_symbol_id, e.from_symbol_id FROM arg_bindings b JOIN edges e ON e.id = b.edge_id
             WHERE b.source_kind = 'identifier' AND b.source_symbol_id IS NOT NULL)"""


def _pairs(g):
    return g.spark.createDataFrame(PAIRS, "pair_id int, from_name string, to_name string")


@query("g03_path_hops", f"""
    WITH pairs(pair_id, from_name, to_name) AS (VALUES {', '.join(str(p) for p in PAIRS)}), {FLOW_SQL},
    steps(pair_id, id, d) AS (
        SELECT pair_id, s.id, 0 FROM pairs JOIN symbols s ON s.name = from_name
        UNION SELECT t.pair_id, f.dst, t.d + 1 FROM steps t JOIN flow f ON f.src = t.id WHERE t.d < 5)
    SELECT p.pair_id, CAST(min(t.d) AS INTEGER) AS hops FROM pairs p JOIN symbols s ON s.name = p.to_name
    JOIN steps t ON t.pair_id = p.pair_id AND t.id = s.id GROUP BY p.pair_id""")
def g03_hops(g):
    return traverse.path_between(g, _pairs(g)).groupBy("pair_id").agg(F.max("step").alias("hops"))


@query("g03_path_between")
def g03(g):
    return traverse.path_between(g, _pairs(g))


NODE_CHANGES_SQL = f"""
    {RECENT_SQL},
    first_range AS (SELECT * FROM (
        SELECT f.path AS file, s.name, s.file_id, s.start_line, s.end_line,
               row_number() OVER (PARTITION BY f.path, s.name ORDER BY s.start_line, s.id) AS rn
        FROM symbols s JOIN files f ON f.id = s.file_id) x WHERE rn = 1),
    node_hits AS (SELECT DISTINCT a.file, a.name, r.commit_id, r.sha, r.author, r.date, r.subject, r.days_ago
        FROM first_range a JOIN recent r ON r.file_id = a.file_id AND a.start_line <= r.he AND a.end_line >= r.hs),
    node_changes AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY date DESC, commit_id DESC) AS change_rank FROM node_hits) x
        WHERE change_rank <= 3)"""


@query("g04_recency_hydration", f"""
    WITH {callers_sql(NAME, 2)}, {NODE_CHANGES_SQL}
    SELECT c.name, c.file, c.depth, n.sha, CASE WHEN n.author = '' THEN 'unknown' ELSE n.author END AS author, n.days_ago, n.change_rank
    FROM callers c JOIN node_changes n ON n.file = c.file AND n.name = c.name""")
def g04(g):
    nodes = traverse.callers_of(g, NAME)
    changes = history.node_changes(g, nodes)
    return nodes.join(changes, ["file", "name"]).select("name", "file", "depth", "sha", "author", "days_ago", "change_rank")


MENTIONS_SQL = f"""
    test_files AS (SELECT path, content FROM file_text WHERE {TEST_SQL}),
    mentions AS (SELECT DISTINCT n.name, t.path AS test_path FROM (SELECT DISTINCT name FROM symbols) n JOIN test_files t ON contains(t.content, n.name))"""

UNRESOLVED_SQL = f"""
    unresolved AS (SELECT s.name, f.path AS file, count(DISTINCT e.to_name) AS n_unresolved
        FROM edges e JOIN symbols s ON s.id = e.from_symbol_id JOIN files f ON f.id = s.file_id
        WHERE e.kind = 'CALLS' AND e.to_symbol_id IS NULL AND e.to_name NOT IN ({RUNTIME}) GROUP BY ALL)"""


def impact_sql(name: str, depth: int) -> str:
    return f"""
    {callers_sql(name, depth)}, {NODE_CHANGES_SQL}, {MENTIONS_SQL}, {UNRESOLVED_SQL},
    recent30 AS (SELECT file, name, count(*) FILTER (days_ago <= 30) AS n_recent FROM node_changes GROUP BY ALL),
    chosen AS (SELECT * FROM ({FIRST_DEF_SQL}) d WHERE name = '{name}'),
    facts AS (
        SELECT c.name, c.file, c.line, c.depth AS distance, coalesce(u.n_unresolved, 0) AS n_unresolved, coalesce(r.n_recent, 0) AS n_recent,
               c.name IN (SELECT name FROM mentions) AS has_test
        FROM callers c LEFT JOIN unresolved u ON u.file = c.file AND u.name = c.name LEFT JOIN recent30 r ON r.file = c.file AND r.name = c.name
        WHERE NOT EXISTS (SELECT 1 FROM chosen k WHERE k.path = c.file AND k.name = c.name)),
    nodes AS (
        SELECT *, round(least(1.0, greatest(0.0, (CASE WHEN n_unresolved >= 1 THEN 0.4 ELSE 0 END) + least(0.6, n_recent * 0.3)
               + (CASE WHEN has_test THEN 0 ELSE 0.2 END) + greatest(0, {depth} - distance + 1) * 0.1)), 6) AS risk FROM facts
        UNION ALL SELECT name, path, start_line, 0, 0, 0, name IN (SELECT name FROM mentions), 0.0 FROM chosen)"""


@query("g05_impact", f"WITH {impact_sql(NAME, 3)} SELECT name, file, line, distance, n_unresolved, n_recent, has_test, CAST(risk AS DOUBLE) AS risk FROM nodes")
def g05(g):
    return impact.impact(g, NAME).select(
        "name", "file", "line", "distance", "n_unresolved", "n_recent", "has_test", F.round("risk", 6).alias("risk")
    )


@query("a10_impact_summary", f"""
    WITH {impact_sql(NAME, 2)} SELECT CAST(max(risk) AS DOUBLE) AS max_risk, max(distance) AS max_distance, count(*) AS affected FROM nodes""")
def a10(g):
    return impact.impact_summary(impact.impact(g, NAME, 2)).select(F.round("max_risk", 6).alias("max_risk"), "max_distance", "affected")


@query("a09_file_rollup", f"""
    WITH {impact_sql(NAME, 2)}
    SELECT file, count(*) AS n, CAST(max(risk) AS DOUBLE) AS max_risk, first(name ORDER BY risk DESC, distance, name) AS hottest FROM nodes GROUP BY file""")
def a09(g):
    nodes = impact.impact(g, NAME, 2).withColumn("risk", F.round("risk", 6))
    return impact.file_rollup(nodes).select("file", "n", "max_risk", "hottest")


@query("a07_untested_callers", f"""
    WITH {impact_sql(NAME, 2)}
    SELECT name, file, line, CAST(risk AS DOUBLE) AS risk FROM nodes WHERE distance > 0 AND NOT has_test ORDER BY risk DESC, file, name LIMIT 3""")
def a07(g):
    return impact.untested_callers(impact.impact(g, NAME, 2).withColumn("risk", F.round("risk", 6)))


@query("a19_total_affected", f"WITH {impact_sql(NAME, 2)} SELECT count(*) AS total_affected FROM nodes WHERE distance > 0")
def a19(g):
    return impact.total_affected(impact.impact(g, NAME, 2))


@query("l06_impact_order", f"""
    WITH {impact_sql(NAME, 2)} SELECT name, file, CAST(risk AS DOUBLE) AS risk, distance FROM nodes ORDER BY risk DESC, distance, file, name LIMIT 20""")
def l06(g):
    nodes = impact.impact(g, NAME, 2).withColumn("risk", F.round("risk", 6))
    return nodes.orderBy(F.desc("risk"), "distance", "file", "name").limit(20).select("name", "file", "risk", "distance")


@query("g06_test_coverage", f"""
    WITH {MENTIONS_SQL},
    pairs AS (SELECT DISTINCT f.path AS file, s.name, m.test_path,
        CASE WHEN regexp_extract(m.test_path, '^(.*)/[^/]*$', 1) IN
             (regexp_extract(f.path, '^(.*)/[^/]*$', 1), regexp_extract(f.path, '^(.*)/[^/]*$', 1) || '/tests') THEN 0 ELSE 1 END AS near
        FROM symbols s JOIN files f ON f.id = s.file_id JOIN mentions m ON m.name = s.name)
    SELECT file, name, regexp_extract(test_path, '([^/]*)$', 1) AS test, test_path, test_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY near, test_path) AS test_rank FROM pairs) x WHERE test_rank <= 8""")
def g06(g):
    nodes = symbols_with_path(g).select(F.col("path").alias("file"), "name")
    return impact.covering_tests(g, nodes)


@query("j20_tests_mentioning", f"WITH {MENTIONS_SQL} SELECT name, test_path FROM mentions")
def j20(g):
    return impact.tests_mentioning(g, g.symbols.select("name").distinct())


# ---- history ----------------------------------------------------------------

@query("s11_recently_changed_near", f"""
    WITH {RECENT_SQL},
    defs AS (SELECT s.*, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = '{NAME}' ORDER BY f.path, s.start_line, s.id LIMIT 5),
    hits AS (SELECT DISTINCT d.id AS symbol_id, d.path AS file, r.commit_id, r.sha, r.author, r.date, r.subject, r.days_ago
        FROM defs d JOIN recent r ON r.file_id = d.file_id AND d.start_line <= r.he AND d.end_line >= r.hs),
    per_def AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY date DESC, commit_id DESC) AS rn FROM hits)
    SELECT sha AS commit, CASE WHEN author = '' THEN 'unknown' ELSE author END AS author, date, subject, file, '{NAME}' AS symbol_name, days_ago
    FROM per_def WHERE rn <= 20 ORDER BY date DESC, sha DESC, file, symbol_id LIMIT 20""")
def s11(g):
    return history.recently_changed_near(g, NAME).drop("seed_id", "symbol_id")


@query("s12_recency_top3", f"""
    WITH {NODE_CHANGES_SQL}
    SELECT file, name, sha, days_ago, change_rank FROM node_changes""")
def s12(g):
    nodes = symbols_with_path(g).select(F.col("path").alias("file"), "name")
    return history.node_changes(g, nodes).select("file", "name", "sha", "days_ago", "change_rank")


@query("s13_cochange_scan", f"""
    WITH {COCHANGE_SQL}
    SELECT t.commit_id, count(*) AS n_files FROM touched t WHERE commit_id IN (SELECT commit_id FROM mine) GROUP BY t.commit_id""")
def s13(g):
    touched = history.commit_files(g, 365)
    seed = g.files.filter(F.col("path") == PATH).select(F.col("id").alias("file_id"))
    mine = touched.join(seed, "file_id").orderBy(F.desc("date"), F.desc("commit_id")).limit(200).select("commit_id")
    return touched.join(mine, "commit_id", "left_semi").groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_files"))


@query("l02_newest_commits", f"""
    WITH {RECENT_SQL}
    SELECT DISTINCT sha, date, days_ago FROM recent ORDER BY date DESC, sha DESC LIMIT 20""")
def l02(g):
    touched = g.commit_lines.select("commit_id")
    return history.recent_commits(g, 90).join(touched, "commit_id", "left_semi").select("sha", "date", "days_ago").orderBy(
        F.desc("date"), F.desc("sha")
    ).limit(20)


@query("a11_newest_change_per_file", f"""
    WITH {RECENT_SQL}
    SELECT file_id, min(days_ago) AS newest_days, count(DISTINCT commit_id) AS n_commits FROM recent GROUP BY file_id""")
def a11(g):
    per_commit = g.commit_lines.select("file_id", "commit_id").distinct().join(history.recent_commits(g, 90), "commit_id")
    return per_commit.groupBy("file_id").agg(F.min("days_ago").alias("newest_days"), F.count(F.lit(1)).alias("n_commits"))


# ---- resolution --------------------------------------------------------------

RESOLVE_SQL = f"""
    owner AS (SELECT l.id, arg_min(o.id, (o.end_line - o.start_line) * CAST(100000000 AS BIGINT) + o.id) AS owner_id
        FROM symbols l JOIN symbols o ON o.file_id = l.file_id AND o.start_line <= l.start_line AND l.start_line <= o.end_line
        WHERE l.kind = 'local' AND o.kind IN ('function', 'method', 'const') GROUP BY l.id),
    bf AS (SELECT s.* REPLACE (coalesce(s.parent_id, o.owner_id) AS parent_id) FROM symbols s LEFT JOIN owner o ON o.id = s.id),
    r0 AS (SELECT r.*, s.file_id AS from_file, s.kind AS from_kind, s.parent_id AS from_parent FROM raw_edges r JOIN bf s ON s.id = r.from_symbol_id),
    uniq AS (SELECT file_id, name, min(id) AS target FROM bf GROUP BY ALL HAVING count(*) = 1),
    r1 AS (SELECT r.* REPLACE (u.target AS to_symbol_id) FROM r0 r LEFT JOIN uniq u ON u.file_id = r.from_file AND u.name = r.to_name),
    own AS (SELECT parent_id, name, count(*) AS n, min(id) AS own FROM bf WHERE kind = 'method' GROUP BY ALL),
    sole AS (SELECT name, min(id) AS sole FROM bf WHERE kind = 'method' GROUP BY name HAVING count(*) = 1),
    r2 AS (SELECT r.* EXCLUDE (use, own, sole, n) REPLACE (
               CASE WHEN use THEN coalesce(own, sole) ELSE to_symbol_id END AS to_symbol_id,
               CASE WHEN use THEN (CASE WHEN n = 1 THEN 1.0 ELSE 0.7 END) ELSE confidence END AS confidence)
           FROM (SELECT r.*, o.own, o.n, s.sole, r.to_symbol_id IS NULL AND r.kind = 'CALLS' AND r.from_kind = 'method'
                        AND r.from_parent IS NOT NULL AND coalesce(o.own, s.sole) IS NOT NULL AS use
                 FROM r1 r LEFT JOIN own o ON o.parent_id = r.from_parent AND o.name = r.to_name LEFT JOIN sole s ON s.name = r.to_name) r),
    last_import AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, local_name ORDER BY id DESC) AS rn FROM imports) x WHERE rn = 1),
    import_base AS (SELECT i.*, f.language,
            CASE WHEN f.language = 'python' AND starts_with(source_module, '..') THEN
                     regexp_replace(regexp_extract(f.path, '^(.*)/[^/]*$', 1) || '/../' || replace(source_module[3:], '.', '/'), '[^/]+/\\.\\./', '')
                 WHEN f.language = 'python' THEN replace(source_module, '.', '/')
                 ELSE regexp_replace(regexp_extract(f.path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(source_module, '\\.js$', ''), '[^/]+/\\.\\./', '') END AS base
        FROM last_import i JOIN files f ON f.id = i.file_id WHERE source_module <> 'external-lib' AND f.language <> 'unparsed'),
    bound AS (SELECT b.file_id, b.local_name, b.source_name, arg_min(f.id, x.ord) AS target_file
        FROM import_base b JOIN (VALUES ('python', '.py', 0), ('typescript', '.ts', 0), ('typescript', '.tsx', 1)) x(lang, ext, ord) ON x.lang = b.language
        JOIN files f ON f.path = b.base || x.ext GROUP BY ALL),
    top_level AS (SELECT file_id, name, min(id) AS target FROM bf WHERE parent_id IS NULL GROUP BY ALL HAVING count(*) = 1),
    import_match AS (SELECT b.file_id, b.local_name, t.target FROM bound b JOIN top_level t ON t.file_id = b.target_file AND t.name = b.source_name),
    r3 AS (SELECT r.* REPLACE (coalesce(r.to_symbol_id, m.target) AS to_symbol_id,
               CASE WHEN r.to_symbol_id IS NULL AND m.target IS NOT NULL THEN 1.0 ELSE r.confidence END AS confidence)
           FROM r2 r LEFT JOIN import_match m ON m.file_id = r.from_file AND m.local_name = r.to_name),
    r4 AS (SELECT * REPLACE (CASE WHEN to_symbol_id IS NULL AND kind = 'CALLS' THEN least(confidence, 0.5) ELSE confidence END AS confidence) FROM r3),
    r5 AS (SELECT r.* REPLACE (CASE WHEN r.to_symbol_id IS NULL AND r.kind = 'CALLS' THEN
               CASE WHEN r.to_name IN ({RUNTIME}) THEN 'stdlib' WHEN NOT starts_with(i.source_module, '.') THEN 'external_module'
                    WHEN contains(r.line_text, '.' || r.to_name || '(') THEN 'instance_method' ELSE 'unknown' END END AS resolution_kind)
           FROM r4 r LEFT JOIN last_import i ON i.file_id = r.from_file AND i.local_name = r.to_name),
    receivers AS (SELECT parent_id, name, arg_min(type_text, id) AS type_text FROM bf
        WHERE kind IN ('param', 'local') AND type_text IS NOT NULL AND parent_id IS NOT NULL GROUP BY ALL),
    class_methods AS (SELECT c.name AS class_name, m.name, min(m.id) AS target FROM bf c JOIN bf m ON m.parent_id = c.id
        WHERE c.kind IN ('class', 'interface') AND m.kind = 'method' GROUP BY ALL HAVING count(*) = 1),
    receiver_hits AS (SELECT DISTINCT r.from_symbol_id, r.to_name, r.line_text, c.target FROM r5 r
        JOIN receivers v ON v.parent_id = r.from_symbol_id AND starts_with(trim(r.line_text), v.name || '.' || r.to_name || '(')
        JOIN class_methods c ON c.name = r.to_name AND c.class_name = regexp_extract(v.type_text, '^(?:Optional\\[)?([A-Za-z_0-9]+)', 1)
        WHERE r.resolution_kind = 'instance_method'),
    r6 AS (SELECT r.* REPLACE (coalesce(h.target, r.to_symbol_id) AS to_symbol_id,
               CASE WHEN h.target IS NOT NULL THEN 0.8 ELSE r.confidence END AS confidence,
               CASE WHEN h.target IS NOT NULL THEN NULL ELSE r.resolution_kind END AS resolution_kind)
           FROM r5 r LEFT JOIN receiver_hits h ON h.from_symbol_id = r.from_symbol_id AND h.to_name = r.to_name AND h.line_text = r.line_text
                AND r.resolution_kind = 'instance_method')"""

EDGE_COLUMNS = "id, from_symbol_id, coalesce(to_symbol_id, -1) AS to_symbol_id, to_name, confidence, coalesce(resolution_kind, '') AS resolution_kind"


def _edge_rows(df):
    return df.select(
        "id", "from_symbol_id", F.coalesce("to_symbol_id", F.lit(-1)).alias("to_symbol_id"), "to_name", "confidence",
        F.coalesce("resolution_kind", F.lit("")).alias("resolution_kind"),
    )


def _resolved(g, steps):
    return resolve.resolve(g, py_roots=g.py_roots, steps=steps)


for _key, _steps, _table in [
    ("g10_same_file_resolution", 1, "r1"), ("g11_self_method_resolution", 2, "r2"), ("g12_import_resolution", 3, "r3"),
    ("g13_confidence_demotion", 4, "r4"), ("g14_open_call_classes", 5, "r5"), ("g15_receiver_resolution", 6, "r6"),
]:
    def _job(g, steps=_steps):
        return _edge_rows(_resolved(g, steps)["edges"])

    query(_key, f"WITH {RESOLVE_SQL} SELECT {EDGE_COLUMNS} FROM {_table}")(_job)


@query("g16_argument_sources", f"""
    WITH {RESOLVE_SQL},
    scoped AS (SELECT parent_id, name, min(id) FILTER (kind = 'param') AS p, min(id) FILTER (kind = 'local') AS l
               FROM bf WHERE parent_id IS NOT NULL GROUP BY ALL),
    tops AS (SELECT file_id, name, min(id) AS t FROM bf WHERE parent_id IS NULL GROUP BY ALL),
    via AS (SELECT from_file, to_name, min(to_symbol_id) AS v FROM r6 WHERE to_symbol_id IS NOT NULL GROUP BY ALL)
    SELECT a.edge_id, a.position, a.source_kind, a.source_text,
           coalesce(a.source_symbol_id, CASE WHEN a.source_kind = 'identifier' THEN coalesce(s.p, s.l, t.t, v.v) END, -1) AS source_symbol_id
    FROM arg_bindings a LEFT JOIN (SELECT DISTINCT id, from_symbol_id, from_file FROM r0) e ON e.id = a.edge_id
    LEFT JOIN scoped s ON s.parent_id = e.from_symbol_id AND s.name = a.source_text
    LEFT JOIN tops t ON t.file_id = e.from_file AND t.name = a.source_text
    LEFT JOIN via v ON v.from_file = e.from_file AND v.to_name = a.source_text""")
def g16(g):
    out = _resolved(g, 7)["arg_bindings"]
    return out.withColumn("source_symbol_id", F.coalesce("source_symbol_id", F.lit(-1)))


# ---- resolution after a change ------------------------------------------------

# Files with a change in the last hour; before it their symbols had other names.
TOUCHED_SQL = """
    touched AS (SELECT DISTINCT f.id AS file_id, f.path FROM changes c JOIN files f ON f.path = c.path
        WHERE c.ts >= (SELECT max(ts) FROM changes) - INTERVAL 1 HOUR)"""


def _before_last_hour(g):
    newest = g.changes.select(F.max("ts")).scalar()
    recent = g.changes.filter(F.col("ts") >= newest - F.expr("INTERVAL 1 HOUR")).select("path").distinct()
    touched, _ = materialise(g.files.join(recent, "path", "left_semi").select(F.col("id").alias("file_id")))
    mark = touched.withColumn("_touched", F.lit(True))
    renamed = F.when(F.col("_touched"), F.concat("name", F.lit("_before"))).otherwise(F.col("name"))
    symbols = g.symbols.join(mark, "file_id", "left").withColumn("name", renamed).select(*g.symbols.columns)
    return Graph(files=g.files, symbols=symbols, raw_edges=g.raw_edges, imports=g.imports, arg_bindings=g.arg_bindings), touched


def _no_packages(g):
    return g.spark.createDataFrame([], "package string, root string")


@query("t05_affected_files", f"""
    WITH {RESOLVE_SQL}, {TOUCHED_SQL},
    changed_tops AS (SELECT DISTINCT t.path FROM touched t JOIN bf s ON s.file_id = t.file_id WHERE s.parent_id IS NULL),
    by_name AS (SELECT r.from_file AS file_id FROM r0 r WHERE r.kind = 'CALLS'
        AND r.to_name IN (SELECT s.name FROM symbols s JOIN touched t ON t.file_id = s.file_id WHERE s.kind = 'method')),
    by_path AS (SELECT b.file_id FROM import_base b
        JOIN (VALUES ('python', '.py'), ('typescript', '.ts'), ('typescript', '.tsx')) x(lang, ext) ON x.lang = b.language
        JOIN changed_tops c ON c.path = b.base || x.ext)
    SELECT file_id FROM touched UNION SELECT file_id FROM by_name UNION SELECT file_id FROM by_path""")
def t05_affected(g):
    """Files whose edges can resolve differently after the changes of the last hour."""
    old, touched = _before_last_hour(g)
    depends = incremental.dependencies(old, g.py_roots, _no_packages(g))
    return incremental.affected_files(depends, incremental.changed_keys(old, g, touched), touched)


@query("t05_incremental_resolution", f"WITH {RESOLVE_SQL} SELECT {EDGE_COLUMNS} FROM r6")
def t05_resolution(g):
    """Edges of the state before the last hour, with those that its changes reach resolved again."""
    old, touched = _before_last_hour(g)
    before = resolve.with_caller(resolve.resolve(old, g.py_roots, _no_packages(g), steps=6)["edges"], old.symbols)
    change = incremental.resolve_change(old, g, touched, py_roots=g.py_roots, packages=_no_packages(g))
    kept = before.join(change["affected"].withColumnRenamed("file_id", "from_file"), "from_file", "left_anti")
    return _edge_rows(kept.select(*change["edges"].columns).unionByName(change["edges"]))


@query("g17_local_parents", f"WITH {RESOLVE_SQL} SELECT id, coalesce(parent_id, -1) AS parent_id FROM bf WHERE kind = 'local'")
def g17(g):
    out = resolve.backfill_local_parents(g.symbols).filter(F.col("kind") == "local")
    return out.select("id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query("j06_unique_name_in_file", "SELECT file_id, name, min(id) AS target FROM symbols GROUP BY ALL HAVING count(*) = 1")
def j06(g):
    return resolve.only_one(g.symbols, ["file_id", "name"], "id", "target")


@query("j07_local_owner_range", f"WITH {RESOLVE_SQL} SELECT id, owner_id FROM owner")
def j07(g):
    was_open = g.symbols.filter((F.col("kind") == "local") & F.col("parent_id").isNull()).select("id")
    filled = resolve.backfill_local_parents(g.symbols).join(was_open, "id", "left_semi")
    return filled.filter(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("owner_id"))


@query("j09_last_import_per_name", f"""
    WITH {RESOLVE_SQL}
    SELECT e.from_file, e.to_name, i.source_module, count(*) AS n FROM r0 e JOIN last_import i ON i.file_id = e.from_file AND i.local_name = e.to_name GROUP BY ALL""")
def j09(g):
    edges = resolve.with_caller(g.raw_edges, g.symbols).groupBy("from_file", "to_name").agg(F.count(F.lit(1)).alias("n"))
    bound = resolve.last_imports(g.imports).select(F.col("file_id").alias("from_file"), F.col("local_name").alias("to_name"), "source_module")
    return edges.join(bound, ["from_file", "to_name"]).select("from_file", "to_name", "source_module", "n")


@query("j10_import_target_file", f"WITH {RESOLVE_SQL} SELECT file_id, local_name, source_name, target_file FROM bound")
def j10(g):
    empty = g.spark.createDataFrame([], "package string, root string")
    out = resolve.import_targets(resolve.last_imports(g.imports), g.files, g.py_roots, empty)
    return out.select("file_id", "local_name", "source_name", "target_file")


@query("j16_absolute_module_root", """
    SELECT i.id, split_part(i.source_module, '.', 1) AS root FROM imports i JOIN files f ON f.id = i.file_id
    WHERE f.language = 'python' AND NOT starts_with(i.source_module, '.') AND i.source_module <> 'external-lib'""")
def j16(g):
    python = g.files.filter(F.col("language") == "python").select(F.col("id").alias("file_id"))
    absolute = g.imports.filter(~F.col("source_module").startswith(".")).join(python, "file_id", "left_semi")
    keyed = absolute.withColumn("package", F.substring_index("source_module", ".", 1))
    return keyed.join(g.py_roots, "package").select("id", "root")


@query("j11_receiver_types", f"WITH {RESOLVE_SQL} SELECT id, to_symbol_id FROM r6 WHERE confidence = 0.8 AND to_symbol_id IS NOT NULL")
def j11(g):
    return _resolved(g, 6)["edges"].filter((F.col("confidence") == 0.8) & F.col("to_symbol_id").isNotNull()).select("id", "to_symbol_id")


@query("j12_argument_priority", f"""
    WITH {RESOLVE_SQL},
    scoped AS (SELECT parent_id, name, min(id) FILTER (kind = 'param') AS p, min(id) FILTER (kind = 'local') AS l
               FROM bf WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT CASE WHEN s.p IS NOT NULL THEN 'param' WHEN s.l IS NOT NULL THEN 'local' ELSE 'other' END AS tier, count(*) AS n
    FROM arg_bindings a JOIN (SELECT DISTINCT id, from_symbol_id FROM r0) e ON e.id = a.edge_id
    LEFT JOIN scoped s ON s.parent_id = e.from_symbol_id AND s.name = a.source_text WHERE a.source_kind = 'identifier' GROUP BY ALL""")
def j12(g):
    symbols = resolve.backfill_local_parents(g.symbols)
    scoped = symbols.filter(F.col("parent_id").isNotNull()).groupBy(
        F.col("parent_id").alias("from_symbol_id"), F.col("name").alias("source_text")
    ).agg(F.bool_or(F.col("kind") == "param").alias("p"), F.bool_or(F.col("kind") == "local").alias("l"))
    edges = g.raw_edges.select(F.col("id").alias("edge_id"), "from_symbol_id").distinct()
    ident = g.arg_bindings.filter(F.col("source_kind") == "identifier").join(edges, "edge_id")
    tier = F.when(F.col("p"), "param").when(F.col("l"), "local").otherwise("other")
    return ident.join(scoped, ["from_symbol_id", "source_text"], "left").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# ---- scope -------------------------------------------------------------------

@query("g08_symbol_definition_search", f"""
    SELECT DISTINCT path FROM patches WHERE regexp_matches(patch, '\\b(?:function|class|def|interface|type|enum)\\s+{NAME}\\b|\\b(?:const|let|var)\\s+{NAME}\\b\\s*=')""")
def g08(g):
    texts = g.patches.select(F.col("file_id").alias("id"), "path", F.col("patch").alias("content"))
    return scope.symbol_files(texts, NAME).select("path").distinct()


IMPORT_EDGES_SQL = """
    specs AS (
        SELECT id, language, path, unnest(regexp_extract_all(content, 'from "([^"]+)"', 1)) AS spec FROM file_text WHERE language <> 'python'
        UNION ALL SELECT id, language, path, unnest(regexp_extract_all(content, '(?m)^\\s*from\\s+(\\.+\\w*(?:\\.\\w+)*)\\s+import\\s+', 1)) FROM file_text WHERE language = 'python'),
    bases AS (SELECT id, language, CASE WHEN language = 'python' THEN
            regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1) || '/../' || replace(spec[3:], '.', '/'), '[^/]+/\\.\\./', '')
            ELSE regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(spec, '\\.js$', ''), '[^/]+/\\.\\./', '') END AS base
        FROM specs WHERE language <> 'unparsed'),
    import_edges AS (SELECT DISTINCT b.id AS from_file, f.id AS to_file FROM bases b
        JOIN (VALUES ('python', '.py'), ('typescript', '.ts'), ('typescript', '.tsx')) x(lang, ext) ON x.lang = b.language
        JOIN files f ON f.path = b.base || x.ext WHERE f.id <> b.id)"""


@query("f17_relative_import_edges", f"WITH {IMPORT_EDGES_SQL} SELECT from_file, to_file FROM import_edges")
def f17(g):
    return scope.file_import_edges(g).select("from_file", "to_file")


def _trace_seeds(g):
    traces = g.traces.select(F.col("id").alias("failure_id"), "text")
    return scope.trace_seeds(traces, g.files)


TRACE_SQL = """
    node_frames AS (SELECT id, unnest(regexp_extract_all(text, 'at\\s+(?:([^\\s()]+)\\s+\\()?([^\\s():]+):(\\d+)(?::(\\d+))?\\)?', 2)) AS path,
                           unnest(regexp_extract_all(text, 'at\\s+(?:([^\\s()]+)\\s+\\()?([^\\s():]+):(\\d+)(?::(\\d+))?\\)?', 1)) AS symbol,
                           unnest(range(0, len(regexp_extract_all(text, 'at\\s+(?:([^\\s()]+)\\s+\\()?([^\\s():]+):(\\d+)(?::(\\d+))?\\)?', 2)))) AS pos FROM traces),
    py_frames AS (SELECT id, unnest(regexp_extract_all(text, 'File\\s+"([^"]+)",\\s+line\\s+(\\d+),\\s+in\\s+(\\S+)', 1)) AS path,
                         unnest(regexp_extract_all(text, 'File\\s+"([^"]+)",\\s+line\\s+(\\d+),\\s+in\\s+(\\S+)', 3)) AS symbol,
                         unnest(range(100, 100 + len(regexp_extract_all(text, 'File\\s+"([^"]+)",\\s+line\\s+(\\d+),\\s+in\\s+(\\S+)', 1)))) AS pos FROM traces),
    frames AS (SELECT id, path, arg_min(coalesce(symbol, ''), pos) AS symbol, min(pos) AS pos FROM (SELECT * FROM node_frames UNION ALL SELECT * FROM py_frames) x GROUP BY ALL),
    seeds AS (SELECT failure_id, file_id, seed_ord, symbol FROM (
        SELECT r.id AS failure_id, f.id AS file_id, r.symbol, row_number() OVER (PARTITION BY r.id ORDER BY r.pos) AS seed_ord
        FROM frames r JOIN files f ON f.path = r.path WHERE f.language <> 'unparsed') y WHERE seed_ord <= 5)"""


@query("f15_stack_trace_seeds", f"WITH {TRACE_SQL} SELECT failure_id, file_id, seed_ord, symbol FROM seeds")
def f15(g):
    return _trace_seeds(g)


@query("g21_trace_primary_symbol", f"""
    WITH {TRACE_SQL} SELECT failure_id, arg_min(symbol, seed_ord) AS symbol FROM seeds WHERE symbol NOT IN ('', '<anonymous>') GROUP BY failure_id""")
def g21_trace(g):
    return scope.primary_symbol(_trace_seeds(g))


@query("g07_scope_files", f"""
    WITH {TRACE_SQL}, {IMPORT_EDGES_SQL},
    stage0 AS (SELECT failure_id, file_id, 0 AS stage FROM seeds),
    stage2 AS (SELECT DISTINCT s.failure_id, e.to_file AS file_id, 2 AS stage FROM stage0 s JOIN import_edges e ON e.from_file = s.file_id),
    upto2 AS (SELECT failure_id, file_id, min(stage) AS stage FROM (SELECT * FROM stage0 UNION ALL SELECT * FROM stage2) x GROUP BY ALL),
    stage3 AS (SELECT DISTINCT s.failure_id, e.to_file AS file_id, 3 AS stage FROM upto2 s JOIN import_edges e ON e.from_file = s.file_id WHERE s.stage = 2)
    SELECT failure_id, file_id, min(stage) AS stage FROM (SELECT * FROM upto2 UNION ALL SELECT * FROM stage3) x GROUP BY ALL""")
def g07(g):
    """Files in scope of every trace; the budget is far from reached here."""
    return scope.resolve_scope(g, _trace_seeds(g), scope.file_import_edges(g), max_loc=10_000_000).select("failure_id", "file_id", "stage")


SCOPED_SQL = """
    {TRACE}, {IMPORTS},
    stage0 AS (SELECT failure_id, file_id FROM seeds),
    stage2 AS (SELECT failure_id, file_id FROM stage0 UNION SELECT s.failure_id, e.to_file FROM stage0 s JOIN import_edges e ON e.from_file = s.file_id),
    scope AS (SELECT failure_id, file_id FROM stage2 UNION SELECT s.failure_id, e.to_file FROM stage2 s JOIN import_edges e ON e.from_file = s.file_id),
    prim AS (SELECT failure_id, arg_min(symbol, seed_ord) AS name FROM seeds WHERE symbol NOT IN ('', '<anonymous>') GROUP BY failure_id),
    starts AS (SELECT DISTINCT p.failure_id, s.id FROM prim p JOIN symbols s ON s.name = p.name JOIN scope c ON c.failure_id = p.failure_id AND c.file_id = s.file_id),
    good AS (SELECT e.*, s.file_id AS from_file FROM edges e JOIN symbols s ON s.id = e.from_symbol_id WHERE e.kind = 'CALLS' AND e.to_symbol_id IS NOT NULL AND e.confidence >= 0.5),
    up1 AS (SELECT DISTINCT q.failure_id, g.from_symbol_id AS id FROM starts q JOIN good g ON g.to_symbol_id = q.id
        JOIN scope c ON c.failure_id = q.failure_id AND c.file_id = g.from_file),
    up AS (SELECT failure_id, id, min(d) AS d FROM (SELECT failure_id, id, 0 AS d FROM starts UNION ALL SELECT failure_id, id, 1 FROM up1) x GROUP BY ALL),
    caller_rows AS (SELECT u.failure_id, f.path AS file, s.name, min(u.d) + 1 AS distance FROM up u JOIN good g ON g.to_symbol_id = u.id
        JOIN scope c ON c.failure_id = u.failure_id AND c.file_id = g.from_file
        JOIN symbols s ON s.id = g.from_symbol_id JOIN files f ON f.id = s.file_id GROUP BY ALL),
    callee_rows AS (SELECT DISTINCT q.failure_id, CASE WHEN c.file_id IS NOT NULL THEN f.path END AS file, e.to_name AS name FROM starts q
        JOIN edges e ON e.from_symbol_id = q.id AND e.kind = 'CALLS' LEFT JOIN symbols s ON s.id = e.to_symbol_id
        LEFT JOIN files f ON f.id = s.file_id LEFT JOIN scope c ON c.failure_id = q.failure_id AND c.file_id = s.file_id),
    first_def AS (SELECT failure_id, name, path FROM (SELECT p.failure_id, p.name, f.path,
            row_number() OVER (PARTITION BY p.failure_id ORDER BY CASE WHEN s.exported THEN 0 ELSE 1 END, f.path, s.start_line, s.id) AS rn
        FROM prim p JOIN symbols s ON s.name = p.name JOIN scope c ON c.failure_id = p.failure_id AND c.file_id = s.file_id JOIN files f ON f.id = s.file_id) x WHERE rn = 1),
    candidates AS (
        SELECT p.failure_id, d.path AS file, p.name, 'anchor' AS role, 0 AS distance, 0 AS o FROM prim p LEFT JOIN first_def d USING (failure_id)
        UNION ALL SELECT failure_id, file, name, 'caller', distance, 1 FROM caller_rows
        UNION ALL SELECT failure_id, file, name, 'callee', 1, 2 FROM callee_rows)
    SELECT failure_id, coalesce(file, '?') AS file, name, role, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY failure_id, file, name ORDER BY distance, o) AS rn FROM candidates) x WHERE rn = 1"""


@query("g18_candidates_in_scope", "WITH " + SCOPED_SQL.format(TRACE=TRACE_SQL, IMPORTS=IMPORT_EDGES_SQL))
def g18_scoped(g):
    """Candidates of every trace, found inside the files in scope of that trace."""
    seeds, _ = materialise(_trace_seeds(g))
    primary = scope.primary_symbol(seeds)
    members, own = scope.seed_classes(seeds.drop("symbol").join(primary, "failure_id"), "symbol")
    files = scope.resolve_scope(g, own, scope.file_import_edges(g), max_loc=10_000_000)
    files, _ = materialise(files.select(F.col("failure_id").alias("scope_id"), "file_id"))
    within = traverse.Scope(files)
    named = own.select(F.col("failure_id").alias("seed_id"), F.col("symbol").alias("name")).distinct()
    rows, _ = materialise(causal.anchors(g, named, within))
    found = causal.candidates_around(g, rows, within=within)
    return scope.for_members(
        found.select(F.col("seed_id").alias("failure_id"), F.coalesce("file", F.lit("?")).alias("file"), "name", "role", "distance"), members
    )


@query("g07_scope_budget", f"""
    WITH {TRACE_SQL}
    SELECT failure_id, file_id, seed_ord AS scope_rank, CAST(sum(loc) OVER (PARTITION BY failure_id ORDER BY seed_ord) AS BIGINT) AS running_loc
    FROM seeds JOIN files ON files.id = file_id""")
def g07_budget(g):
    """With a budget of zero lines only the seeds stay."""
    out = scope.resolve_scope(g, _trace_seeds(g), scope.file_import_edges(g), max_loc=0)
    return out.select("failure_id", "file_id", "scope_rank", "running_loc")


@query("p13_scope_preview")
def p13(g):
    members, seeds = scope.seed_classes(_trace_seeds(g).drop("symbol"))
    found = scope.resolve_scope(
        g, seeds, scope.file_import_edges(g), reverse=scope.importers(g, seeds), cochanged=scope.default_cochange(g, seeds)
    )
    return scope.for_members(found, members)


@query("g09_reverse_importers", f"""
    WITH {TRACE_SQL},
    quoted AS (SELECT id, unnest(regexp_extract_all(content, '(?:from\\s+|require\\(\\s*|import\\s+)["''`]([^"''`]*)["''`]', 1)) AS spec FROM file_text
               UNION ALL SELECT id, unnest(regexp_extract_all(content, 'from\\s+([.\\w]+)\\s+import', 1)) FROM file_text),
    words AS (SELECT DISTINCT id, unnest(regexp_extract_all(spec, '\\w+')) AS stem FROM quoted),
    stems AS (SELECT s.failure_id, s.file_id, s.seed_ord,
        regexp_replace(regexp_replace(regexp_extract(f.path, '([^/]*)$', 1), '\\.[^./]+$', ''), '[^A-Za-z0-9_]', '', 'g') AS stem
        FROM seeds s JOIN files f ON f.id = s.file_id)
    SELECT s.failure_id, w.id AS file_id, min(s.seed_ord) AS seed_ord FROM words w JOIN stems s USING (stem) WHERE w.id <> s.file_id GROUP BY ALL""")
def g09(g):
    return scope.importers(g, _trace_seeds(g))


@query("g21_file_anchor", """
    WITH first AS (SELECT f.path, s.name, row_number() OVER (PARTITION BY f.path ORDER BY s.start_line, s.id) AS rn
        FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.kind IN ('function', 'class', 'const'))
    SELECT path AS failure_id, name, path, 0 AS tier FROM first WHERE rn = 1""")
def g21(g):
    from tracegraph.operators.causal import pick_anchor

    rows = g.files.select(F.col("path").alias("failure_id"), "path")
    return pick_anchor(g, rows, rows.limit(0))
