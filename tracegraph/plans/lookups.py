"""Filters, point queries, rollups, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.functions import paths, signals
from tracegraph.functions.fixed import MATCHABLE_KINDS
from tracegraph.functions.runtime_names import is_runtime_name, runtime_names
from tracegraph.operators import history, impact, lookup, resolve, review
from tracegraph.operators.graph import symbols_with_path
from tracegraph.operators.shared import first_per_key, overlap_join, top_k
from tracegraph.plans.registry import query, sql_list

NAME = "tiny_widget_5"
PATH = "pkg5/mod_5.tsx"
RUNTIME = sql_list(runtime_names())
TEST_SQL = (
    "(regexp_matches(path, '(?i)(^|/)(tests?|__tests__)/') OR "
    "regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)([._-]test|[._-]spec|test_)'))"
)


@query("p01_definition_of", f"""
    SELECT s.name, s.kind, f.path AS file, s.start_line, s.end_line, s.signature, s.exported, f.language, f.subsystem
    FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = '{NAME}'""")
def p01(g):
    return lookup.definition_of(g, NAME)


@query("p01_definition_of_filtered", f"""
    SELECT s.name, s.kind, f.path AS file, s.start_line, s.end_line, s.signature, s.exported, f.language, f.subsystem
    FROM symbols s JOIN files f ON f.id = s.file_id
    WHERE s.name = '{NAME}' AND f.language = 'typescript' AND f.subsystem = 'src5'""")
def p01_filtered(g):
    return lookup.definition_of(g, NAME, language="typescript", subsystem="src5")


@query("p02_symbols_in_file", f"""
    SELECT name, kind, start_line, end_line, signature, exported FROM symbols
    WHERE file_id IN (SELECT id FROM files WHERE path = '{PATH}')""")
def p02(g):
    return lookup.symbols_in_file(g, PATH)


@query("p03_matchable_kinds", f"""
    SELECT kind, count(*) AS n FROM symbols WHERE kind IN ({sql_list(MATCHABLE_KINDS)}) GROUP BY kind""")
def p03(g):
    return g.symbols.filter(F.col("kind").isin(MATCHABLE_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("p04_runtime_name_filter", f"""
    SELECT to_name, count(*) AS n FROM edges WHERE to_symbol_id IS NULL AND to_name NOT IN ({RUNTIME}) GROUP BY to_name""")
def p04(g):
    open_ = g.edges.filter(F.col("to_symbol_id").isNull() & ~is_runtime_name("to_name"))
    return open_.groupBy("to_name").agg(F.count(F.lit(1)).alias("n"))


@query("p05_test_path", f"SELECT id, path, {TEST_SQL} AS is_test FROM files")
def p05(g):
    return g.files.select("id", "path", paths.is_test_path(F.col("path")).alias("is_test"))


@query("p06_confidence_filter", """
    SELECT from_symbol_id, count(*) AS n, min(confidence) AS lowest FROM edges
    WHERE kind = 'CALLS' AND confidence >= 0.5 GROUP BY from_symbol_id""")
def p06(g):
    return (
        g.edges.filter((F.col("kind") == "CALLS") & (F.col("confidence") >= 0.5))
        .groupBy("from_symbol_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lowest"))
    )


TOP_SYMBOLS = "(SELECT * FROM symbols ORDER BY exported DESC, end_line - start_line DESC, id LIMIT 800)"


@query("p07_graph_export_symbols", f"""
    SELECT t.id, t.name, t.kind, t.file_id, t.start_line, t.end_line, coalesce(t.signature, '') AS signature, t.exported,
           coalesce(p.name, '') AS parent_name
    FROM {TOP_SYMBOLS} t LEFT JOIN symbols p ON p.id = t.parent_id""")
def p07_symbols(g):
    return lookup.graph_export(g)["symbols"].withColumns(
        {"signature": F.coalesce("signature", F.lit("")), "parent_name": F.coalesce("parent_name", F.lit(""))}
    )


@query("p07_graph_export_edges", f"""
    WITH chosen AS {TOP_SYMBOLS}
    SELECT e.id, e.from_symbol_id, coalesce(c.id, -1) AS to_symbol_id, e.to_name, e.kind, e.confidence, e.call_line
    FROM edges e LEFT JOIN chosen c ON c.id = e.to_symbol_id WHERE e.from_symbol_id IN (SELECT id FROM chosen)""")
def p07_edges(g):
    return lookup.graph_export(g)["edges"].withColumn("to_symbol_id", F.coalesce("to_symbol_id", F.lit(-1)))


@query("p07_graph_export_files", f"""
    SELECT id, path, language, subsystem, loc FROM files
    WHERE language <> 'unparsed' AND id IN (SELECT file_id FROM {TOP_SYMBOLS} t)""")
def p07_files(g):
    return lookup.graph_export(g)["files"].select("id", "path", "language", "subsystem", "loc")


@query("p07_graph_export_summary", "SELECT count(*) AS total_symbols, count(*) > 800 AS truncated FROM symbols")
def p07_summary(g):
    return lookup.graph_export(g)["summary"]


@query("p08_max_symbols_clamp", """
    SELECT DISTINCT CAST(l_quantity AS INTEGER) * 150 AS wanted,
           greatest(50, least(5000, CAST(l_quantity AS INTEGER) * 150)) AS clamped FROM lineitem""")
def p08(g):
    wanted = g.table("lineitem").select((F.col("l_quantity").cast("int") * 150).alias("wanted"))
    return wanted.select("wanted", signals.clamp_max_symbols(F.col("wanted")).alias("clamped")).distinct()


HUNKS_SQL = """
    hunked AS (
        SELECT pr_id, path, unnest(regexp_extract_all(patch, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1)) AS a,
               unnest(regexp_extract_all(patch, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2)) AS b
        FROM live),
    hunk_ranges AS (
        SELECT pr_id, path, CAST(a AS INTEGER) AS hs, CAST(a AS INTEGER) + coalesce(CAST(nullif(b, '') AS INTEGER), 1) - 1 AS he
        FROM hunked WHERE coalesce(CAST(nullif(b, '') AS INTEGER), 1) > 0)"""


@query("p09_changed_symbols", f"""
    WITH live AS (SELECT * FROM patches WHERE status <> 'removed' AND NOT path LIKE '%.md'), {HUNKS_SQL},
    reviewed AS (SELECT s.*, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE kind IN ('function', 'method', 'class'))
    SELECT DISTINCT h.pr_id, h.path, s.name, s.kind, s.start_line, s.end_line, s.id AS symbol_id
    FROM hunk_ranges h JOIN reviewed s ON s.path = h.path AND s.start_line <= h.he AND s.end_line >= h.hs
    UNION
    SELECT DISTINCT l.pr_id, l.path, s.name, s.kind, s.start_line, s.end_line, s.id
    FROM live l JOIN reviewed s ON s.path = l.path WHERE l.patch = ''""")
def p09(g):
    return review.changed_symbols(g, g.patches)


@query("p11_session_summary", """
    SELECT 'files' AS metric, count(*) AS value FROM files
    UNION ALL SELECT 'unparsed_files', count(*) FILTER (language = 'unparsed') FROM files
    UNION ALL SELECT 'symbols', count(*) FROM symbols
    UNION ALL SELECT 'edges', count(*) FROM edges
    UNION ALL SELECT 'imports', count(*) FROM imports""")
def p11(g):
    return lookup.session_summary(g)


@query("p12_symbol_search", """
    SELECT id, name, kind FROM symbols WHERE lower(name) LIKE '%valve%' ORDER BY id LIMIT 12""")
def p12(g):
    return lookup.search_symbols(g, "Valve")


# ---- joins ----------------------------------------------------------------

@query("j01_symbols_with_files", """
    SELECT f.language, f.subsystem, s.kind, count(*) AS n FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY ALL""")
def j01(g):
    return symbols_with_path(g).groupBy("language", "subsystem", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("j02_reverse_adjacency", """
    SELECT e.to_symbol_id AS id, f.path, count(*) AS n_callers, max(e.confidence) AS best
    FROM edges e JOIN symbols s ON s.id = e.from_symbol_id JOIN files f ON f.id = s.file_id
    WHERE e.to_symbol_id IS NOT NULL AND e.kind = 'CALLS' AND e.confidence >= 0.5 GROUP BY ALL""")
def j02(g):
    caller = symbols_with_path(g).select(F.col("id").alias("from_symbol_id"), "path")
    calls = g.edges.filter(F.col("to_symbol_id").isNotNull() & (F.col("kind") == "CALLS") & (F.col("confidence") >= 0.5))
    # Combine per caller first: the join with paths then carries one row per pair.
    pairs = calls.groupBy("to_symbol_id", "from_symbol_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    return pairs.join(caller, "from_symbol_id").groupBy(F.col("to_symbol_id").alias("id"), "path").agg(
        F.sum("n").alias("n_callers"), F.max("c").alias("best")
    )


@query("j03_callees_left_outer", """
    SELECT e.from_symbol_id, coalesce(f.path, '?') AS to_path, count(*) AS n
    FROM edges e LEFT JOIN symbols s ON s.id = e.to_symbol_id LEFT JOIN files f ON f.id = s.file_id
    WHERE e.kind = 'CALLS' GROUP BY ALL""")
def j03(g):
    callee = symbols_with_path(g).select(F.col("id").alias("to_symbol_id"), "path")
    pairs = g.edges.filter(F.col("kind") == "CALLS").groupBy("from_symbol_id", "to_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(callee, "to_symbol_id", "left").groupBy("from_symbol_id", F.coalesce("path", F.lit("?")).alias("to_path")).agg(
        F.sum("n").alias("n")
    )


@query("j05_symbol_parents", """
    SELECT s.id, s.name, coalesce(p.name, '') AS parent_name FROM symbols s LEFT JOIN symbols p ON p.id = s.parent_id""")
def j05(g):
    parent = g.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return g.symbols.select("id", "name", "parent_id").join(parent, "parent_id", "left").select(
        "id", "name", F.coalesce("parent_name", F.lit("")).alias("parent_name")
    )


@query("j08_enclosing_symbol", """
    SELECT file_id, line, arg_min(id, (end_line - start_line) * CAST(100000000 AS BIGINT) + id) AS owner FROM (
        SELECT DISTINCT c.file_id, c.start_line AS line, s.id, s.start_line, s.end_line
        FROM commit_lines c JOIN symbols s ON s.file_id = c.file_id AND s.start_line <= c.start_line AND c.start_line <= s.end_line
        WHERE s.kind IN ('function', 'method', 'const', 'class')) x GROUP BY ALL""")
def j08(g):
    """The tightest function, method, const or class around a changed line."""
    spots = g.commit_lines.select("file_id", F.col("start_line").alias("line")).distinct().withColumn("line_end", F.col("line"))
    owners = g.symbols.filter(F.col("kind").isin("function", "method", "const", "class")).select("id", "file_id", "start_line", "end_line")
    inside = overlap_join(spots, owners, ["file_id"], ("line", "line_end"), ("start_line", "end_line"))
    span = (F.col("end_line") - F.col("start_line")).alias("span")
    return first_per_key(inside.select("file_id", "line", "id", span), ["file_id", "line"], ["span", "id"]).select(
        "file_id", "line", F.col("id").alias("owner")
    )


@query("j13_commit_self_join", """
    SELECT a.file_id, count(*) AS n_commits, CAST(sum(b.n - 1) AS BIGINT) AS n_neighbours
    FROM (SELECT DISTINCT commit_id, file_id FROM commit_lines) a
    JOIN (SELECT commit_id, count(DISTINCT file_id) AS n FROM commit_lines GROUP BY 1) b USING (commit_id) GROUP BY a.file_id""")
def j13(g):
    """Commits per file and how many other files they touched, without pairing the files of a commit."""
    touched = g.commit_lines.select("commit_id", "file_id").distinct()
    sizes = touched.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return touched.join(sizes, "commit_id").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_commits"), F.sum(F.col("n") - 1).alias("n_neighbours")
    )


@query("j14_symbol_hunk_overlap", """
    SELECT s.id, count(*) AS n_hunks, count(DISTINCT c.commit_id) AS n_commits
    FROM symbols s JOIN commit_lines c ON c.file_id = s.file_id AND s.start_line <= c.end_line AND s.end_line >= c.start_line
    GROUP BY s.id""")
def j14(g):
    """Hunks and commits per symbol. A commit counts at the first of its hunks that meets the symbol, so pairs of symbol and commit are not grouped."""
    return history.hunk_counts(g.symbols.select("id", "file_id", "start_line", "end_line"), g.commit_lines)


@query("j15_longest_package_prefix", """
    WITH roots AS (SELECT 'pkg' || i AS root FROM range(0, 20) t(i) UNION ALL SELECT 'pkg' || i || '/tests' FROM range(0, 20) t(i))
    SELECT f.id, max_by(r.root, length(r.root)) AS root FROM files f
    JOIN roots r ON starts_with(f.path, r.root || '/') GROUP BY f.id""")
def j15(g):
    """Every file's deepest package root, by joining its leading directories."""
    roots = lookup.folders(g).select(F.col("folder").alias("root"))
    dirs = g.files.select("id", F.explode(paths.prefixes(F.col("path"))).alias("root"))
    return first_per_key(dirs.join(roots, "root").withColumn("r", F.col("root")), ["id"], [-F.length("r")]).select("id", "root")


@query("j21_edges_of_selection", """
    SELECT kind, count(*) AS n FROM edges WHERE from_symbol_id IN (SELECT id FROM symbols WHERE exported) GROUP BY kind""")
def j21(g):
    return lookup.edges_within(g.edges, g.symbols.filter("exported")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("j22_never_called", """
    SELECT s.id, s.name FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_symbol_id = s.id AND e.kind = 'CALLS')""")
def j22(g):
    called = g.edges.filter((F.col("kind") == "CALLS") & F.col("to_symbol_id").isNotNull()).select(F.col("to_symbol_id").alias("id"))
    return g.symbols.select("id", "name").join(called, "id", "left_anti")


# ---- aggregates -----------------------------------------------------------

@query("a01_table_counts", """
    SELECT count(*) AS files, count(*) FILTER (language = 'unparsed') AS unparsed, (SELECT count(*) FROM symbols) AS symbols,
           (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM imports) AS imports FROM files""")
def a01(g):
    one = lambda df: df.select(F.count(F.lit(1))).scalar()
    return g.files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("language") == "unparsed").alias("unparsed")).select(
        "files", "unparsed", one(g.symbols).alias("symbols"), one(g.edges).alias("edges"), one(g.imports).alias("imports")
    )


@query("a02_distinct_unresolved", f"""
    SELECT s.name, f.path AS file, count(DISTINCT e.to_name) AS n_unresolved
    FROM edges e JOIN symbols s ON s.id = e.from_symbol_id JOIN files f ON f.id = s.file_id
    WHERE e.kind = 'CALLS' AND e.to_symbol_id IS NULL AND e.to_name NOT IN ({RUNTIME}) GROUP BY ALL""")
def a02(g):
    nodes = symbols_with_path(g).select(F.col("path").alias("file"), "name")
    return impact.unresolved_counts(g, nodes)


@query("a03_unresolved_targets", f"""
    SELECT DISTINCT f.path AS file, s.name, e.to_name AS target
    FROM edges e JOIN symbols s ON s.id = e.from_symbol_id JOIN files f ON f.id = s.file_id
    WHERE e.kind = 'CALLS' AND e.to_symbol_id IS NULL AND e.to_name NOT IN ({RUNTIME}) AND s.kind = 'class'""")
def a03(g):
    located = symbols_with_path(g).filter(F.col("kind") == "class").select(F.col("id").alias("from_symbol_id"), F.col("path").alias("file"), "name")
    open_ = g.edges.filter((F.col("kind") == "CALLS") & F.col("to_symbol_id").isNull() & ~is_runtime_name("to_name"))
    return open_.select("from_symbol_id", F.col("to_name").alias("target")).distinct().join(located, "from_symbol_id").select(
        "file", "name", "target"
    ).distinct()


COCHANGE_SQL = """
    touched AS (SELECT DISTINCT l.commit_id, l.file_id, c.date FROM commit_lines l JOIN commits c ON c.commit_id = l.commit_id
                WHERE NOT c.is_merge AND c.date >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY),
    mine AS (SELECT commit_id FROM touched WHERE file_id = 5 ORDER BY date DESC, commit_id DESC LIMIT 200)"""


@query("a05_file_cochange", f"""
    WITH {COCHANGE_SQL}
    SELECT 'f5' AS seed_id, file_id, count(*) AS n FROM touched WHERE commit_id IN (SELECT commit_id FROM mine) AND file_id <> 5
    GROUP BY file_id HAVING count(*) >= 2 ORDER BY n DESC, file_id LIMIT 8""")
def a05(g):
    seeds = g.files.filter(F.col("path") == PATH).select(F.lit("f5").alias("seed_id"), F.col("id").alias("file_id"))
    return history.cochanged_files(g, seeds).select("seed_id", "file_id", "n")


@query("a16_degree_per_file", """
    WITH ends AS (SELECT from_symbol_id AS id FROM edges UNION ALL SELECT to_symbol_id FROM edges WHERE to_symbol_id IS NOT NULL),
    deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
    SELECT s.file_id, CAST(sum(degree) AS BIGINT) AS degree FROM deg JOIN symbols s USING (id) GROUP BY s.file_id
    ORDER BY degree DESC, file_id LIMIT 30""")
def a16(g):
    return lookup.file_degrees(g)


@query("a16_degree_per_symbol", """
    SELECT id, count(*) AS degree FROM (
        SELECT from_symbol_id AS id FROM edges UNION ALL SELECT to_symbol_id FROM edges WHERE to_symbol_id IS NOT NULL) e GROUP BY id""")
def a16_symbol(g):
    return lookup.degrees(g)


@query("a17_file_clusters", """
    SELECT file_id, count(*) AS size, round(avg(p_size), 6) AS cx, round(avg(p_retailprice), 6) AS cy
    FROM symbols JOIN part ON p_partkey = id WHERE kind NOT IN ('param', 'local') GROUP BY file_id HAVING count(*) >= 2
    ORDER BY size DESC, file_id LIMIT 24""")
def a17(g):
    positions = g.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return lookup.file_clusters(g, positions).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("a18_phantom_nodes", "SELECT DISTINCT to_name AS name FROM edges WHERE to_symbol_id IS NULL")
def a18(g):
    return lookup.phantom_nodes(g)


@query("a20_hunk_symbol_counts", """
    WITH ctx AS (SELECT pr_id AS id, trim(unnest(regexp_extract_all(patch, '(?m)^@@ .+? @@[ \\t]*(.*)$', 1))) AS c FROM patches),
    named AS (SELECT id, coalesce(nullif(regexp_extract(c, '\\b(?:async\\s+def|def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''),
                         nullif(regexp_extract(c, '\\bfunction\\s+([A-Za-z_$][\\w$]*)', 1), '')) AS symbol FROM ctx WHERE c <> '')
    SELECT id, symbol, count(*) AS n FROM named WHERE symbol IS NOT NULL GROUP BY ALL""")
def a20(g):
    return review.symbol_counts(g.patches.select(F.col("pr_id").alias("id"), F.col("patch").alias("diff")))


# ---- windows, orderings, set operations -----------------------------------

@query("w02_top_symbols_per_file", """
    WITH deg AS (SELECT id, count(*) AS degree FROM (
        SELECT from_symbol_id AS id FROM edges UNION ALL SELECT to_symbol_id FROM edges WHERE to_symbol_id IS NOT NULL) e GROUP BY id)
    SELECT id, file_id, degree FROM (
        SELECT s.id, s.file_id, degree, row_number() OVER (PARTITION BY s.file_id ORDER BY degree DESC, s.id) AS rn
        FROM symbols s JOIN deg USING (id)) x WHERE rn <= 5""")
def w02(g):
    nodes = g.symbols.select("id", "file_id").join(lookup.degrees(g), "id")
    return top_k(nodes, ["file_id"], [F.desc("degree"), F.asc("id")], 5)


@query("w03_smallest_range", """
    SELECT l.id AS local_id, arg_min(o.id, (o.end_line - o.start_line) * CAST(100000000 AS BIGINT) + o.id) AS owner_id
    FROM symbols l JOIN symbols o ON o.file_id = l.file_id AND o.start_line <= l.start_line AND l.start_line <= o.end_line
    WHERE l.kind = 'local' AND o.kind IN ('function', 'method', 'const') GROUP BY l.id""")
def w03(g):
    locals_ = g.symbols.filter((F.col("kind") == "local") & F.col("parent_id").isNull()).select("id")
    return resolve.backfill_local_parents(g.symbols).join(locals_, "id", "left_semi").filter(F.col("parent_id").isNotNull()).select(
        F.col("id").alias("local_id"), F.col("parent_id").alias("owner_id")
    )


FIRST_DEF_SQL = """
    SELECT name, path, start_line, end_line, kind FROM (
        SELECT s.name, f.path, s.start_line, s.end_line, s.kind,
               row_number() OVER (PARTITION BY s.name ORDER BY s.exported DESC, f.path, s.start_line, s.id) AS rn
        FROM symbols s JOIN files f ON f.id = s.file_id) x WHERE rn = 1"""


@query("w04_first_definition", FIRST_DEF_SQL)
def w04(g):
    return lookup.first_definitions(g, g.symbols).select("name", "path", "start_line", "end_line", "kind")


RECENT_SQL = """
    recent AS (
        SELECT l.commit_id, l.file_id, l.start_line AS hs, l.end_line AS he, c.sha, c.author, c.date, c.subject,
               CAST(floor(epoch((SELECT max(o_orderdate) FROM orders) - c.date) / 86400 + 0.5) AS INTEGER) AS days_ago
        FROM commit_lines l JOIN commits c ON c.commit_id = l.commit_id
        WHERE c.date >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY)"""

NEWEST_SQL = f"""
    WITH {RECENT_SQL},
    hit AS (SELECT DISTINCT s.id, r.commit_id, r.sha, r.date, r.days_ago FROM symbols s
            JOIN recent r ON r.file_id = s.file_id AND s.start_line <= r.he AND s.end_line >= r.hs)
    SELECT id AS range_id, sha, days_ago, change_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC, commit_id DESC) AS change_rank FROM hit) x WHERE change_rank <= 3"""


@query("w05_newest_commits_per_symbol", NEWEST_SQL)
def w05(g):
    ranges = g.symbols.select(F.col("id").alias("range_id"), "file_id", "start_line", "end_line")
    return history.newest_changes(g, ranges).select("range_id", "sha", "days_ago", "change_rank")


@query("w07_folder_tree", """
    WITH parts AS (SELECT DISTINCT string_split(path, '/') AS p FROM files)
    SELECT DISTINCT array_to_string(p[1:i], '/') AS folder, p[i] AS name, array_to_string(p[1:i-1], '/') AS parent
    FROM (SELECT p, unnest(range(1, len(p))) AS i FROM parts) x""")
def w07(g):
    return lookup.folders(g)


@query("g23_contains_edges", """
    WITH dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files),
    folders AS (SELECT d FROM dirs UNION SELECT regexp_extract(d, '^(.*)/[^/]*$', 1) FROM dirs WHERE contains(d, '/'))
    SELECT 'd:' || regexp_extract(d, '^(.*)/[^/]*$', 1) AS source, 'd:' || d AS target FROM folders WHERE contains(d, '/')
    UNION ALL SELECT 'd:' || regexp_extract(path, '^(.*)/[^/]*$', 1), 'f:' || id FROM files
    UNION ALL SELECT 'f:' || file_id, 's:' || id FROM symbols""")
def g23(g):
    return lookup.contains_edges(g)


@query("l01_definition_order", """
    SELECT s.name, f.path, s.id, row_number() OVER (PARTITION BY s.name ORDER BY s.exported DESC, f.path, s.start_line, s.id) AS ord
    FROM symbols s JOIN files f ON f.id = s.file_id QUALIFY ord <= 50""")
def l01(g):
    rows = symbols_with_path(g).select("name", "path", "id", "exported", "start_line")
    return top_k(rows, ["name"], [F.desc("exported"), F.asc("path"), F.asc("start_line"), F.asc("id")], 50, rank="ord").select(
        "name", "path", "id", "ord"
    )


@query("l11_label_candidates", """
    WITH deg AS (SELECT id, count(*) AS degree FROM (
        SELECT from_symbol_id AS id FROM edges UNION ALL SELECT to_symbol_id FROM edges WHERE to_symbol_id IS NOT NULL) e GROUP BY id),
    top_files AS (SELECT file_id FROM deg JOIN symbols USING (id) GROUP BY file_id ORDER BY sum(degree) DESC, file_id LIMIT 30),
    ranked AS (SELECT id, name, file_id, degree, row_number() OVER (PARTITION BY file_id ORDER BY degree DESC, id) AS rn
               FROM symbols JOIN deg USING (id) WHERE file_id IN (SELECT file_id FROM top_files))
    SELECT id, name, file_id, degree FROM ranked WHERE rn <= 5 ORDER BY (CASE WHEN id = 5 THEN 0 ELSE 1 END), degree DESC, id LIMIT 80""")
def l11(g):
    return lookup.label_candidates(g, anchor_id=5)


@query("u01_flow_union", """
    SELECT src, dst, min(is_arg) AS is_arg FROM (
        SELECT from_symbol_id AS src, to_symbol_id AS dst, 0 AS is_arg FROM edges WHERE kind = 'CALLS' AND to_symbol_id IS NOT NULL
        UNION ALL
        SELECT b.source_symbol_id, e.from_symbol_id, 1 FROM arg_bindings b JOIN edges e ON e.id = b.edge_id
        WHERE b.source_kind = 'identifier' AND b.source_symbol_id IS NOT NULL) x GROUP BY src, dst""")
def u01(g):
    from tracegraph.operators.traverse import flow_edges

    return flow_edges(g).select("src", "dst", "is_arg")


@query("j04_argument_flow", """
    SELECT DISTINCT b.source_symbol_id AS src, e.from_symbol_id AS dst FROM arg_bindings b JOIN edges e ON e.id = b.edge_id
    WHERE b.source_kind = 'identifier' AND b.source_symbol_id IS NOT NULL""")
def j04(g):
    from tracegraph.operators.traverse import arg_flow

    return arg_flow(g)


@query("u05_candidates_without_seeds", """
    SELECT DISTINCT f.path FROM files f JOIN imports i ON i.file_id = f.id
    EXCEPT SELECT path FROM files WHERE language = 'unparsed'""")
def u05(g):
    importing = g.files.join(g.imports.select(F.col("file_id").alias("id")), "id", "left_semi").select("path")
    return importing.distinct().join(
        g.files.filter(F.col("language") == "unparsed").select("path"), "path", "left_anti"
    )


@query("u06_changed_and_called", """
    SELECT DISTINCT s.name FROM symbols s JOIN commit_lines c ON c.file_id = s.file_id AND s.start_line <= c.end_line AND s.end_line >= c.start_line
    INTERSECT SELECT to_name FROM edges WHERE to_symbol_id IS NULL""")
def u06(g):
    hunks = g.commit_lines.select("file_id", F.col("start_line").alias("hs"), F.col("end_line").alias("he")).distinct()
    changed = overlap_join(
        g.symbols.select("name", "file_id", "start_line", "end_line"), hunks, ["file_id"], ("start_line", "end_line"), ("hs", "he")
    ).select("name").distinct()
    called = g.edges.filter(F.col("to_symbol_id").isNull()).select(F.col("to_name").alias("name"))
    return changed.join(called, "name", "left_semi")
