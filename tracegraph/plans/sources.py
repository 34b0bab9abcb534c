"""Sources, sinks and change streams in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.functions import parsing, paths
from tracegraph.functions import text as tx
from tracegraph.operators import history, review, scope, traverse
from tracegraph.operators.enrich import enrich
from tracegraph.operators.graph import symbols_with_path
from tracegraph.plans.graphs import callees_sql, callers_sql
from tracegraph.plans.lookups import NAME, RECENT_SQL
from tracegraph.plans.registry import query, sql_list
from tracegraph.sources import store
from tracegraph.sources.files import scan_listing
from tracegraph.streaming.changes import debounce, latest_actions


def _listing(g):
    """The indexed files plus build output that a scan must skip."""
    built = g.files.select(F.concat(F.lit("dist/"), "path").alias("path"))
    return g.files.select("path").unionByName(built)


@query("s01_repo_scan", """
    SELECT path FROM files WHERE starts_with(path, 'pkg1/') OR starts_with(path, 'pkg7/') ORDER BY path LIMIT 60""")
def s01(g):
    return scan_listing(_listing(g), scope=["pkg1", "pkg7"], max_files=60).select("path")


@query("s02_language_detect", """
    SELECT id, CASE WHEN regexp_matches(path, '\\.(ts|tsx)$') THEN 'typescript' WHEN ends_with(path, '.py') THEN 'python' ELSE 'unparsed' END AS language FROM files""")
def s02(g):
    return g.files.select("id", paths.language_of(F.col("path")).alias("language"))


@query("s03_ignore_rules", """
    SELECT path FROM files WHERE NOT ends_with(path, '.md') AND NOT starts_with(path, 'pkg3/tests/')""")
def s03(g):
    return scan_listing(_listing(g), gitignore=["*.md", "/pkg3/tests/"]).select("path")


@query("s04_bounded_scan", "SELECT path FROM files WHERE language <> 'unparsed' ORDER BY path LIMIT 800")
def s04(g):
    return scan_listing(_listing(g)).filter(F.col("language") != "unparsed").orderBy("path").limit(800).select("path")


MANIFESTS_SQL = "(SELECT 'ws/' || s_suppkey || '/package.json' AS path, '{\"name\": \"@ws/' || lower(replace(s_name, ' ', '-')) || '\"}' AS content FROM supplier)"


@query("s05_workspace_packages", """
    SELECT '@ws/' || lower(replace(replace(s_name, ' ', '-'), '#', '-')) AS package, min('ws/' || s_suppkey) AS root FROM supplier GROUP BY 1""")
def s05(g):
    from tracegraph.operators.resolve import workspace_packages

    name = F.lower(F.translate("s_name", " #", "--"))
    manifests = g.table("supplier").select(
        F.concat(F.lit("ws/"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("path"),
        F.concat(F.lit('{"name": "@ws/'), name, F.lit('"}')).alias("content"),
    )
    return workspace_packages(manifests)


@query("s06_python_package_roots", """
    SELECT 'pkg' || (id % 20) AS package, min('lib/pkg' || (id % 20)) AS root FROM files GROUP BY 1""")
def s06(g):
    from tracegraph.operators.resolve import package_roots

    top = F.concat(F.lit("lib/"), F.substring_index("path", "/", 1))
    inits = g.files.select(F.concat(top, F.lit("/__init__.py")).alias("path")).unionByName(
        g.files.select(F.concat(top, F.lit("/inner/__init__.py")).alias("path"))
    )
    return package_roots(inits)


@query("s14_git_blob_hash", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS sha FROM documents")
def s14(g):
    return g.table("documents").select("doc_id", parsing.git_blob_sha(F.col("text")).alias("sha"))


@query("s15_hash_fallback", "SELECT doc_id, 's:' || sha256(text) AS sha FROM documents")
def s15(g):
    return g.table("documents").select("doc_id", parsing.content_sha(F.col("text")).alias("sha"))


@query("s16_git_blame", """
    SELECT id, 1 AS line, lpad(CAST(id AS STRING), 40, 'a') AS commit, 'dev' || o_custkey AS author, o_orderpriority AS subject FROM blames JOIN orders ON o_orderkey = id
    UNION ALL SELECT id, 2, lpad(CAST(o_custkey AS STRING), 40, 'b'), 'other', o_orderstatus FROM blames JOIN orders ON o_orderkey = id
    UNION ALL SELECT id, 3, lpad(CAST(id AS STRING), 40, 'a'), 'dev' || o_custkey, o_orderpriority FROM blames JOIN orders ON o_orderkey = id""")
def s16(g):
    return history.blame_lines(g.blames).select("id", "line", "commit", "author", "subject")


SHOW_SQL = """
    stat AS (SELECT commit_id, string_split(unnest(string_split(numstat, chr(10))), chr(9)) AS p FROM shows),
    stats AS (SELECT commit_id, p[3] AS path, max((coalesce(TRY_CAST(p[1] AS INTEGER), 0), coalesce(TRY_CAST(p[2] AS INTEGER), 0))) AS s
        FROM stat WHERE len(p) >= 3 GROUP BY ALL),
    blocks AS (SELECT commit_id, unnest(string_split(diff, 'diff --git ')[2:]) AS b FROM shows),
    patched AS (SELECT commit_id, regexp_extract(string_split(b, chr(10))[1], '^a/(.+) b/(.+)$', 2) AS path,
        max('diff --git ' || b || CASE WHEN ends_with(b, chr(10)) THEN '' ELSE chr(10) END) AS patch FROM blocks GROUP BY ALL)"""


@query("s17_commit_diff", f"""
    WITH {SHOW_SQL}
    SELECT coalesce(s.commit_id, p.commit_id) AS commit_id, coalesce(s.path, p.path) AS path, coalesce(s.s[1], 0) AS additions, coalesce(s.s[2], 0) AS deletions,
           coalesce(p.patch, '') AS patch FROM stats s FULL JOIN patched p ON p.commit_id = s.commit_id AND p.path = s.path""")
def s17(g):
    return history.commit_diff(g.shows)


@query("u03_diff_file_union", f"WITH {SHOW_SQL} SELECT commit_id, path FROM stats UNION SELECT commit_id, path FROM patched")
def u03(g):
    return history.commit_diff(g.shows).select("commit_id", "path")


@query("s18_diff_hunks", """
    WITH h AS (SELECT pr_id, path, unnest(regexp_extract_all(patch, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1)) AS a,
        unnest(regexp_extract_all(patch, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2)) AS b FROM patches)
    SELECT pr_id, path, CAST(a AS INTEGER) AS start_line, CAST(a AS INTEGER) + coalesce(CAST(nullif(b, '') AS INTEGER), 1) - 1 AS end_line
    FROM h WHERE coalesce(CAST(nullif(b, '') AS INTEGER), 1) > 0""")
def s18(g):
    return g.patches.select("pr_id", "path", F.explode(parsing.hunks(F.col("patch"))).alias("h")).select("pr_id", "path", "h.*")


@query("s19_changed_file_list", "SELECT pr_id, status, count(*) AS n FROM patches GROUP BY ALL")
def s19(g):
    return g.patches.groupBy("pr_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s20_sentry_payload", """
    SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'w' || event_id ELSE CAST(event_id AS VARCHAR) END AS issue_id,
        CASE WHEN event_id % 5 = 0 THEN event_type ELSE event_type || ' failure' END AS title,
        CASE WHEN event_id % 5 = 0 THEN event_type ELSE event_type || ': v' || user_id || chr(10) || '  at inner (m' || user_id || ')' || chr(10)
             || '  at outer (' || path || ':' || (event_id % 90) || ')' END AS failure_text
    FROM events JOIN files ON files.id = user_id""")
def s20(g):
    incident = parsing.sentry_incident(F.col("payload"))
    return g.payloads.select("id", incident.alias("i")).select("id", "i.*")


@query("s21_corpus_read", "SELECT event_id, user_id FROM events WHERE event_id % 7 <> 0")
def s21(g):
    """JSON lines with blank and corrupt rows; those are dropped."""
    line = F.when(F.col("event_id") % 14 == 0, F.lit("")).when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct("event_id", "user_id"))
    )
    return store.parse_json_lines(g.table("events").select(line.alias("value")), "event_id long, user_id long")


@query("s23_source_slice", """
    SELECT s.id, array_to_string(lines[lo:least(lo + 29, hi)], chr(10)) AS body, lo AS start_line, least(lo + 29, hi) AS end_line, hi - lo + 1 > 30 AS truncated FROM (
        SELECT s.id, lines, CAST(greatest(1, least(start_line, len(lines))) AS INTEGER) AS lo,
               CAST(greatest(greatest(1, least(start_line, len(lines))), least(end_line, len(lines))) AS INTEGER) AS hi
        FROM symbols s JOIN (SELECT id, string_split(content, chr(10)) AS lines FROM file_text) f ON f.id = s.file_id) s""")
def s23(g):
    text = g.file_text.select(F.col("id").alias("file_id"), "content")
    piece = tx.source_slice(F.col("content"), F.col("start_line"), F.col("end_line"), 30)
    return g.symbols.join(text, "file_id").select("id", piece.alias("p")).select("id", "p.*")


@query("s24_path_sandbox", """
    SELECT id, NOT (id % 3 = 0 OR id % 5 = 0) AS safe FROM files""")
def s24(g):
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("../"), "path")).when(F.col("id") % 5 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    return g.files.select("id", paths.is_safe_relative(path).alias("safe"))


@query("s25_session_discovery", """
    SELECT 'stores/' || path || '.sqlite' AS path FROM files ORDER BY 1 LIMIT 200""")
def s25(g):
    from tracegraph.operators.lookup import session_discovery

    stores = g.files.select(F.concat(F.lit("stores/"), "path", F.lit(".sqlite")).alias("path"))
    hidden = g.files.select(F.concat(F.lit(".cache/"), "path", F.lit(".sqlite")).alias("path"))
    return session_discovery(stores.unionByName(hidden))


# ---- sinks ---------------------------------------------------------------------------

@query("k03_file_upsert", """
    SELECT id, 'new_' || name AS name, file_id FROM symbols WHERE file_id % 10 = 0
    UNION ALL SELECT id, name, file_id FROM symbols WHERE file_id % 10 <> 0""")
def k03(g):
    changed = g.symbols.filter(F.col("file_id") % 10 == 0).withColumn("name", F.concat(F.lit("new_"), "name"))
    touched = changed.select("file_id").distinct()
    return store.replace_files(g.symbols, touched, changed).select("id", "name", "file_id")


@query("k04_file_delete", "SELECT id, file_id FROM symbols WHERE file_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def k04(g):
    gone = g.changes.filter(F.col("action") == "delete").select("path").distinct()
    ids = g.files.join(gone, "path", "left_semi").select(F.col("id").alias("file_id"))
    return store.replace_files(g.symbols, ids, None).select("id", "file_id")


@query("k04_dangling_targets", """
    WITH gone AS (SELECT id FROM symbols WHERE file_id IN (SELECT user_id FROM events WHERE event_type = 'error'))
    SELECT id, from_symbol_id, CASE WHEN to_symbol_id IN (SELECT id FROM gone) THEN -1 ELSE coalesce(to_symbol_id, -1) END AS to_symbol_id
    FROM edges WHERE from_symbol_id NOT IN (SELECT id FROM gone)""")
def k04_edges(g):
    gone = g.changes.filter(F.col("action") == "delete").select("path").distinct()
    ids = g.files.join(gone, "path", "left_semi").select(F.col("id").alias("file_id"))
    removed = g.symbols.join(ids, "file_id", "left_semi").select("id")
    out = store.drop_symbols(g.edges, removed)
    return out.select("id", "from_symbol_id", F.coalesce("to_symbol_id", F.lit(-1)).alias("to_symbol_id"))


CACHE_SQL = "cache AS (SELECT path, CASE WHEN id % 4 = 0 THEN 'stale' ELSE 's:' || sha256(content) END AS sha FROM file_text WHERE id % 3 <> 0)"


def _cache(g):
    sha = F.when(F.col("id") % 4 == 0, F.lit("stale")).otherwise(parsing.content_sha(F.col("content")))
    cache = g.file_text.filter(F.col("id") % 3 != 0).select("path", sha.alias("sha"))
    current = g.file_text.select("path", parsing.content_sha(F.col("content")).alias("sha"))
    return current, cache


@query("k05_blob_cache_misses", f"""
    WITH {CACHE_SQL}
    SELECT t.path FROM file_text t WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.path = t.path AND c.sha = 's:' || sha256(t.content))""")
def k05(g):
    current, cache = _cache(g)
    return store.cache_split(current, cache)["misses"].select("path")


@query("j23_blob_cache_hits", f"""
    WITH {CACHE_SQL} SELECT t.path FROM file_text t JOIN cache c ON c.path = t.path AND c.sha = 's:' || sha256(t.content)""")
def j23(g):
    current, cache = _cache(g)
    return store.cache_split(current, cache)["hits"].select("path")


@query("k08_comment_upsert", """
    WITH existing AS (SELECT conv_id AS target, role AS marker, min(conv_id * 1000 + turn) AS comment_id FROM conversations GROUP BY ALL),
    wanted AS (SELECT DISTINCT conv_id AS target, m AS marker FROM conversations, (VALUES ('user'), ('bot')) v(m))
    SELECT w.target, w.marker, coalesce(e.comment_id, -1) AS comment_id, CASE WHEN e.comment_id IS NULL THEN 'create' ELSE 'update' END AS action
    FROM wanted w LEFT JOIN existing e USING (target, marker)""")
def k08(g):
    rows = g.table("conversations")
    existing = rows.select(F.col("conv_id").alias("target"), (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.col("role").alias("marker"))
    wanted = rows.select(F.col("conv_id").alias("target"), F.explode(F.array(F.lit("user"), F.lit("bot"))).alias("marker")).distinct()
    out = review.upsert_by_marker(existing, wanted.withColumn("body", F.lit("text")))
    return out.select("target", "marker", F.coalesce("comment_id", F.lit(-1)).alias("comment_id"), "action")


# ---- change stream, batch form ---------------------------------------------------------

SESSIONS_SQL = """
    marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM changes),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY repo ORDER BY ts, event_id) AS session_no FROM marked)"""


@query("t02_debounce", f"""
    WITH {SESSIONS_SQL},
    bounds AS (SELECT repo, session_no, min(ts) AS session_start FROM numbered GROUP BY ALL)
    SELECT n.repo, b.session_start, n.path, count(*) AS n_events FROM numbered n JOIN bounds b USING (repo, session_no) GROUP BY ALL""")
def t02(g):
    """Bursts of changes per repository, split where nothing happens for ten minutes."""
    return debounce(g.changes, "10 minutes").groupBy("repo", "session_start", "path").agg(F.count(F.lit(1)).alias("n_events"))


@query("t03_latest_action_per_file", f"""
    WITH {SESSIONS_SQL},
    bounds AS (SELECT repo, session_no, min(ts) AS session_start FROM numbered GROUP BY ALL)
    SELECT repo, b.session_start, path, arg_max(action, (ts, event_id)) AS action FROM numbered n JOIN bounds b USING (repo, session_no) GROUP BY ALL""")
def t03(g):
    return latest_actions(debounce(g.changes, "10 minutes")).select("repo", "session_start", "path", "action")


# ---- enrichment --------------------------------------------------------------------------

@query("p10_enrich", f"""
    WITH cands AS (SELECT s.id AS cand_id, f.path AS file, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.kind = 'class'),
    {RECENT_SQL},
    calls AS (SELECT * FROM edges WHERE kind = 'CALLS' AND to_symbol_id IS NOT NULL),
    seed_syms AS (SELECT DISTINCT c.cand_id, s.id FROM cands c JOIN symbols s ON s.name = c.name),
    up AS (SELECT q.cand_id, s.name, f.path AS file, e.confidence, row_number() OVER (PARTITION BY q.cand_id, f.path, s.name
        ORDER BY e.confidence DESC, e.call_line, s.id, q.id) AS rn FROM seed_syms q JOIN calls e ON e.to_symbol_id = q.id AND e.confidence >= 0.5
        JOIN symbols s ON s.id = e.from_symbol_id JOIN files f ON f.id = s.file_id),
    up3 AS (SELECT cand_id, string_agg(name, ',' ORDER BY r) AS callers FROM (
        SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY confidence DESC, name, file) AS r FROM up WHERE rn = 1) x WHERE r <= 3 GROUP BY cand_id),
    down AS (SELECT q.cand_id, e.to_name AS name, f.path AS file, max(e.confidence) AS confidence FROM seed_syms q JOIN calls e ON e.from_symbol_id = q.id
        JOIN symbols s ON s.id = e.to_symbol_id JOIN files f ON f.id = s.file_id GROUP BY ALL),
    down3 AS (SELECT cand_id, string_agg(name, ',' ORDER BY r) AS callees FROM (
        SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY confidence DESC, name, file) AS r FROM down) x WHERE r <= 3 GROUP BY cand_id),
    hits AS (SELECT DISTINCT c.cand_id, r.sha, r.date, r.commit_id FROM cands c JOIN symbols s ON s.id = c.cand_id
        JOIN recent r ON r.file_id = s.file_id AND s.start_line <= r.he AND s.end_line >= r.hs),
    last5 AS (SELECT cand_id, string_agg(sha, ',' ORDER BY r) AS commits FROM (
        SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY date DESC, commit_id DESC) AS r FROM hits) x WHERE r <= 5 GROUP BY cand_id)
    SELECT c.cand_id, c.name, coalesce(u.callers, '') AS callers, coalesce(d.callees, '') AS callees, coalesce(l.commits, '') AS commits
    FROM cands c LEFT JOIN up3 u USING (cand_id) LEFT JOIN down3 d USING (cand_id) LEFT JOIN last5 l USING (cand_id)""")
def p10(g):
    cands = symbols_with_path(g).filter(F.col("kind") == "class").select(
        F.col("id").alias("cand_id"), F.col("path").alias("file"), "name", F.lit(None).cast("int").alias("line")
    )
    out = enrich(g, cands)
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select("cand_id", "name", joined("callers"), joined("callees"), joined("commits"))
