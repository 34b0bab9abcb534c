"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegraph.functions import parsing, paths, signals
from tracegraph.functions import text as tx
from tracegraph.operators import history, scope
from tracegraph.plans.graphs import UNRESOLVED_SQL
from tracegraph.plans.lookups import RECENT_SQL
from tracegraph.plans.registry import query, sql_list

AGE_SQL = "CAST(floor(epoch((SELECT max(o_orderdate) FROM orders) - date) / 86400 + 0.5) AS INTEGER)"


@query("f01_recency_bucket", f"""
    SELECT commit_id, CAST(CASE WHEN d > 90 THEN 0 WHEN d <= 7 THEN 3 WHEN d <= 30 THEN 2 ELSE 1 END AS DOUBLE) AS recency
    FROM (SELECT commit_id, {AGE_SQL} AS d FROM commits) x""")
def f01(g):
    return g.commits.select("commit_id", signals.recency_score(signals.days_between(g.as_of, F.col("date"))).alias("recency"))


@query("f02_proximity", """
    SELECT l_linenumber - 1 AS distance, CAST(CASE l_linenumber - 1 WHEN 0 THEN 2.5 WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS proximity, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def f02(g):
    d = (F.col("l_linenumber") - 1).alias("distance")
    return g.table("lineitem").groupBy(d).agg(F.count(F.lit(1)).alias("n")).withColumn("proximity", signals.proximity_score(F.col("distance")))


@query("f03_ambiguity", f"""
    WITH {UNRESOLVED_SQL}
    SELECT name, file, CAST(CASE WHEN n_unresolved = 1 THEN 0.5 WHEN n_unresolved <= 3 THEN 1 ELSE 1.5 END AS DOUBLE) AS ambiguity FROM unresolved""")
def f03(g):
    from tracegraph.operators.graph import symbols_with_path
    from tracegraph.operators.impact import unresolved_counts

    nodes = symbols_with_path(g).select(F.col("path").alias("file"), "name")
    return unresolved_counts(g, nodes).select("name", "file", signals.ambiguity_score(F.col("n_unresolved")).alias("ambiguity"))


@query("f04_complexity", """
    SELECT id, round(least(log2((end_line - start_line + 1) / 20.0 + 1) * 0.6, 1.5), 6) AS complexity FROM symbols""")
def f04(g):
    return g.symbols.select("id", F.round(signals.complexity_score(F.col("end_line") - F.col("start_line") + 1), 6).alias("complexity"))


@query("f05_subsystem_match", """
    SELECT e.id, CAST(CASE WHEN a.subsystem = b.subsystem THEN 0.5 ELSE 0 END AS DOUBLE) AS subsystem_score
    FROM edges e JOIN symbols s ON s.id = e.from_symbol_id JOIN files a ON a.id = s.file_id
    JOIN symbols t ON t.id = e.to_symbol_id JOIN files b ON b.id = t.file_id""")
def f05(g):
    from tracegraph.operators.graph import symbols_with_path

    where = symbols_with_path(g).select("id", "subsystem")
    mine = where.select(F.col("id").alias("from_symbol_id"), F.col("subsystem").alias("a"))
    theirs = where.select(F.col("id").alias("to_symbol_id"), F.col("subsystem").alias("b"))
    edges = g.edges.filter(F.col("to_symbol_id").isNotNull()).select("id", "from_symbol_id", "to_symbol_id")
    return edges.join(mine, "from_symbol_id").join(theirs, "to_symbol_id").select(
        "id", signals.subsystem_score(F.col("a"), F.col("b")).alias("subsystem_score")
    )


@query("f06_dataflow", "SELECT DISTINCT l_linenumber AS hops, least(l_linenumber * 0.75E0, 1.5E0) AS dataflow FROM lineitem")
def f06(g):
    return g.table("lineitem").select(F.col("l_linenumber").alias("hops"), signals.dataflow_score(F.col("l_linenumber")).alias("dataflow")).distinct()


@query("f07_weighted_sum", """
    SELECT entry_id, candidate_rank, round(0.0766E0 * recency_score + 0.2133E0 * ambiguity_score + 0.4744E0 * co_change_score
        + 0.8909E0 * subsystem_score + 0.1679E0 * complexity_score, 9) AS score FROM signal_rows""")
def f07(g):
    from tracegraph.config import CALIBRATED

    return g.signal_rows.select("entry_id", "candidate_rank", F.round(signals.weighted_sum(CALIBRATED), 9).alias("score"))


@query("f09_risk", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(least(1E0, greatest(0E0, (CASE WHEN l_suppkey % 3 >= 1 THEN 0.4E0 ELSE 0E0 END)
        + least(0.6E0, (l_partkey % 4) * 0.3E0) + (CASE WHEN l_returnflag = 'A' THEN 0E0 ELSE 0.2E0 END)
        + greatest(0, 3 - l_linenumber + 1) * 0.1E0)), 6) AS risk FROM lineitem""")
def f09(g):
    risk = signals.risk_score(F.col("l_suppkey") % 3, F.col("l_partkey") % 4, F.col("l_returnflag") == "A", F.col("l_linenumber"), 3)
    return g.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(risk, 6).alias("risk"))


@query("f10_risk_badge", """
    SELECT DISTINCT l_discount * 10 AS risk, CASE WHEN l_discount * 10 >= 0.66 THEN '🔴 high' WHEN l_discount * 10 >= 0.33 THEN '🟡 mod' ELSE '🟢 low' END AS badge,
        CASE WHEN l_discount * 10 >= 0.75 THEN 'hot' WHEN l_discount * 10 >= 0.5 THEN 'warn' ELSE 'cool' END AS tone FROM lineitem""")
def f10(g):
    r = F.col("l_discount") * 10
    return g.table("lineitem").select(r.alias("risk"), signals.risk_badge(r).alias("badge"), signals.risk_tone(r).alias("tone")).distinct()


@query("f13_like_escape", """
    SELECT s_suppkey, replace(replace(replace(s_name || '_50%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM supplier""")
def f13(g):
    return g.table("supplier").select("s_suppkey", tx.escape_like(F.concat("s_name", F.lit("_50%"))).alias("escaped"))


@query("f16_import_specs", """
    SELECT id, spec, count(*) AS n FROM (
        SELECT id, unnest(regexp_extract_all(content, 'from "([^"]+)"', 1)) AS spec FROM file_text WHERE language <> 'python'
        UNION ALL SELECT id, unnest(regexp_extract_all(content, '(?m)^\\s*from\\s+(\\.+\\w*(?:\\.\\w+)*)\\s+import\\s+', 1)) FROM file_text WHERE language = 'python') x
    GROUP BY ALL""")
def f16(g):
    specs = g.file_text.select("id", F.explode(parsing.import_specs(F.col("content"), F.col("language"))).alias("spec"))
    return specs.groupBy("id", "spec").agg(F.count(F.lit(1)).alias("n"))


@query("f18_call_receiver", """
    SELECT id, coalesce(nullif(regexp_extract(line_text, '([A-Za-z_][A-Za-z0-9_]*)\\.', 1), ''), '-') AS receiver FROM raw_edges""")
def f18(g):
    return g.raw_edges.select("id", F.coalesce(parsing.call_receiver("line_text", "to_name"), F.lit("-")).alias("receiver"))


@query("f19_bare_type", """
    SELECT id, coalesce(nullif(regexp_extract(type_text, '^(?:Optional\\[)?([A-Za-z_0-9]+)', 1), ''), '-') AS bare FROM symbols""")
def f19(g):
    return g.symbols.select("id", F.coalesce(parsing.bare_type(F.col("type_text")), F.lit("-")).alias("bare"))


@query("f21_argument_kinds", "SELECT source_kind, count(*) AS n FROM arg_bindings GROUP BY ALL")
def f21(g):
    return g.arg_bindings.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"))


LINES_SQL = "SELECT id, string_split(content, chr(10)) AS lines FROM file_text"


@query("f22_body_preview", f"""
    SELECT s.id, coalesce(nullif(trim(array_to_string(lines[greatest(1, least(start_line, len(lines))):
        least(greatest(1, least(start_line, len(lines))) + 29, end_line, len(lines))], chr(10)), ' ' || chr(10) || chr(9) || chr(13)), ''), '-') AS body
    FROM symbols s JOIN ({LINES_SQL}) f ON f.id = s.file_id""")
def f22(g):
    text = g.file_text.select(F.col("id").alias("file_id"), "content")
    body = tx.body_preview(F.col("content"), F.col("start_line"), F.col("end_line"))
    return g.symbols.join(text, "file_id").select("id", F.coalesce(body, F.lit("-")).alias("body"))


@query("f23_node_preview", f"""
    SELECT id, CASE WHEN length(b) > 600 THEN left(b, 600) || chr(10) || '…' ELSE b END AS body FROM (
        SELECT s.id, coalesce(array_to_string(lines[start_line:least(end_line, start_line + 9, len(lines))], chr(10)), '') AS b
        FROM symbols s JOIN ({LINES_SQL}) f ON f.id = s.file_id) x""")
def f23(g):
    text = g.file_text.select(F.col("id").alias("file_id"), "content")
    return g.symbols.join(text, "file_id").select("id", tx.node_preview(F.col("content"), F.col("start_line"), F.col("end_line")).alias("body"))


@query("f24_signature_line", "SELECT id, left(trim(string_split(content, chr(10))[1], ' ' || chr(9) || chr(13)), 200) AS signature FROM file_text")
def f24(g):
    return g.file_text.select("id", tx.signature_line(F.col("content")).alias("signature"))


@query("f25_loc", """
    SELECT doc_id AS id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS loc FROM documents""")
def f25(g):
    return g.table("documents").select(F.col("doc_id").alias("id"), tx.line_count(F.col("text")).alias("loc"))


@query("f26_estimated_loc", "SELECT doc_id AS id, greatest(1, CAST(floor(strlen(text) / 30.0 + 0.5) AS INTEGER)) AS loc FROM documents")
def f26(g):
    return g.table("documents").select(F.col("doc_id").alias("id"), paths.estimated_loc(F.octet_length("text")).alias("loc"))


@query("f27_days_ago", f"SELECT commit_id, {AGE_SQL} AS days_ago FROM commits")
def f27(g):
    return g.commits.select("commit_id", signals.days_between(g.as_of, F.col("date")).alias("days_ago"))


@query("f28_approx_tokens", "SELECT text_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM failure_texts")
def f28(g):
    return g.failure_texts.select("text_id", tx.approx_tokens(F.col("text")).alias("tokens"))


@query("f29_token_cost", """
    WITH prices(model, pin, pout) AS (VALUES ('src0', 3.0E0, 15.0E0), ('src1', 1.0E0, 5.0E0))
    SELECT d.doc_id, round(coalesce(n_chars / 1e6 * pin + n_chars / 2 / 1e6 * pout, 0E0), 9) AS cost FROM documents d LEFT JOIN prices ON model = source""")
def f29(g):
    prices = g.spark.createDataFrame([("src0", 3.0, 15.0), ("src1", 1.0, 5.0)], "source string, pin double, pout double")
    cost = parsing.token_cost(F.col("n_chars"), F.col("n_chars") / 2, F.col("pin"), F.col("pout"))
    return g.table("documents").join(F.broadcast(prices), "source", "left").select("doc_id", F.round(cost, 9).alias("cost"))


@query("f30_verdict", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '-' ELSE event_type END AS root_cause, CASE WHEN event_id % 4 = 0 THEN '-' ELSE 'k' || user_id END AS reasoning FROM events""")
def f30(g):
    answer = F.concat(
        F.lit("```json\n{\"rootCause\": \""), "event_type", F.lit("\", \"alternatives\": [1], \"reasoning\": \"k"), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 4 == 0, F.lit("\" oops\n```")).otherwise(F.lit("\"}\n```")),
    )
    v = parsing.verdict(answer)
    return g.table("events").select(
        "event_id", F.coalesce(v["root_cause"], F.lit("-")).alias("root_cause"), F.coalesce(v["reasoning"], F.lit("-")).alias("reasoning")
    )


@query("f31_weave", """
    SELECT id, CASE WHEN confidence >= 0.9 THEN 'solid' WHEN confidence >= 0.7 THEN 'dashed' ELSE 'dotted' END AS weave FROM edges""")
def f31(g):
    return g.edges.select("id", signals.weave(F.col("confidence")).alias("weave"))


@query("f32_node_size", """
    SELECT id, greatest(4, least(8, CAST(floor(4 + log10(greatest(1, end_line - start_line + 1) + 1) * 2 + 0.5) AS INTEGER))) AS size FROM symbols""")
def f32(g):
    from tracegraph.operators.lookup import node_styles

    return node_styles(g)


@query("f33_signal_normalise", """
    SELECT entry_id, candidate_rank, round(greatest(0, least(1, recency_score / 3.0)), 6) AS recency, round(greatest(0, least(1, co_change_score / 3.0)), 6) AS co_change FROM signal_rows""")
def f33(g):
    return g.signal_rows.select(
        "entry_id", "candidate_rank", F.round(signals.normalised_signal("recency", F.col("recency_score")), 6).alias("recency"),
        F.round(signals.normalised_signal("coChange", F.col("co_change_score")), 6).alias("co_change"),
    )


@query("f34_failure_spec", """
    SELECT id, split_part('symbol,file,failing-test,stack-trace,free-text', ',', CAST(id % 5 AS INTEGER) + 1) AS kind, path AS value FROM files""")
def f34(g):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("symbol:", "file:", "test:", "", "")]), (F.col("id") % 5 + 1).cast("int"))
    spec = parsing.failure_spec(F.concat(prefix, F.col("path")), F.col("id") % 5 == 3)
    return g.files.select("id", spec["kind"].alias("kind"), spec["value"].alias("value"))


@query("f35_fix_title", """
    SELECT commit_id, regexp_matches(CASE WHEN commit_id % 3 = 0 THEN 'Fix: ' ELSE 'fixture ' END || subject, '(?i)^(fix|bug)(\\(|:|\\s)') AS is_fix FROM commits""")
def f35(g):
    title = F.concat(F.when(F.col("commit_id") % 3 == 0, "Fix: ").otherwise("fixture "), "subject")
    return g.commits.select("commit_id", title.rlike(parsing.FIX_TITLE).alias("is_fix"))


@query("f36_sigmoid", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(l_quantity - 25))), 9) AS p FROM lineitem")
def f36(g):
    return g.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(signals.sigmoid(F.col("l_quantity") - 25), 9).alias("p"))


@query("f37_repo_id", "SELECT s_suppkey, left(sha256('/srv/' || s_name), 16) AS repo_id FROM supplier")
def f37(g):
    return g.table("supplier").select("s_suppkey", paths.repo_id(F.concat(F.lit("/srv/"), "s_name")).alias("repo_id"))


@query("f38_json_access", "SELECT event_id, props ->> '$.k' AS k FROM events")
def f38(g):
    return g.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f39_tail_score", "SELECT entry_id, candidate_rank, round(least(recency_score - 0.01, complexity_score * 0.5), 6) AS score FROM signal_rows")
def f39(g):
    return g.signal_rows.select("entry_id", "candidate_rank", F.round(signals.tail_score(F.col("recency_score"), F.col("complexity_score")), 6).alias("score"))
