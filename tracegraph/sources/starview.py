"""The star-schema tables seen as a code graph.

Every view is one SELECT over the given parquet tables. The text uses only
what Spark SQL and DuckDB share, so the same definition feeds the Spark job and
the checking query; ``{name}`` marks a table or another view.

Sixteen consecutive part keys form one source file: a class with four methods,
four functions, one const, interface and type, two parameters and two locals.
Line items are call edges, orders are commits and imports, conversations and
events are failure reports.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tracegraph.operators.graph import Graph

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

ADJECTIVES = "small,rapid,blue,green,large,tiny,solid,slow"
NOUNS = "widget,bolt,plate,ring,gear,panel,valve,spring"
MENTIONS = "smallWidget,rapidBolt,bluePlate,greenRing,largeGear,tinyPanel,solidValve,slowSpring"


def whole(expr: str, by: int) -> str:
    return f"CAST(floor(({expr}) / {by}) AS BIGINT)"


def pick(values: str, index: str) -> str:
    return f"split_part('{values}', ',', CAST({index} AS INT) + 1)"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def name_of(key: str) -> str:
    return (
        f"({pick(ADJECTIVES, f'({key}) % 8')} || '_' || {pick(NOUNS, f'{whole(key, 8)} % 8')}"
        f" || '_' || {text(f'({key}) % 31')})"
    )


def language_of(doc: str) -> str:
    return f"CASE WHEN ({doc}) % 11 = 10 THEN 'unparsed' WHEN ({doc}) % 3 = 0 THEN 'python' ELSE 'typescript' END"


def path_of(doc: str) -> str:
    suffix = (
        f"CASE WHEN ({doc}) % 11 = 10 THEN '.md' WHEN ({doc}) % 3 = 0 THEN '.py' "
        f"WHEN ({doc}) % 3 = 1 THEN '.ts' ELSE '.tsx' END"
    )
    stem = f"CASE WHEN ({doc}) % 7 = 3 THEN '/tests/test_mod_' ELSE '/mod_' END"
    return f"('pkg' || {text(f'({doc}) % 20')} || {stem} || {text(doc)} || {suffix})"


N_PARTS = "(SELECT max(p_partkey) + 1 FROM {part})"
N_FILES = f"(SELECT {whole('max(p_partkey)', 16)} + 1 FROM {{part}})"
N_DOCS = "(SELECT max(doc_id) + 1 FROM {documents})"
KINDS = "class,method,method,method,method,function,function,function,function,const,interface,type,param,param,local,local"
# First and last line of each slot, before scaling by the block's line factor.
STARTS = "1,2,8,14,20,30,38,46,54,62,68,72,30,38,32,40"
ENDS = "28,6,12,18,24,36,44,52,60,66,71,72,36,44,36,44"

VIEW_SQL = {
    "files": f"""
        SELECT doc_id AS id, {path_of('doc_id')} AS path, {language_of('doc_id')} AS language,
               source AS subsystem,
               CAST(CASE WHEN length(text) = 0 THEN 0
                    ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INT) AS loc
        FROM {{documents}}""",
    "file_text": f"""
        SELECT doc_id AS id, {path_of('doc_id')} AS path, {language_of('doc_id')} AS language,
               text || chr(10) || imports || 'call ' || {name_of('doc_id * 3')} || '() ' || {name_of('doc_id * 5 + 1')}
                    || '(x)' || chr(10) AS content
        FROM (SELECT doc_id, text,
                     CASE WHEN {language_of('doc_id')} = 'python'
                          THEN 'from ..pkg' || {text('d1 % 20')} || '.mod_' || {text('d1')} || ' import thing' || chr(10)
                            || 'from ..pkg' || {text('d2 % 20')} || '.mod_' || {text('d2')} || ' import other' || chr(10)
                          ELSE 'import {{ thing }} from "../pkg' || {text('d1 % 20')} || '/mod_' || {text('d1')} || '.js";' || chr(10)
                            || 'import {{ other }} from "../pkg' || {text('d2 % 20')} || '/mod_' || {text('d2')} || '";' || chr(10)
                          END AS imports
              FROM (SELECT doc_id, text, (doc_id * 7 + 1) % {N_DOCS} AS d1, (doc_id * 3 + 2) % {N_DOCS} AS d2 FROM {{documents}}) d) t""",
    "symbols": f"""
        SELECT id, file_id, name, kind,
               CASE WHEN slot BETWEEN 1 AND 4 THEN id - slot WHEN slot IN (12, 13) THEN id - 7 ELSE NULL END AS parent_id,
               CAST((start0 - 1) * scale + 1 AS INT) AS start_line, CAST(end0 * scale AS INT) AS end_line,
               CASE WHEN kind = 'param' THEN NULL ELSE signature END AS signature,
               exported,
               CASE WHEN slot = 12 THEN {name_of('id - slot + 16')}
                    WHEN slot = 13 THEN 'Optional[' || {name_of('id - slot + 16')} || ']'
                    WHEN slot = 14 THEN {name_of('id - slot + 16')} || ' | None' ELSE NULL END AS type_text
        FROM (SELECT p_partkey AS id, {whole('p_partkey', 16)} AS file_id, {name_of('p_partkey')} AS name,
                     {pick(KINDS, 'p_partkey % 16')} AS kind, p_partkey % 16 AS slot,
                     CAST({pick(STARTS, 'p_partkey % 16')} AS BIGINT) AS start0,
                     CAST({pick(ENDS, 'p_partkey % 16')} AS BIGINT) AS end0,
                     {whole('p_partkey', 16)} % 4 + 1 AS scale,
                     p_name || ' ' || p_brand || ' ' || p_type AS signature,
                     p_partkey % 2 = 0 AS exported
              FROM {{part}}) s""",
    "call_sites": f"""
        SELECT id, from_symbol_id, target, is_open, kind, confidence, call_line, is_builtin, is_method_call, builtin,
               {name_of('target')} AS target_name, {name_of('from_symbol_id + 7')} AS receiver
        FROM (SELECT {text('l_orderkey')} || '-' || {text('l_linenumber')} || '-' || {text('l_partkey')} || '-'
                     || {text('l_suppkey')} || '-' || {text('CAST(l_quantity AS INT)')} AS id,
                     l_partkey - l_partkey % 16 + (l_partkey % 16) % 10 AS from_symbol_id,
                     least(CASE WHEN l_suppkey % 4 = 0 THEN l_partkey - l_partkey % 16 + l_orderkey % 16
                                ELSE (l_orderkey * 7 + l_suppkey * 31 + l_linenumber * 101) % {N_PARTS} END,
                           {N_PARTS} - 1) AS target,
                     l_returnflag = 'R' AS is_open,
                     CASE WHEN (l_partkey % 16) % 10 = 0 AND l_linenumber = 7 THEN 'EXTENDS'
                          WHEN (l_partkey % 16) % 10 = 0 AND l_linenumber = 6 THEN 'IMPLEMENTS' ELSE 'CALLS' END AS kind,
                     round(1.0 - l_discount * 6, 2) AS confidence,
                     CAST(l_linenumber * 6 AS INT) AS call_line,
                     l_returnflag = 'R' AND l_suppkey % 3 = 0 AS is_builtin,
                     l_linestatus = 'O' AS is_method_call,
                     {pick('len,append,forEach,getattr', 'l_linenumber % 4')} AS builtin
              FROM {{lineitem}}) c""",
    "edges": """
        SELECT id, from_symbol_id, CASE WHEN is_open THEN NULL ELSE target END AS to_symbol_id,
               CASE WHEN is_builtin THEN builtin ELSE target_name END AS to_name, kind, confidence, call_line,
               CASE WHEN NOT is_open THEN NULL WHEN is_builtin THEN 'stdlib' WHEN is_method_call THEN 'instance_method'
                    ELSE 'unknown' END AS resolution_kind
        FROM {call_sites}""",
    "raw_edges": """
        SELECT id, from_symbol_id, CAST(NULL AS BIGINT) AS to_symbol_id,
               CASE WHEN is_builtin THEN builtin ELSE target_name END AS to_name, kind,
               CAST(1.0 AS DOUBLE) AS confidence, call_line, CAST(NULL AS STRING) AS resolution_kind,
               CASE WHEN is_method_call THEN '  ' || receiver || '.' ELSE '  ' END
                    || CASE WHEN is_builtin THEN builtin ELSE target_name END || '(x)' AS line_text
        FROM {call_sites}""",
    "arg_bindings": f"""
        SELECT edge_id, position, source_kind, source_text,
               CASE WHEN source_kind = 'identifier' AND known THEN source ELSE NULL END AS source_symbol_id
        FROM (SELECT {text('l_orderkey')} || '-' || {text('l_linenumber')} || '-' || {text('l_partkey')} || '-'
                     || {text('l_suppkey')} || '-' || {text('CAST(l_quantity AS INT)')} AS edge_id,
                     CAST(l_linenumber - 1 AS INT) AS position,
                     split_part('identifier,literal,identifier,member,call,identifier,other', ',', CAST(l_linenumber AS INT))
                         AS source_kind,
                     l_partkey - l_partkey % 16 + CAST(l_quantity AS BIGINT) % 16 AS source,
                     {name_of('l_partkey - l_partkey % 16 + CAST(l_quantity AS BIGINT) % 16')} AS source_text,
                     l_linestatus = 'O' AS known
              FROM {{lineitem}}) b""",
    "params": """
        SELECT id, parent_id AS symbol_id, CAST(id % 2 AS INT) AS position, name, type_text, id % 3 = 0 AS has_default
        FROM {symbols} WHERE kind = 'param'""",
    "imports": f"""
        SELECT id, file_id,
               CASE WHEN id % 5 = 0 THEN 'alias_' ELSE '' END || {name_of('target')} AS local_name,
               CASE WHEN id % 9 = 0 THEN 'external-lib'
                    WHEN {language_of('file_id')} = 'python' AND id % 4 = 0
                    THEN 'pkg' || {text('target_file % 20')} || '.mod_' || {text('target_file')}
                    WHEN {language_of('file_id')} = 'python'
                    THEN '..pkg' || {text('target_file % 20')} || '.mod_' || {text('target_file')}
                    ELSE '../pkg' || {text('target_file % 20')} || '/mod_' || {text('target_file')}
                         || CASE WHEN id % 2 = 0 THEN '.js' ELSE '' END END AS source_module,
               {name_of('target')} AS source_name,
               CASE WHEN {language_of('file_id')} = 'python' THEN 'from' ELSE 'named' END AS kind
        FROM (SELECT id, file_id, target, {whole('target', 16)} AS target_file
              FROM (SELECT o_orderkey AS id, (o_custkey * 3 + o_orderkey) % {N_FILES} AS file_id,
                           (o_orderkey * 13) % {N_PARTS} - ((o_orderkey * 13) % {N_PARTS}) % 16
                               + CAST({pick('0,5,6,7,8,9', 'o_orderkey % 6')} AS BIGINT) AS target
                    FROM {{orders}}) a) i""",
    "commits": """
        SELECT o_orderkey AS commit_id, lpad(CAST(o_orderkey AS STRING), 10, '0') AS sha,
               CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'dev' || CAST(o_custkey AS STRING) END AS author,
               o_orderdate AS date, o_orderpriority AS subject, o_orderstatus = 'P' AS is_merge
        FROM {orders}""",
    "commit_lines": f"""
        SELECT l_orderkey AS commit_id, {whole('l_partkey', 16)} AS file_id,
               CAST(l_quantity AS INT) * 2 AS start_line, CAST(CAST(l_quantity AS INT) * 2 + l_linenumber * 2 AS INT) AS end_line
        FROM {{lineitem}}""",
    "failure_texts": f"""
        SELECT conv_id * 1000 + turn AS text_id,
               text || ' failed in ' || {name_of('conv_id * 37 + turn')} || ' near ' || {pick(MENTIONS, 'conv_id % 8')}
                    || ' value "Brand#' || {text('conv_id % 25')} || '" ' AS text
        FROM {{conversations}}""",
    "traces": f"""
        SELECT id, '    at ' || {name_of('s1')} || ' (' || {path_of(whole('s1', 16))} || ':' || {text('id % 90 + 1')} || ':5)'
                   || chr(10) || '    at ' || {path_of(whole('s2', 16))} || ':7' || chr(10)
                   || '  File "' || {path_of(whole('s1', 16))} || '", line 3, in again' || chr(10)
                   || '  File "' || {path_of(whole('s3', 16))} || '", line ' || {text('id % 50 + 1')} || ', in '
                   || {name_of('s3')} || chr(10) AS text
        FROM (SELECT event_id AS id, (event_id * 17) % {N_PARTS} AS s1, (event_id * 29 + user_id) % {N_PARTS} AS s2,
                     (event_id * 7 + 3) % {N_PARTS} AS s3 FROM {{events}}) t""",
    "payloads": f"""
        SELECT event_id AS id,
               CASE WHEN event_id % 5 = 0 THEN '{{"id":"w' || {text('event_id')} || '","event":{{"message":"' || event_type || '"}}}}'
                    ELSE '{{"data":{{"issue":{{"id":"' || {text('event_id')} || '","title":"' || event_type || ' failure"}},'
                      || '"event":{{"exception":{{"values":[{{"type":"' || event_type || '","value":"v' || {text('user_id')}
                      || '","stacktrace":{{"frames":[{{"filename":"' || {path_of('user_id')} || '","lineno":' || {text('event_id % 90')}
                      || ',"function":"outer"}},{{"module":"m' || {text('user_id')} || '","function":"inner"}}]}}}}]}}}}}}}}' END AS payload
        FROM {{events}}""",
    "patches": f"""
        SELECT l_orderkey AS pr_id, {whole('l_partkey', 16)} AS file_id, {path_of(whole('l_partkey', 16))} AS path,
               CASE WHEN l_returnflag = 'R' THEN 'removed' WHEN l_returnflag = 'A' THEN 'added' ELSE 'modified' END AS status,
               CASE WHEN l_linenumber = 7 THEN ''
                    ELSE '@@ -1,2 +' || {text('CAST(l_quantity AS INT)')} || ',' || {text('l_linenumber - 1')} || ' @@ def '
                         || {name_of('l_partkey')} || '(self):' || chr(10) || '+changed' || chr(10)
                         || '@@ -9 +' || {text('CAST(l_quantity AS INT) + 60')} || ' @@ function ' || {name_of('l_partkey + 1')}
                         || '(a)' || chr(10) || '-gone' || chr(10) END AS patch
        FROM {{lineitem}}""",
    "blames": """
        SELECT o_orderkey AS id,
               lpad(CAST(o_orderkey AS STRING), 40, 'a') || ' 1 1 2' || chr(10) || 'author dev' || CAST(o_custkey AS STRING)
                 || chr(10) || 'author-time ' || CAST(900000000 + o_orderkey AS STRING) || chr(10) || 'summary ' || o_orderpriority
                 || chr(10) || chr(9) || 'first' || chr(10)
                 || lpad(CAST(o_custkey AS STRING), 40, 'b') || ' 4 2 1' || chr(10) || 'author other' || chr(10)
                 || 'summary ' || o_orderstatus || chr(10) || chr(9) || 'second' || chr(10)
                 || lpad(CAST(o_orderkey AS STRING), 40, 'a') || ' 2 3' || chr(10) || chr(9) || 'third' || chr(10) AS porcelain
        FROM {orders}""",
    "shows": f"""
        SELECT l_orderkey AS commit_id,
               {text('l_linenumber')} || chr(9) || {text('CAST(l_quantity AS INT)')} || chr(9) || {path_of(whole('l_partkey', 16))}
                 || chr(10) || '-' || chr(9) || '-' || chr(9) || 'img/' || {text('l_suppkey')} || '.png' || chr(10) AS numstat,
               'diff --git a/' || {path_of(whole('l_partkey', 16))} || ' b/' || {path_of(whole('l_partkey', 16))} || chr(10)
                 || '@@ -1 +1 @@ class ' || {name_of('l_partkey')} || ':' || chr(10) || 'diff --git a/old b/only_'
                 || {text('l_suppkey')} || chr(10) || '+x' AS diff
        FROM {{lineitem}}""",
    "signal_rows": f"""
        SELECT {whole('d.doc_id', 10)} AS entry_id, d.doc_id % 10 + 1 AS candidate_rank,
               CASE WHEN d.doc_id % 10 = ({whole('d.doc_id', 10)} * 7) % 10 THEN 1 ELSE 0 END AS label,
               CAST(d.n_chars % 4 AS DOUBLE) AS recency_score,
               CASE WHEN d.doc_id % 10 = 0 THEN 2.5E0 WHEN d.doc_id % 3 = 0 THEN 1E0 ELSE 0.5E0 END AS proximity_score,
               CAST(coalesce(l.toxic, 0) AS DOUBLE) AS ambiguity_score,
               CAST(d.n_chars % 7 AS DOUBLE) / 4 AS co_change_score,
               CAST(coalesce(l.quality, 0) AS DOUBLE) / 2 AS subsystem_score,
               CAST(d.n_chars % 13 AS DOUBLE) / 8 AS complexity_score,
               CAST(0 AS DOUBLE) AS dataflow_score
        FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id""",
    "changes": f"""
        SELECT event_id, 'repo' || {text('user_id % 3')} AS repo, {path_of('user_id')} AS path, ts,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS action
        FROM {{events}}""",
    "links": """
        SELECT page_id AS id, url, html AS content FROM {pages}""",
}

# The braces of JSON text are doubled for the f-string only; keep them literal.
_REFERENCE = re.compile(r"\{([a-z_]+)\}")


def references(sql: str) -> list[str]:
    """Tables and views a definition reads, in order of appearance."""
    known = set(TABLES) | set(VIEW_SQL)
    return list(dict.fromkeys(n for n in _REFERENCE.findall(sql) if n in known))


def _substitute(sql: str, naming) -> str:
    known = set(TABLES) | set(VIEW_SQL)
    return _REFERENCE.sub(lambda m: naming(m.group(1)) if m.group(1) in known else m.group(0), sql)


def with_views(body: str) -> str:
    """Checking SQL: ``body`` preceded by the definitions of the views it names."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed or name not in VIEW_SQL:
            return
        for ref in references(VIEW_SQL[name]):
            visit(ref)
        needed.append(name)

    for word in dict.fromkeys(re.findall(r"[a-z_]+", body)):
        visit(word)
    ctes = [f"{n} AS ({_substitute(VIEW_SQL[n], lambda r: r)})" for n in needed]
    stripped = body.strip()
    match = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", stripped)
    if match:
        ctes.append(stripped[match.end():])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    if not ctes:
        return stripped
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + stripped


class StarGraph(Graph):
    """Graph tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in self._cache:
            definition = VIEW_SQL[name]
            refs = references(definition)
            for ref in refs:
                self.view(ref).createOrReplaceTempView(self._view_name(ref))
            self._cache[name] = self.spark.sql(_substitute(definition, self._view_name))
        return self._cache[name]

    def _view_name(self, name: str) -> str:
        return f"tracegraph_{name}"

    @cached_property
    def py_roots(self) -> DataFrame:
        """Top directories act as package roots."""
        from pyspark.sql import functions as F

        top = F.substring_index("path", "/", 1)
        return self.files.select(top.alias("package"), top.alias("root")).distinct()

    @cached_property
    def as_of(self):
        """Timestamp of the newest commit, as a scalar subquery column."""
        from pyspark.sql import functions as F

        return self.table("orders").select(F.max("o_orderdate")).scalar()

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in VIEW_SQL:
            raise AttributeError(name)
        return self.view(name)
