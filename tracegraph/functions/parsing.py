"""Expressions that read semi-structured text: traces, diffs, blame, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the inputs.
NODE_FRAME = r"at\s+(?:([^\s()]+)\s+\()?([^\s():]+):(\d+)(?::(\d+))?\)?"
PYTHON_FRAME = r'File\s+"([^"]+)",\s+line\s+(\d+),\s+in\s+(\S+)'
HUNK_HEADER = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
HUNK_CONTEXT = r"(?m)^@@ .+? @@[ \t]*(.*)$"
TYPESCRIPT_IMPORT = (
    r"(?:import\s+(?:[^'\"`;]*?)\s+from\s*|import\s*|export\s+(?:\*|\{[^}]*\})\s+from\s*"
    r"|require\s*\(\s*|import\s*\(\s*)[\"'`]([^\"'`]+)[\"'`]"
)
PYTHON_FROM_IMPORT = r"(?m)^\s*from\s+(\.+\w*(?:\.\w+)*|\w+(?:\.\w+)*)\s+import\s+"
PYTHON_IMPORT = r"(?m)^\s*import\s+(\w+(?:\.\w+)*)"
BLAME_ENTRY = r"(?m)^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?\n((?:[^\t\n].*\n)*)\t"
FIX_TITLE = r"(?i)^(fix|bug)(\(|:|\s)"
CODE_FILE = r"(?i)\.(ts|tsx|js|mjs|cjs|jsx|py|go|rs|java|kt|swift|rb|php|c|cc|cpp|h|hpp)$"
SKIPPED_FILE = r"(?i)(^|/)(CHANGELOG|README|version|VERSION)(\.|$)|^docs/|/docs/|\.md$|\.json$|\.lock$|^_design/"
# How an enclosing symbol shows up in a hunk header, best first.
CONTEXT_SYMBOLS = [
    r"\b(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\bfunction\s+([A-Za-z_$][\w$]*)",
    r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
    r"\b(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*[:{]",
    r"^([A-Za-z_$][\w$]*)\s*\(",
]

SENTRY_FRAME = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("lineno", T.LongType()),
        T.StructField("function", T.StringType()),
    ]
)
SENTRY_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField(
            "exception",
            T.StructType(
                [
                    T.StructField(
                        "values",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField("value", T.StringType()),
                                    T.StructField(
                                        "stacktrace",
                                        T.StructType([T.StructField("frames", T.ArrayType(SENTRY_FRAME))]),
                                    ),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
SENTRY_ISSUE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("shortId", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)
SENTRY_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event", SENTRY_EVENT),
        T.StructField("issue", SENTRY_ISSUE),
        T.StructField(
            "data", T.StructType([T.StructField("event", SENTRY_EVENT), T.StructField("issue", SENTRY_ISSUE)])
        ),
    ]
)


def _non_empty(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def stack_frames(text: Column) -> Column:
    """array<struct<path, symbol, line>>: first frame of every path, Node frames before Python ones."""

    def part(pattern: str, path: int, symbol: int, line: int) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(path)).alias("path"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(symbol)).alias("symbol"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(line)).alias("line"),
        )

    frames = F.concat(part(NODE_FRAME, 2, 1, 3), part(PYTHON_FRAME, 1, 3, 2))
    paths = F.transform(frames, lambda f: f["path"])
    return F.filter(frames, lambda f, i: F.array_position(paths, f["path"]) == i + 1)


def frame_texts(text: Column) -> Column:
    """array<string>: the frames of a trace as they are written, Node frames before Python ones; ``frame_parts`` reads one."""
    return F.concat(F.regexp_extract_all(text, F.lit(NODE_FRAME), F.lit(0)), F.regexp_extract_all(text, F.lit(PYTHON_FRAME), F.lit(0)))


def frame_parts(frame: Column) -> tuple[Column, Column]:
    """Path and symbol of one of ``frame_texts``; a Node frame may have no symbol."""
    node = frame.startswith("at")
    path = F.when(node, F.regexp_extract(frame, NODE_FRAME, 2)).otherwise(F.regexp_extract(frame, PYTHON_FRAME, 1))
    return path, F.when(node, F.regexp_extract(frame, NODE_FRAME, 1)).otherwise(F.regexp_extract(frame, PYTHON_FRAME, 3))


def hunks(patch: Column) -> Column:
    """array<struct<start_line, end_line>> of the new side of a unified diff."""
    starts = F.regexp_extract_all(patch, F.lit(HUNK_HEADER), F.lit(1))
    lengths = F.regexp_extract_all(patch, F.lit(HUNK_HEADER), F.lit(2))
    pairs = F.zip_with(
        starts,
        lengths,
        lambda s, n: F.struct(
            s.cast("int").alias("start_line"),
            F.when(n == "", F.lit(1)).otherwise(n.try_cast("int")).alias("n_lines"),
        ),
    )
    kept = F.filter(pairs, lambda h: h["n_lines"] > 0)
    ranges = F.transform(
        kept,
        lambda h: F.struct(h["start_line"].alias("start_line"), (h["start_line"] + h["n_lines"] - 1).alias("end_line")),
    )
    return F.coalesce(ranges, F.array().cast("array<struct<start_line:int,end_line:int>>"))


def context_symbol(context: Column) -> Column:
    """Name of the function or class in a hunk header's trailing context."""
    return F.coalesce(*[_non_empty(F.regexp_extract(context, p, 1)) for p in CONTEXT_SYMBOLS])


def hunk_contexts(diff: Column) -> Column:
    found = F.regexp_extract_all(diff, F.lit(HUNK_CONTEXT), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda c: F.length(c) > 0)


def import_specs(content: Column, language: Column) -> Column:
    """Module specifiers in file order; Python ``from`` imports come before plain ones."""
    ts = F.regexp_extract_all(content, F.lit(TYPESCRIPT_IMPORT), F.lit(1))
    py = F.concat(
        F.regexp_extract_all(content, F.lit(PYTHON_FROM_IMPORT), F.lit(1)),
        F.regexp_extract_all(content, F.lit(PYTHON_IMPORT), F.lit(1)),
    )
    return F.when(language == "python", py).otherwise(ts)


def call_receiver(line: str, name: str) -> Column:
    """Identifier before ``.name(`` on a source line; NULL for chained receivers.

    Takes column names because the pattern itself depends on the row.
    """
    pattern = (
        "concat('^(.*?)\\\\b([A-Za-z_][A-Za-z0-9_]*)\\\\.', "
        f"regexp_replace({name}, '([^A-Za-z0-9_])', '\\\\\\\\$1'), '\\\\s*\\\\(')"
    )
    before = F.expr(f"regexp_extract({line}, {pattern}, 1)")
    receiver = F.expr(f"regexp_extract({line}, {pattern}, 2)")
    chained = F.right(before, F.lit(1)).isin(".", "]", ")")
    return F.when((F.length(receiver) > 0) & ~chained, receiver)


def has_method_call(line: str, name: str) -> Column:
    """True when the line contains ``.name(``."""
    return F.expr(
        f"coalesce({line} rlike concat('\\\\.', regexp_replace({name}, '([^A-Za-z0-9_])', '\\\\\\\\$1'), '\\\\s*\\\\('), false)"
    )


def bare_type(type_text: Column) -> Column:
    """Single class name of an annotation, else NULL."""
    s = F.trim(type_text)
    s = F.when(s.rlike("^\".*\"$|^'.*'$") & (F.length(s) > 1), F.trim(s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)
    inner = F.regexp_extract(s, r"^Optional\[(.+)\]$", 1)
    s = F.when(inner != "", F.trim(inner)).otherwise(s)
    arms = F.filter(
        F.transform(F.split(s, r"\|"), lambda p: F.trim(p)), lambda p: (p != "") & (p != "None")
    )
    s = F.when(F.size(arms) == 1, F.try_element_at(arms, F.lit(1))).otherwise(s)
    return F.when(s.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), s)


def sentry_incident(payload: Column) -> Column:
    """struct<issue_id, title, failure_text>; issue_id is NULL when the payload has none."""
    p = F.from_json(payload, SENTRY_PAYLOAD)
    event = F.coalesce(p["data"]["event"], p["event"])
    issue = F.coalesce(p["data"]["issue"], p["issue"])
    issue_id = F.coalesce(issue["id"], issue["shortId"], p["id"], event["event_id"])
    title = F.coalesce(
        p["data"]["issue"]["title"], event["title"], event["message"], F.concat(F.lit("Sentry incident "), issue_id)
    )

    def frame_line(f: Column) -> Column:
        return F.concat(
            F.lit("  at "),
            F.coalesce(f["function"], F.lit("<anonymous>")),
            F.lit(" ("),
            F.coalesce(f["filename"], f["module"], F.lit("<unknown>")),
            F.when(f["lineno"].isNotNull(), F.concat(F.lit(":"), f["lineno"].cast("string"))).otherwise(F.lit("")),
            F.lit(")"),
        )

    def value_lines(v: Column) -> Column:
        head = F.concat_ws(": ", _non_empty(v["type"]), _non_empty(v["value"]))
        frames = F.coalesce(v["stacktrace"]["frames"], F.array().cast(T.ArrayType(SENTRY_FRAME)))
        head_lines = F.when(F.length(head) > 0, F.array(head)).otherwise(F.array().cast("array<string>"))
        return F.concat(head_lines, F.transform(F.reverse(frames), frame_line))

    values = F.coalesce(
        event["exception"]["values"],
        F.array().cast(SENTRY_EVENT["exception"].dataType["values"].dataType),
    )
    lines = F.flatten(F.transform(values, value_lines))
    text = (
        F.when(event.isNull(), title)
        .when(F.size(lines) > 0, F.array_join(lines, "\n"))
        .otherwise(F.coalesce(event["message"], title))
    )
    return F.struct(issue_id.alias("issue_id"), title.alias("title"), text.alias("failure_text"))


def blame_entries(porcelain: Column) -> Column:
    """array<struct<commit, line, meta>> in file order; meta may be empty after the first entry of a commit."""

    def group(i: int) -> Column:
        return F.regexp_extract_all(porcelain, F.lit(BLAME_ENTRY), F.lit(i))

    return F.arrays_zip(group(1).alias("commit"), group(2).alias("line"), group(3).alias("meta"))


def blame_field(meta: Column, field: str) -> Column:
    return F.regexp_extract(meta, rf"(?m)^{field} (.*)$", 1)


def numstat_rows(text: Column) -> Column:
    """array<struct<path, additions, deletions>>; binary files count as zero."""
    rows = F.filter(F.split(text, "\n"), lambda r: (F.trim(r) != "") & (F.size(F.split(r, "\t")) >= 3))

    def row(r: Column) -> Column:
        parts = F.split(r, "\t", 3)
        count = lambda v: F.coalesce(v.try_cast("int"), F.lit(0))
        return F.struct(
            parts[2].alias("path"), count(parts[0]).alias("additions"), count(parts[1]).alias("deletions")
        )

    return F.transform(rows, row)


def file_patches(diff: Column) -> Column:
    """array<struct<path, patch>>, one per file of a unified diff."""
    blocks = F.filter(F.split(diff, r"(?m)^diff --git "), lambda b: F.length(b) > 0)

    def block(b: Column) -> Column:
        first = F.substring_index(b, "\n", 1)
        full = F.concat(F.lit("diff --git "), b, F.when(b.endswith("\n"), F.lit("")).otherwise(F.lit("\n")))
        return F.struct(F.regexp_extract(first, r"^a/(.+) b/(.+)$", 2).alias("path"), full.alias("patch"))

    return F.filter(F.transform(blocks, block), lambda p: p["path"] != "")


def verdict(raw: Column) -> Column:
    """struct<root_cause, alternatives, reasoning> of a fenced JSON answer; NULL when it is not JSON."""
    from tracegraph.functions.text import strip_code_fence

    cleaned = strip_code_fence(raw)
    alternatives = F.get_json_object(cleaned, "$.alternatives")
    ok = F.try_parse_json(cleaned).isNotNull()
    return F.when(
        ok,
        F.struct(
            F.get_json_object(cleaned, "$.rootCause").alias("root_cause"),
            F.when(alternatives.startswith("["), alternatives).otherwise(F.lit("[]")).alias("alternatives"),
            F.coalesce(F.get_json_object(cleaned, "$.reasoning"), F.lit("")).alias("reasoning"),
        ),
    )


def failure_spec(spec: Column, path_exists: Column) -> Column:
    """struct<kind, value> of a command-line failure argument."""

    def after(prefix: str) -> Column:
        return spec.substr(F.lit(len(prefix) + 1), F.length(spec))

    cases = [("symbol:", "symbol"), ("file:", "file"), ("test:", "failing-test")]
    kind_expr = None
    value_expr = None
    for prefix, name in cases:
        cond = spec.startswith(prefix)
        kind_expr = F.when(cond, F.lit(name)) if kind_expr is None else kind_expr.when(cond, F.lit(name))
        value_expr = F.when(cond, after(prefix)) if value_expr is None else value_expr.when(cond, after(prefix))
    kind = kind_expr.when(path_exists, F.lit("stack-trace")).otherwise(F.lit("free-text"))
    value = value_expr.otherwise(spec)
    return F.struct(kind.alias("kind"), value.alias("value"))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Price of a call; models without a price row cost 0."""
    return F.coalesce(
        input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price, F.lit(0.0)
    )


def git_blob_sha(content: Column) -> Column:
    """Object id git gives to a file with this content."""
    raw = content.cast("binary")
    header = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.lit(b"\x00"))
    return F.sha1(F.concat(header, raw))


def content_sha(content: Column) -> Column:
    """Content hash outside version control."""
    return F.concat(F.lit("s:"), F.sha2(content.cast("binary"), 256))
