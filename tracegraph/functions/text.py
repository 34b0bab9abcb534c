"""Text expressions: tokens of a failure description, sub-words, slices of source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegraph.functions.fixed import STOP_WORDS

# A quoted literal with backslash escapes, either quote character.
QUOTED = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"

# Word boundaries inside an identifier, applied in this order.
BOUNDARIES = [
    (r"([a-z])([A-Z])", "$1 $2"),
    (r"([A-Z])([A-Z][a-z])", "$1 $2"),
    (r"([A-Za-z])([0-9])", "$1 $2"),
    (r"([0-9])([A-Za-z])", "$1 $2"),
]


def literal_tokens(text: Column) -> Column:
    """Contents of quoted regions, trimmed, two characters or more, first-seen order."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    inner = F.transform(quoted, lambda q: F.regexp_replace(q.substr(F.lit(2), F.length(q) - 2), r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(inner, lambda t: F.length(t) >= 2))


def identifier_tokens(text: Column) -> Column:
    """Identifiers outside quotes: three characters or more, no stop words, case kept."""
    unquoted = F.regexp_replace(text, QUOTED, " ")
    words = F.regexp_extract_all(unquoted, F.lit(IDENTIFIER), F.lit(0))
    kept = F.filter(words, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP_WORDS))
    return F.array_distinct(kept)


def split_compound(token: Column) -> Column:
    """Lower-cased sub-words of a snake_case or camelCase identifier."""
    spaced = F.regexp_replace(token, "_", " ")
    for pattern, replacement in BOUNDARIES:
        spaced = F.regexp_replace(spaced, pattern, replacement)
    words = F.transform(F.split(spaced, r"\s+"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r?\n")


def line_count(content: Column) -> Column:
    """Newlines plus one, zero for empty text."""
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.length(content) == 0, F.lit(0)).otherwise(newlines + 1).cast("int")


def clamped_range(lines: Column, start: Column, end: Column, max_lines: int):
    """(first line, last line) of a slice that stays inside the file."""
    n = F.size(lines)
    lo = F.greatest(F.lit(1), F.least(start, n))
    hi = F.least(lo + (max_lines - 1), end, n)
    return lo, hi


def preview_of_lines(lines: Column, start: Column, end: Column, max_lines: int = 30) -> Column:
    """The first lines of a symbol's range; NULL when blank or out of range."""
    lo, hi = clamped_range(lines, start, end, max_lines)
    joined = F.array_join(F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n")
    trimmed = F.regexp_replace(joined, r"^\s+|\s+$", "")
    usable = lines.isNotNull() & (start > 0) & (end >= start) & (hi >= lo) & (F.length(trimmed) > 0)
    return F.when(usable, trimmed)


def body_preview(content: Column, start: Column, end: Column, max_lines: int = 30) -> Column:
    return preview_of_lines(lines_of(content), start, end, max_lines)


def source_slice(content: Column, start: Column, end: Column, max_lines: int) -> Column:
    """Struct (body, start_line, end_line, truncated) for a candidate's source."""
    lines = lines_of(content)
    n = F.size(lines)
    lo = F.greatest(F.lit(1), F.least(start, n))
    wanted = F.greatest(lo, F.least(end, n))
    truncated = (wanted - lo + 1) > max_lines
    hi = F.when(truncated, lo + (max_lines - 1)).otherwise(wanted)
    return F.struct(
        F.array_join(F.slice(lines, lo, hi - lo + 1), "\n").alias("body"),
        lo.cast("int").alias("start_line"),
        hi.cast("int").alias("end_line"),
        truncated.alias("truncated"),
    )


def node_preview(content: Column, start: Column, end: Column, max_lines: int = 10, max_chars: int = 600) -> Column:
    """Short source text for a graph node, marked when cut."""
    lines = F.split(content, "\n")
    last = F.least(end, start + (max_lines - 1), F.size(lines))
    body = F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n")
    return F.when(F.length(body) > max_chars, F.concat(body.substr(1, max_chars), F.lit("\n…"))).otherwise(body)


def signature_line(text: Column) -> Column:
    first = F.substring_index(text, "\n", 1)
    return F.regexp_replace(first, r"^\s+|\s+$", "").substr(1, 200)


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def strip_code_fence(raw: Column) -> Column:
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*", ""), r"```\s*$", "")


def regex_literal(text: Column) -> Column:
    """Quote regex metacharacters of a value so it matches itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
