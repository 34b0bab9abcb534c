"""Text for people: tables, context and prompts over small ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, limit: int = 50) -> str:
    """Fixed-width table of the first rows."""
    rows = [df.columns] + [["" if v is None else str(v) for v in row] for row in df.limit(limit).collect()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)


def candidate_section(ranked: DataFrame, limit: int = 25) -> str:
    """Markdown list of ranked candidates."""
    lines = ["## Ranked candidates", ""]
    for r in ranked.orderBy("rank").limit(limit).collect():
        where = "unknown location" if r["file"] is None else f"{r['file']}:{r['line']}" if r["line"] is not None else r["file"]
        lines.append(f"{r['rank']}. `{r['name']}` ({where}), score {r['score']:.3f}: {r['rationale']}")
    return "\n".join(lines if len(lines) > 2 else [*lines, "_(no candidates)_"])


def failure_section(failure: dict) -> str:
    """Markdown for one failure row."""
    kind = failure["kind"]
    if kind == "stack-trace":
        body = "```\n" + failure["text"] + "\n```"
    elif kind == "failing-test":
        body = f"Failing test: {failure['path']}" + (f"\nTest name: {failure['test_name']}" if failure.get("test_name") else "")
    elif kind == "symbol":
        body = f"Investigating symbol: {failure['name']}" + (f"\nFile: {failure['file']}" if failure.get("file") else "")
    elif kind == "file":
        body = f"Investigating file: {failure['path']}"
    else:
        body = "Free-text failure description:\n\n```\n" + failure["text"] + "\n```"
    return "# Failure context\n\n" + body


def prompt(failure: dict, ranked: DataFrame, hypothesis: str | None, context: str, max_tokens: int | None = None) -> str:
    """The full text; over the budget the context goes first, then the tail of the candidates."""
    parts = {
        "failure": failure_section(failure), "candidates": candidate_section(ranked),
        "hypothesis": "## First hypothesis\n\n" + (hypothesis or "_(no candidates)_"), "context": context,
    }
    join = lambda: "\n\n---\n\n".join(v for v in parts.values() if v)
    too_long = lambda: max_tokens is not None and -(-len(join()) // 4) > max_tokens
    if too_long():
        parts["context"] = ""
    if too_long():
        parts["candidates"] = candidate_section(ranked, 5)
    if too_long():
        parts["candidates"] = candidate_section(ranked, 1)
    return join()
