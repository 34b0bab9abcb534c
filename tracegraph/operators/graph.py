"""The tables every operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Graph:
    """Bundle of the graph tables as attributes.

    files(id, path, language, subsystem, loc), symbols(id, file_id, name, kind,
    parent_id, start_line, end_line, signature, exported, type_text),
    edges(id, from_symbol_id, to_symbol_id, to_name, kind, confidence,
    call_line, resolution_kind), imports, params, arg_bindings, file_text(id,
    path, language, content), commits(commit_id, sha, author, date, subject,
    is_merge), commit_lines(commit_id, file_id, start_line, end_line).
    ``as_of`` is the moment ages are counted from, as a Column.
    """

    def __init__(self, as_of=None, **tables: DataFrame):
        self.as_of = as_of
        for name, df in tables.items():
            setattr(self, name, df)


def symbols_with_path(graph: Graph) -> DataFrame:
    """Symbols joined with the path, language and subsystem of their file."""
    files = graph.files.select(
        "path", "language", "subsystem", *[graph.files["id"].alias("file_id")]
    )
    return graph.symbols.join(files, "file_id")
