"""Path expressions: language, tests, ignore rules, candidates for imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegraph.functions.fixed import IGNORED_DIRS, PYTHON_EXTENSIONS, TYPESCRIPT_EXTENSIONS

SOURCE_SUFFIX = r"\.(?:js|mjs|cjs|jsx|ts|tsx|mts|cts)$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(TYPESCRIPT_EXTENSIONS), F.lit("typescript"))
        .when(ext.isin(PYTHON_EXTENSIONS), F.lit("python"))
        .otherwise(F.lit("unparsed"))
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_test_path(path: Column) -> Column:
    in_dir = path.rlike(r"(?i)(^|/)(tests?|__tests__)/")
    in_name = basename(path).rlike(r"(?i)([._-]test|[._-]spec|test_)")
    return in_dir | in_name


def is_test_file_name(path: Column) -> Column:
    """The narrow rule the anchor fallback uses."""
    return path.rlike(r"\.test\.|\.spec\.")


def in_ignored_dir(path: Column) -> Column:
    dirs = F.split(dirname(path), "/")
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_safe_relative(path: Column) -> Column:
    """No null byte, not absolute, no step outside the root."""
    return ~(path.contains("\u0000") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"))


def normalize(path: Column) -> Column:
    """Resolve '.' and '..' segments of a relative path inside one expression."""
    start = F.array().cast("array<string>")

    def step(acc, seg):
        last = F.try_element_at(acc, F.lit(-1))
        can_pop = last.isNotNull() & (last != "..")
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when((seg == "..") & can_pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def join_path(directory: Column, rest: Column) -> Column:
    return normalize(F.when(directory == "", rest).otherwise(F.concat_ws("/", directory, rest)))


# What is put after a module's path to find its file, best first.
MODULE_SUFFIXES = {
    "python": [".py", "/__init__.py"],
    "typescript": [*TYPESCRIPT_EXTENSIONS, *["/index" + e for e in TYPESCRIPT_EXTENSIONS]],
    "init": [".py"],
}


def module_suffixes(family: Column) -> Column:
    """Suffixes of a module family as an array."""
    chosen = F.lit(None).cast("array<string>")
    for name, suffixes in MODULE_SUFFIXES.items():
        chosen = F.when(family == name, F.array(*[F.lit(s) for s in suffixes])).otherwise(chosen)
    return chosen


def modules_of(path: Column) -> Column:
    """Array of (family, base, suffix_rank): the modules a file can stand for."""
    arms = [
        F.when(path.endswith(s), F.struct(F.lit(name).alias("family"), F.substring(path, F.lit(1), F.length(path) - len(s)).alias("base"), F.lit(i).alias("suffix_rank")))
        for name, suffixes in MODULE_SUFFIXES.items() for i, s in enumerate(suffixes)
    ]
    return F.filter(F.array(*arms), lambda m: m.isNotNull())


def repo_id(real_path: Column) -> Column:
    return F.substring(F.sha2(real_path, 256), 1, 16)


def estimated_loc(n_bytes: Column) -> Column:
    from tracegraph.functions.fixed import BYTES_PER_LINE

    return F.greatest(F.lit(1), F.floor(n_bytes / BYTES_PER_LINE + 0.5).cast("int"))


def prefixes(path: Column) -> Column:
    """Every leading directory of a path, shortest first."""
    parts = F.split(path, "/")
    n_dirs = F.size(parts) - 1
    steps = F.when(n_dirs > 0, F.sequence(F.lit(1), n_dirs)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
