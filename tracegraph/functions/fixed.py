"""Fixed values that results depend on, kept as plain lists."""

# File extensions per language.
TYPESCRIPT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
PYTHON_EXTENSIONS = [".py", ".pyi"]

# Directories a scan never enters.
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", "out", ".next", ".turbo",
    "coverage", "__pycache__", ".venv", "venv", "env", ".tox",
]

# English words dropped from failure texts.
STOP_WORDS = (
    "the a an is was are were when then this that for with and or but not no yes as at by in on of "
    "to from it its be been being has have had can could should would will does did do one two three "
    "which what why how where who about after before because"
).split()

# Symbol kinds a search may promote.
MATCHABLE_KINDS = ["function", "method", "class", "const", "interface", "type", "enum"]

# Largest raw value each ranking signal can take.
SIGNAL_MAX = {
    "recency": 3.0,
    "proximity": 2.5,
    "ambiguity": 1.5,
    "coChange": 3.0,
    "subsystem": 0.5,
    "complexity": 1.5,
    "dataflow": 1.5,
}

# Estimated bytes per source line.
BYTES_PER_LINE = 30
