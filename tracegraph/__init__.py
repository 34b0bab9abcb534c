"""tracegraph: code-graph analytics and root-cause ranking as Spark jobs."""

from tracegraph.api import CodeGraph
from tracegraph.config import ScoringConfig, load_config

__all__ = ["CodeGraph", "ScoringConfig", "load_config"]
