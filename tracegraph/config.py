"""Scoring and retrieval settings, with file overrides."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

CONFIG_ENV = "TRACEGRAPH_SCORING_CONFIG"


@dataclass(frozen=True)
class Weights:
    recency: float = 1.0
    proximity: float = 1.0
    ambiguity: float = 1.0
    coChange: float = 1.0
    subsystem: float = 1.0
    complexity: float = 1.0
    dataflow: float = 1.0


# The calibrated weights that the ranking results depend on.
CALIBRATED = Weights(
    recency=0.0766,
    proximity=0.0,
    ambiguity=0.2133,
    coChange=0.4744,
    subsystem=0.8909,
    complexity=0.1679,
    dataflow=0.0,
)


@dataclass(frozen=True)
class Matcher:
    name_match_weight: float = 3.0
    subname_match_weight: float = 1.0
    signature_match_weight: float = 2.0
    body_content_weight: float = 0.3
    import_match_weight: float = 0.5
    subwords_per_token_ceiling: int = 3
    substring_name_min_length: int = 4
    substring_name_min_symbol_length: int = 5
    substring_name_per_token_cap: int = 100
    signature_substring_min_length: int = 5
    body_content_min_length: int = 8


@dataclass(frozen=True)
class Scorer:
    calibrated_weights: Weights = CALIBRATED
    legacy_weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Augmenter:
    matcher_tail_topn_multiplier: int = 5
    matcher_tail_floor: int = 25


@dataclass(frozen=True)
class Retrieval:
    default_max_files: int = 200
    default_top_n: int = 5
    free_text_seed_cap: int = 8
    cochange_seed_topn: int = 8
    cochange_lookback_days: int = 365
    cochange_min_cooccurrences: int = 2


@dataclass(frozen=True)
class ScoringConfig:
    matcher: Matcher = field(default_factory=Matcher)
    scorer: Scorer = field(default_factory=Scorer)
    augmenter: Augmenter = field(default_factory=Augmenter)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def as_dict(self) -> dict:
        return asdict(self)


def _overlay(section, partial: dict):
    """Replace the fields named in ``partial``; unknown names are ignored."""
    known = {f.name for f in fields(section)}
    return replace(section, **{k: v for k, v in (partial or {}).items() if k in known})


def merge(partial: dict, base: ScoringConfig = ScoringConfig()) -> ScoringConfig:
    """Section-wise overlay of a partial document on the defaults."""
    weights = partial.get("scorer") or {}
    return ScoringConfig(
        matcher=_overlay(base.matcher, partial.get("matcher")),
        scorer=Scorer(
            calibrated_weights=_overlay(base.scorer.calibrated_weights, weights.get("calibrated_weights")),
            legacy_weights=_overlay(base.scorer.legacy_weights, weights.get("legacy_weights")),
        ),
        augmenter=_overlay(base.augmenter, partial.get("augmenter")),
        retrieval=_overlay(base.retrieval, partial.get("retrieval")),
    )


def load_config(path: str | None = None) -> ScoringConfig:
    """Explicit path, then the environment variable, then ./scoring-config.json, then defaults.

    A file that cannot be read or parsed is reported on stderr and ignored.
    """
    for candidate in (path, os.environ.get(CONFIG_ENV), "scoring-config.json"):
        if not candidate or not Path(candidate).exists():
            continue
        try:
            return merge(json.loads(Path(candidate).read_text(encoding="utf-8")))
        except (OSError, ValueError, AttributeError, TypeError) as err:
            print(f"scoring config {candidate} ignored: {err}", file=sys.stderr)
            break
    return ScoringConfig()
