"""Ranking signals, risk and display buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegraph.config import Weights
from tracegraph.functions.fixed import SIGNAL_MAX

SIGNALS = ["recency", "proximity", "ambiguity", "coChange", "subsystem", "complexity", "dataflow"]


def bucket(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """First step whose upper bound is not exceeded gives the score."""
    expr = None
    for limit, score in steps:
        cond = value <= limit
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    return expr.otherwise(F.lit(float(otherwise)))


def days_between(as_of: Column, when: Column) -> Column:
    """Rounded days from ``when`` to ``as_of``; halves round up, unknown dates count as 0."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / F.lit(86400e6)
    return F.coalesce(F.floor(days + 0.5), F.lit(0)).cast("int")


def recency_score(newest_days: Column, window_days: int = 90) -> Column:
    inside = newest_days.isNotNull() & (newest_days <= window_days)
    return F.when(inside, bucket(newest_days, [(7, 3), (30, 2), (90, 1)], 0)).otherwise(F.lit(0.0))


def proximity_score(distance: Column) -> Column:
    return (
        F.when(distance == 0, F.lit(2.5)).when(distance == 1, F.lit(1.0)).when(distance == 2, F.lit(0.5)).otherwise(F.lit(0.0))
    )


def ambiguity_score(n_unresolved: Column) -> Column:
    return bucket(F.coalesce(n_unresolved, F.lit(0)), [(0, 0), (1, 0.5), (3, 1)], 1.5)


def complexity_score(loc: Column) -> Column:
    grown = F.least(F.log2(loc / F.lit(20.0) + 1.0) * 0.6, F.lit(1.5))
    return F.when(loc > 0, grown).otherwise(F.lit(0.0))


def subsystem_score(mine: Column, anchor: Column) -> Column:
    return F.when(mine == anchor, F.lit(0.5)).otherwise(F.lit(0.0))


def dataflow_score(arg_hops: Column) -> Column:
    return F.least(F.coalesce(arg_hops, F.lit(0)) * 0.75, F.lit(1.5))


def cluster_weight(n_members: Column) -> Column:
    """Share of one co-change cluster; large commits count for less."""
    return F.lit(2.0) / F.log2(n_members + 1)


def weighted_sum(weights: Weights, prefix: str = "", suffix: str = "_score") -> Column:
    total = F.lit(0.0)
    for name in SIGNALS:
        total = total + F.lit(getattr(weights, name)) * F.col(f"{prefix}{column_name(name)}{suffix}")
    return total


def column_name(signal: str) -> str:
    return {"coChange": "co_change"}.get(signal, signal)


def normalised_signal(signal: str, raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / F.lit(SIGNAL_MAX[signal])))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def rationale(row: dict[str, Column]) -> Column:
    """One sentence for the strongest signal.

    ``row`` maps name, role, n_unresolved, newest_commit, newest_days and the
    six considered ``*_score`` columns.
    """
    order = ["dataflow", "co_change", "recency", "ambiguity", "proximity", "subsystem"]
    top = F.greatest(*[row[f"{s}_score"] for s in order])
    dominant = None
    for s in order:
        cond = row[f"{s}_score"] == top
        dominant = F.when(cond, F.lit(s)) if dominant is None else dominant.when(cond, F.lit(s))
    short = row["newest_commit"].substr(1, 7)
    known = row["newest_commit"].isNotNull()
    hops = F.greatest(F.lit(1), F.floor(row["dataflow_score"] / 0.75 + 0.5).cast("int"))
    role_name = (
        F.when(row["role"] == "anchor", F.lit("Anchor"))
        .when(row["role"] == "caller", F.lit("Caller of the anchor"))
        .otherwise(F.lit("Callee of the anchor"))
    )
    dash = F.lit(" — ")
    return (
        F.when(
            (dominant == "dataflow") & (row["dataflow_score"] > 0),
            F.concat(row["name"], F.lit(" reaches the anchor via "), plural(hops, "arg-binding hop"), dash,
                     F.lit("the value that surfaces at the failure originates here.")),
        )
        .when(
            (dominant == "co_change") & (row["co_change_score"] > 0) & known,
            F.concat(F.lit("Co-changed with the anchor in commit "), short, dash,
                     F.lit("the change set that introduced the failure neighborhood.")),
        )
        .when(
            (dominant == "recency") & known,
            F.concat(F.lit("Modified "), plural(row["newest_days"], "day"), F.lit(" ago in commit "), short, dash,
                     F.lit("most recent change in the failure neighborhood.")),
        )
        .when(
            (dominant == "ambiguity") & (row["n_unresolved"] > 0),
            F.concat(role_name, F.lit(" with "), plural(row["n_unresolved"], "unresolved outgoing call"), dash,
                     F.lit("a likely site for dynamic dispatch surprises.")),
        )
        .when(row["role"] == "anchor",
              F.lit("The anchor itself; no dominant external signal but it is the origin of the failure neighborhood."))
        .when(row["role"] == "caller",
              F.lit("Direct caller of the anchor; no recent changes but stays on the shortlist due to topology."))
        .otherwise(F.lit("Direct callee of the anchor; no recent changes but stays on the shortlist due to topology."))
    )


def risk_score(n_unresolved: Column, n_recent: Column, has_test: Column, distance: Column, depth: int) -> Column:
    raw = (
        F.when(n_unresolved >= 1, F.lit(0.4)).otherwise(F.lit(0.0))
        + F.least(F.lit(0.6), n_recent * F.lit(0.3))
        + F.when(has_test, F.lit(0.0)).otherwise(F.lit(0.2))
        + F.greatest(F.lit(0), F.lit(depth) - distance + 1) * F.lit(0.1)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def risk_badge(risk: Column) -> Column:
    return F.when(risk >= 0.66, F.lit("🔴 high")).when(risk >= 0.33, F.lit("🟡 mod")).otherwise(F.lit("🟢 low"))


def risk_tone(risk: Column) -> Column:
    return F.when(risk >= 0.75, F.lit("hot")).when(risk >= 0.5, F.lit("warn")).otherwise(F.lit("cool"))


def weave(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(1.0))
    return F.when(c >= 0.9, F.lit("solid")).when(c >= 0.7, F.lit("dashed")).otherwise(F.lit("dotted"))


def node_size(loc: Column, low: int = 4, high: int = 8) -> Column:
    grown = F.floor(low + F.log10(loc + 1.0) * 2 + 0.5)
    return F.when(loc > 0, F.greatest(F.lit(low), F.least(F.lit(high), grown))).otherwise(F.lit(low)).cast("int")


def tail_score(lowest: Column, matcher_score: Column) -> Column:
    return F.least(lowest - 0.01, matcher_score * 0.5)


def sigmoid(z: Column) -> Column:
    """Stable on both sides of zero."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def clamp_max_symbols(value: Column, low: int = 50, high: int = 5000, fallback: int = 800) -> Column:
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), value)), F.lit(fallback)).cast("int")
