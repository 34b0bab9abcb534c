"""Ranking quality: gold ranks, hit rates, correlations, fitting of the weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.config import Weights
from tracegraph.functions import signals

SIGNAL_COLUMNS = [f"{signals.column_name(s)}_score" for s in signals.SIGNALS]


def gold_ranks(rows: DataFrame, score: Column, entry: str = "entry_id") -> DataFrame:
    """Rank of the labelled candidate per entry when candidates are ordered by ``score``.

    Counts the candidates that come before the best gold row instead of
    sorting an entry, so long candidate lists need no window.
    """
    scored = rows.withColumn("_s", score)
    order = F.struct((-F.col("_s")).alias("a"), F.col("candidate_rank").alias("b"))
    gold = scored.filter(F.col("label") == 1).groupBy(entry).agg(F.min(order).alias("_gold"))
    before = scored.withColumn("_o", order).join(gold, entry).filter(F.col("_o") <= F.col("_gold"))
    return before.groupBy(entry).agg(F.count(F.lit(1)).alias("rank"))


def rank_metrics(ranks: DataFrame, n_entries: Column) -> DataFrame:
    """hit@1, hit@5 and mean reciprocal rank over ``n_entries`` entries; entries without gold are misses."""
    total = n_entries.cast("double")
    return ranks.agg(
        F.count(F.lit(1)).alias("n_found"),
        (F.count_if(F.col("rank") == 1) / total).alias("top1"),
        (F.count_if(F.col("rank") <= 5) / total).alias("top5"),
        (F.sum(1.0 / F.col("rank")) / total).alias("mrr"),
    )


def truncated_mrr(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Mean over entries of 1 / rank, 0 beyond rank ``k``; ``ranks(entry_id, rank)`` with NULL for a miss."""
    reciprocal = F.when((F.col("rank") >= 1) & (F.col("rank") <= k), 1.0 / F.col("rank")).otherwise(F.lit(0.0))
    hit = lambda n: F.avg(F.when(F.col("rank").between(1, n), 1.0).otherwise(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n"), hit(1).alias("top1"), hit(5).alias("top5"), F.avg(reciprocal).alias("mrr"))


def rank_buckets(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    bucket = F.when(r == 1, "1").when(r.between(2, 5), "2-5").when(r.between(6, 10), "6-10").otherwise("miss")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def pearson(rows: DataFrame, columns: list[str] = SIGNAL_COLUMNS, label: str = "label") -> DataFrame:
    """Correlation of every signal with the label; NULL without variance. One pass, one row per signal."""

    def r(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col(label).cast("double")
        n = F.count(F.lit(1))
        cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
        vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
        eps = F.lit(1e-12)
        return F.when((n >= 2) & (vx > eps) & (vy > eps), F.try_divide(cov, F.sqrt(vx * vy)))

    wide = rows.agg(*[r(c).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("r")) for c in columns])).alias("s")).select("s.*")


def in_training(entry: Column, share: float = 0.8, seed: int = 42) -> Column:
    """Stable entry-level split by a hash that every engine has."""
    digest = F.md5(F.concat_ws(":", entry.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < int(share * 1000)


def fit_weights(rows: DataFrame, columns: list[str] = SIGNAL_COLUMNS, max_iter: int = 200, tol: float = 1e-6, penalty: float = 1e-4):
    """Logistic regression of the label on the signals; returns (weights, bias, iterations).

    Every iteration is an aggregate over all rows, whatever their number. A small
    ``penalty`` keeps the weights finite where the signals separate the labels.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    typed = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("label").cast("double").alias("label"))
    counted = typed.groupBy(*columns, "label").agg(F.count(F.lit(1)).cast("double").alias("m"))
    counted = VectorAssembler(inputCols=columns, outputCol="signals").transform(counted)
    if counted.isEmpty():
        return [1.0] * len(columns), 0.0, 0
    model = LogisticRegression(
        featuresCol="signals", weightCol="m", family="binomial", standardization=False, regParam=penalty, maxIter=max_iter, tol=tol
    ).fit(counted)
    return [float(w) for w in model.coefficients], float(model.intercept), int(model.summary.totalIterations)


def clip(weights: list[float]) -> list[float]:
    """Production weights: a signal may only help."""
    return [max(0.0, w) for w in weights]


def dot(columns: list[str], weights: list[float], bias: float = 0.0) -> Column:
    total = F.lit(bias)
    for c, w in zip(columns, weights):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def compare_configs(rows: DataFrame, configs: dict[str, Weights], entry: str = "entry_id") -> DataFrame:
    """Rank metrics of several weight sets in one pass over the rows."""
    variants = F.array(
        *[
            F.struct(F.lit(name).alias("config"), dot(SIGNAL_COLUMNS, [getattr(w, s) for s in signals.SIGNALS]).alias("score"))
            for name, w in configs.items()
        ]
    )
    scored = rows.select(entry, "candidate_rank", "label", F.explode(variants).alias("v")).select(
        F.struct(F.col("v.config").alias("config"), F.col(entry).alias("entry")).alias("key"), "candidate_rank", "label", F.col("v.score").alias("score")
    )
    ranks = gold_ranks(scored, F.col("score"), "key")
    n = rows.select(F.count_distinct(entry)).scalar().cast("double")
    return ranks.groupBy(F.col("key.config").alias("config")).agg(
        (F.count_if(F.col("rank") == 1) / n).alias("top1"), (F.count_if(F.col("rank") <= 5) / n).alias("top5"),
        (F.sum(1.0 / F.col("rank")) / n).alias("mrr"),
    )


def keep_or_discard(before: dict[str, float], after: dict[str, float], target: str = "text", gain: float = 0.01, loss: float = 0.02) -> bool:
    """Keep a change when the target mode gains a point and no other mode loses two."""
    if after[target] - before[target] < gain:
        return False
    return all(before[m] - after[m] <= loss for m in before if m != target)
