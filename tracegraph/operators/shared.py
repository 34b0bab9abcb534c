"""Building blocks: top-k per key, first row per key, hot-key joins, substring and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.session import cut_lineage

# A key holding more than this share of a table is joined salted. At most
# 1 / HOT_SHARE keys can exceed it, which bounds the broadcast list of hot keys.
HOT_SHARE = 0.001
SALTS = 32


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in a total order.

    Spark keeps k rows per key and task before the shuffle, so a hot key
    arrives at its task already reduced.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window).cast("long")).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One whole row per key: the smallest by ``order``. Combines before the shuffle."""
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest) if rest else F.lit(1), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ordering)])).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: never more than 1 / share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("_n") > F.greatest(total * F.lit(share), F.lit(10000))).select(*keys)


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join where a key may hold a large part of ``many``.

    Rows of hot keys on the ``many`` side are spread over ``salts`` tasks; the
    matching rows of ``few`` are repeated that often. Other keys keep salt 0.
    ``how`` is seen from ``many``: inner or left.
    """
    hot = F.broadcast(hot_keys(many, keys).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(salts)).cast("int")
    left = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by their keys, however few bytes they have.

    For rows that a join unfolds or that cost much each: adaptive execution judges them by their bytes
    and puts them into one task, and rows of one file stay in one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """Write a frame to the checkpoint folder and count it.

    Joined later, it is broadcast if its bytes are below Spark's threshold, and shuffled
    with hot keys split by adaptive execution beyond.
    """
    kept = cut_lineage(df)
    return kept, kept.count()


# Needle lengths and the gram that indexes them; a needle is found through its
# first gram, so the gram is never longer than the needle.
GRAM_CLASSES = [(8, None, 8), (4, 8, 4), (2, 4, 2), (1, 2, 1)]


def gram_candidates(needles: DataFrame, source: DataFrame) -> DataFrame:
    """(_hay, _needle) pairs whose text holds the needle's first gram; ``needles(_needle)`` distinct, ``source(_hay, _text)``.

    A gram class without needles costs no pass over the texts.
    """
    size = F.length("_needle")
    in_class = [size >= low if high is None else (size >= low) & (size < high) for low, high, _ in GRAM_CLASSES]
    present = needles.agg(*[F.count_if(c) for c in in_class]).first()
    candidates = source.select("_hay", F.lit(None).cast("string").alias("_needle")).limit(0)
    for condition, (_, _, gram), count in zip(in_class, GRAM_CLASSES, present):
        if not count:
            continue
        wanted = needles.filter(condition).withColumn("_gram", F.substring("_needle", 1, gram))
        # A look-ahead yields the gram at every position in one scan of the text.
        every_gram = F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1))
        grams = source.select("_hay", F.explode(F.array_distinct(every_gram)).alias("_gram"))
        candidates = candidates.unionByName(grams.join(wanted, ["_gram"]).select("_hay", "_needle"))
    return candidates


def substring_join(needles: DataFrame, needle: str, hay: DataFrame, hay_id: str, text: str) -> DataFrame:
    """(hay_id, needle) pairs where the text contains the needle, without comparing all pairs.

    For short texts: they are cut into the grams of each length class, joined on the
    needle's first gram, and every surviving pair is checked against the text. Long
    texts are searched through ``wordindex.WordIndex``.
    """
    distinct, _ = materialise(
        needles.select(F.col(needle).alias("_needle")).filter(F.length("_needle") > 0).distinct()
    )
    source = hay.select(F.col(hay_id).alias("_hay"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return (
        gram_candidates(distinct, source).join(source, "_hay")
        .filter(F.contains("_text", F.col("_needle")))
        .select(F.col("_hay").alias(hay_id), F.col("_needle").alias(needle))
    )


LINE_BIN = 32


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str],
                 width: int = LINE_BIN) -> DataFrame:
    """Pairs with equal keys whose line ranges overlap; each pair once.

    Both ranges are cut into bins of ``width`` lines, so a large file spreads
    over many join keys. A pair is kept in the first bin it shares.
    """
    (ls, le), (rs, re_) = left_range, right_range

    def binned(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
        bins = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return df.withColumn(first, lo).withColumn("_bin", F.explode(bins))

    a = binned(left, ls, le, "_first_left")
    b = binned(right, rs, re_, "_first_right")
    joined = a.join(b, [*keys, "_bin"])
    keep = (F.col("_bin") == F.greatest("_first_left", "_first_right")) & (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    return joined.filter(keep).drop("_bin", "_first_left", "_first_right")
