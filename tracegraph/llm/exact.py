"""Exact de-duplication by sorting contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegraph.llm.tables import HOT_SHARE, hot_counts, quoted, saved

# What normalisation deletes: the characters [\x20\x09-\x0D].
DELETED = " \n\t\r\x0b\x0c"
# Characters of the normalised text at the front of a sort key.
PREFIX = 24


def normalised(text: Column | str) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for character in DELETED:
        out = F.replace(out, F.lit(character), F.lit(""))
    return out


def _sorted_groups(docs: DataFrame, text: str, doc_id: str, share: float, total: int, carried: list[Column]) -> DataFrame:
    """Rows with their place among adjacent equal texts.

    Ranges of (text prefix, text hash, piece) are cut at sampled splitters and sorted
    externally; the window then walks over neighbours and compares whole texts.
    A text with more than ``share`` of the rows is cut into pieces by identifier, so
    no range has to hold it whole. The hash and prefix only order the rows; equality
    is decided on the text.
    """
    keyed = docs.select(
        F.col(doc_id).alias("_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_points"),
        normalised(text).alias("_norm"), *carried,
    ).withColumn("_hash", F.xxhash64("_norm"))
    hot = hot_counts(keyed.select("_hash"), "_hash", total, share)
    piece = F.pmod(F.xxhash64("_id", "_points"), F.coalesce(F.col("pieces"), F.lit(1)))
    ranged = (
        keyed.join(F.broadcast(hot), "_hash", "left")
        .withColumn("_hot", F.col("pieces").isNotNull())
        .withColumn("_piece", piece.cast("int"))
        .withColumn("_prefix", F.substring("_norm", 1, PREFIX))
        .drop("pieces")
        .repartitionByRange("_prefix", "_hash", "_piece")
    )
    # _hot depends on _hash; as a key it lets a filter on it reach the scan.
    equal = Window.partitionBy("_hot", "_prefix", "_hash", "_piece", "_norm").orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.withColumns({
        "_rank": F.row_number().over(equal),
        "_first": F.first("_id").over(whole),
        "_size": F.count(F.lit(1)).over(whole).cast("long"),
    })


def equal_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = HOT_SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after white space is deleted. Of equal
    texts the one with the most code points before that stays, then the smallest
    identifier; a missing identifier comes last. Null and empty texts form one group.
    Rows that repeat an identifier count as rows of their own in ``group_size``;
    exactly one of them is kept. Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    groups = _sorted_groups(docs, text, doc_id, share, docs.count(), [])
    # Only the first row of a piece of a hot text keeps the text: 1 / share rows at most.
    local = saved(
        groups.select(
            "_id", "_first", "_size", "_rank", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), "_hash", "_piece", "_points", "_hot",
            F.when(F.col("_hot") & (F.col("_rank") == 1), F.col("_norm")).alias("_hot_text"),
        ),
        "equal",
    )
    leaders = local.filter(F.col("_hot_text").isNotNull())
    same = Window.partitionBy("_hot_text")
    best = same.orderBy(F.desc("_points"), F.asc_nulls_last("_first"), "_piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = leaders.select(
        F.col("text_sha256").alias("_sha"), F.col("_piece").alias("_at"), F.first("_first").over(best).alias("_keep"),
        F.first("_piece").over(best).alias("_keep_piece"), F.sum("_size").over(same).alias("_all"),
    )
    joined = local.join(
        F.broadcast(merged), F.col("_hot") & (F.col("text_sha256") == F.col("_sha")) & (F.col("_piece") == F.col("_at")), "left"
    )
    is_merged = F.col("_sha").isNotNull()
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.when(is_merged, F.col("_keep")).otherwise(F.col("_first")).alias("keep_id"),
        F.when(is_merged, F.col("_all")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_rank") == 1) & (~is_merged | (F.col("_piece") == F.col("_keep_piece")))).alias("kept"),
        "text_sha256",
    )


def drop_equal(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = HOT_SHARE) -> DataFrame:
    """The rows that stay, with the columns they came with.

    The same choice as ``equal_texts``; of rows that agree in identifier and text
    exactly one stays.
    """
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("_row")
    groups = _sorted_groups(docs, text, doc_id, share, docs.count(), [row]).filter(F.col("_rank") == 1)
    again = Window.partitionBy("_norm").orderBy(F.desc("_points"), F.asc_nulls_last("_id"), "_piece")
    # The pieces of hot texts have 1 / share first rows at most.
    hot = groups.filter("_hot").withColumn("_rank", F.row_number().over(again)).filter(F.col("_rank") == 1)
    return groups.filter(~F.col("_hot")).select("_row.*").unionByName(hot.select("_row.*"))
