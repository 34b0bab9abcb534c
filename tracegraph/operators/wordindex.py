"""Stored word index of texts: distinct words, and for each word the texts that hold it.

A word is a longest run of letters, digits and underscores. A needle made of such characters
is in a text if and only if it is in one of the text's words, so substrings are looked up in
the dictionary of distinct words, which is far smaller than the texts, and the postings of the
words found give the texts. A needle with other characters is found through its longest run
and checked against the texts it can be in. Every text belongs to a ``part`` (its file, say),
by which changed texts are taken out and put back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.operators.shared import gram_candidates, materialise
from tracegraph.session import cut_lineage

RUN = r"[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))


def core_of(needle: Column) -> Column:
    """Longest run of word characters in a needle, the first of equally long ones; NULL without any."""
    runs = F.regexp_extract_all(needle, F.lit(RUN), F.lit(0))
    longest = lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best)
    return F.nullif(F.aggregate(runs, F.lit(""), longest), F.lit(""))


@dataclass
class WordIndex:
    """``postings(word, text_id, part)``, ``texts(text_id, part, text)`` and the dictionary ``words(word)``."""

    postings: DataFrame
    texts: DataFrame
    words: DataFrame

    @classmethod
    def build(cls, texts: DataFrame, text_id: str, text: str, part: str | None = None) -> WordIndex:
        """Index of every row with a text. Rows with a NULL text are in no result and are left out."""
        named = texts.select(
            F.col(text_id).alias("text_id"), (F.col(part) if part else F.lit(None).cast("string")).alias("part"), F.col(text).alias("text")
        ).filter(F.col("text").isNotNull())
        kept = cut_lineage(named)
        postings = cut_lineage(kept.select(F.explode(words_of(F.col("text"))).alias("word"), "text_id", "part"))
        return cls(postings, kept, cut_lineage(postings.select("word").distinct()))

    def save(self, path: str) -> None:
        for name in ("postings", "texts", "words"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WordIndex:
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "texts", "words")})

    def replace(self, parts: DataFrame, fresh: WordIndex) -> WordIndex:
        """The index after the texts of ``parts(part)`` are taken out and those of ``fresh`` put in.

        Only fresh texts are cut into words again. Words that no text holds any more leave the dictionary.
        """
        gone = parts.select("part").distinct()

        def swapped(old: DataFrame, new: DataFrame) -> DataFrame:
            # A NULL part has no partner and stays.
            return cut_lineage(old.join(gone, "part", "left_anti").select(*old.columns).unionByName(new.select(*old.columns)))

        postings = swapped(self.postings, fresh.postings)
        return WordIndex(postings, swapped(self.texts, fresh.texts), cut_lineage(postings.select("word").distinct()))

    def containing(self, needles: DataFrame, needle: str, text_id: str = "text_id") -> DataFrame:
        """(text_id, needle) pairs of the texts that contain a needle, each once; empty and NULL needles give none."""
        wanted, _ = materialise(
            needles.select(F.col(needle).alias("_needle")).filter(F.length("_needle") > 0).distinct().withColumn("_core", core_of(F.col("_needle")))
        )
        cores = wanted.filter(F.col("_core").isNotNull()).select("_core").distinct()
        found, _ = materialise(_word_hits(cores, self.words))
        whole = F.col("_core") == F.col("_needle")
        near = found.join(self.postings, "word").select("_core", "text_id").distinct()
        # Of needles that are one word run nothing is left to check.
        sure = wanted.filter(whole).select("_core").join(near, "_core").select("text_id", F.col("_core").alias("_needle"))
        mixed = wanted.filter(F.col("_core").isNotNull() & ~whole).join(near, "_core").select("text_id", "_needle")
        bare = gram_candidates(wanted.filter(F.col("_core").isNull()).select("_needle"), self.texts.select(F.col("text_id").alias("_hay"), F.col("text").alias("_text")))
        unsure, n = materialise(mixed.unionByName(bare.select(F.col("_hay").alias("text_id"), "_needle")))
        if n:
            checked = unsure.join(self.texts.select("text_id", "text"), "text_id").filter(F.contains("text", F.col("_needle")))
            sure = sure.unionByName(checked.select("text_id", "_needle"))
        return sure.select(F.col("text_id").alias(text_id), F.col("_needle").alias(needle))


def _word_hits(cores: DataFrame, words: DataFrame) -> DataFrame:
    """(_core, word) of the words that contain a core."""
    pairs = gram_candidates(cores.select(F.col("_core").alias("_needle")), words.select(F.col("word").alias("_hay"), F.col("word").alias("_text")))
    return pairs.filter(F.contains("_hay", F.col("_needle"))).select(F.col("_needle").alias("_core"), F.col("_hay").alias("word"))
