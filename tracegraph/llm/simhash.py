"""Near-duplicates by fingerprints that differ in at most two bits."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.components import components
from tracegraph.llm.tables import map_texts, quoted, saved, without
from tracegraph.operators.shared import salted_join

SHINGLE = 3
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority vote of the shingles' hashes, bit by bit; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first[at : at + BLOCK], last[at : at + BLOCK])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def compute(texts):
        return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("_t")), ["doc_id"], "_t", compute, "fp long")


# Two words of 32 bits each. Of two differing bits either the low half holds at most
# one, or it holds both and the high halves are equal.
HALF = 32
EXACT_HIGH = 32
# Buckets up to this size are compared pair by pair; larger ones by a second index.
PAIRWISE = 256


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, HALF)


def _without(half: Column, *positions: Column) -> Column:
    for p in positions:
        half = half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))))
    return half


def variants(distinct: DataFrame) -> DataFrame:
    """(slot, value, fp): 32 one-wildcard variants of the low half and the high half itself."""
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(EXACT_HIGH))).alias("slot"))
    value = F.when(F.col("slot") == EXACT_HIGH, _high(F.col("fp"))).otherwise(_without(_low(F.col("fp")), F.least("slot", F.lit(31))))
    return rows.select(F.col("slot").cast("int").alias("slot"), value.alias("value"), "fp")


def _pairs(crowd: DataFrame) -> DataFrame:
    """Verified pairs inside small buckets, each pair once."""
    left = crowd.select("slot", "value", F.col("fp").alias("a"))
    right = crowd.select(F.col("slot").alias("s"), F.col("value").alias("w"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low, slot = _low(differ), F.col("slot")
    own_slot = F.when(slot == EXACT_HIGH, F.bit_count(low) == 2).otherwise(
        F.when(low == 0, slot == 0).otherwise(low == F.call_function("shiftleft", F.lit(1).cast("long"), slot))
    )
    rule = (slot == F.col("s")) & (F.col("value") == F.col("w")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= 2) & own_slot
    return left.join(right, rule).select("a", "b")


def _stars(crowd: DataFrame) -> DataFrame:
    """Links inside large buckets without pairs.

    Fingerprints that agree once two chosen bits are masked are all within distance
    two, so each is linked to the smallest of them. Masks: one bit of each half, or two
    bits of one half where the other half is equal.
    """
    wild = crowd.filter(F.col("slot") < EXACT_HIGH).select("fp", "slot", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    one_each = wild.select("fp", F.col("slot").alias("i"), (F.col("j") + 32).alias("j"))
    two = F.explode(F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> struct(i, j))))")).alias("m")
    high = crowd.filter(F.col("slot") < EXACT_HIGH).select("fp").distinct().select("fp", two).select("fp", (F.col("m.i") + 32).alias("i"), (F.col("m.j") + 32).alias("j"))
    low = crowd.filter(F.col("slot") == EXACT_HIGH).select("fp").distinct().select("fp", two).select("fp", F.col("m.i").alias("i"), F.col("m.j").alias("j"))
    masked = one_each.unionByName(high).unionByName(low).withColumn("masked", _without(F.col("fp"), F.col("i"), F.col("j")))
    keys = ["i", "j", "masked"]
    least = masked.groupBy(*keys).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return masked.hint("merge").join(least, keys).filter("fp <> a").select("a", F.col("fp").alias("b"))


def buckets(distinct: DataFrame) -> DataFrame:
    """The variants that two fingerprints or more share, with ``n``, how many do.

    Spark judges variants by the bytes of the fingerprints they are unfolded from, a 33rd of their
    own, so they join by shuffle: a broadcast would bring all of them to the driver.
    """
    index = variants(distinct)
    sizes = index.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return index.hint("merge").join(sizes, ["slot", "value"])


def links(distinct: DataFrame, pairwise: int = PAIRWISE, rows: int | None = None) -> DataFrame:
    """Links between distinct fingerprints whose components are those of distance two.

    ``pairwise`` chooses between two exact ways; no link is lost at any bucket size.
    ``rows``, if known, is how many fingerprints there are at most.
    """
    # A few files hold many fingerprints; each becomes 33 rows, so they are dealt out first.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowd = saved(buckets(distinct.repartition(tasks, "fp")), "buckets", rows and 33 * rows)
    return _pairs(crowd.filter(F.col("n") <= pairwise)).unionByName(_stars(crowd.filter(F.col("n") > pairwise)).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pairwise: int = PAIRWISE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without white space, A-Z in lower case; shingles are three words,
    repeats included. Texts with fewer words are one shingle; null, empty and blank texts
    have fingerprint zero and are linked like any other. ``component_id`` is the smallest
    doc_id that can be reached over links, itself included; rows without an identifier
    take part, and get null where a component has none at all. Rows that share an
    identifier get one row each. Other columns are ignored.
    """
    prints = saved(fingerprints(docs, text, doc_id), "fingerprints")
    rows = prints.count()
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", rows)
    roots = components(links(distinct.select("fp"), pairwise, rows), rows)
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    assigned = placed.join(named, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return salted_join(prints, assigned, ["fp"]).select("doc_id", digits.alias("fingerprint"), "component_id")


def near_duplicate_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id) of the documents that are not the smallest of their component."""
    return near_duplicates(docs, text, doc_id).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with the smallest identifier of their component, all columns unchanged.

    Rows that share an identifier are one document and stay or go together; rows without
    one stay.
    """
    return without(docs, doc_id, near_duplicate_ids(docs, text, doc_id))
