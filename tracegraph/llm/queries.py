"""The registered queries, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import conversations, decontaminate, exact, langid, licenses, lines, merkle, packing, pii, quality, shards, simhash, warc
from tracegraph.llm.registry import ORACLES, QUERIES, query
from tracegraph.llm.sqltext import crc32_sql, octets_sql
from tracegraph.llm.tables import table

__all__ = ["ORACLES", "QUERIES"]

def _not_fold(doc_id: str, parts: int, fold: int) -> Column:
    """Rows whose crc32 of the identifier as text leaves another remainder than ``fold``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts != fold


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept,
  sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Per document: its lines, how many are removed, and the links of its lines."""
    found = lines.similar_lines(table(spark, directory, "documents"))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("removed").alias("removed"), F.sum("links").alias("links"),
        F.min(F.when(F.col("size") > 0, F.col("class_doc"))).alias("class_id"),
    )


@query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.equal_texts(table(spark, directory, "documents"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, directory, "documents"))


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Every (document, test item) where the document holds the item."""
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Every license notice in every document."""
    return licenses.license_spans(table(spark, directory, "documents"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labelled identifiers."""
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    model = quality.fit(docs, labels, only=_not_fold("doc_id", 5, 0))
    scored = quality.score(docs, model, ["doc_id"])
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (~_not_fold("doc_id", 5, 0)).alias("held_out"), "score", predicted)


@query("op6_warc_records")
def op6_warc_records(spark: SparkSession, directory: str) -> DataFrame:
    """All pages through ARC and WARC files."""
    found = warc.archive_pages(table(spark, directory, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    return packing.pack(table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_private_surrogates")
def op8_private_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    """All documents with personal data replaced."""
    return pii.replace_private(table(spark, directory, "documents"), "tracegraph")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """Language of every document, learned from two thirds of the identifiers."""
    docs = table(spark, directory, "documents")
    model = langid.fit(docs, only=_not_fold("doc_id", 3, 1))
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (~_not_fold("doc_id", 3, 1)).alias("held_out"), "lang_pred", "score", "ambiguous")


SHARDS = 24
# The shard that comes next is put into the fourth rack, in the second region.
GROWN = shards.Leaf(region=1, rack=3, shard=SHARDS)

SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '-') AS k, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    {crc32_sql(octets_sql("coalesce(text, '')"))} AS text_crc32
  FROM documents
), draws AS (
  SELECT k, shard, substr(md5(k || ':' || shard), 1, {shards.DIGITS}) AS u
  FROM (SELECT DISTINCT k FROM d), (SELECT unnest(range({SHARDS + 1})) AS shard)
), placed AS (
  SELECT k, arg_max(shard, u) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, u) AS grown_shard FROM draws GROUP BY k
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN placed USING (k)
"""


@query("op11_sharding", SHARD_SQL)
def op11_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """Shard and slot of every document, and its shard once there is one shard more."""
    tree = shards.layout(SHARDS)
    return shards.shard_rows(table(spark, directory, "documents"), tree, [*tree, GROWN])


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return conversations.repair_report(table(spark, directory, "conversations"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.FIELDS) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# A tree per source (grp = source) and one over the sources, level by level; sides holds what lies left and right of every node.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF} AS leaf,
    CASE WHEN {crc32_sql(octets_sql("doc_id::VARCHAR"))} % 5 = 0 THEN {_LEAF.replace(_FIELD.format("text"), _FIELD.format(f"({_LOWER})"))} END AS changed
  FROM documents
), l AS (
  SELECT *, coalesce('+' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), low(grp, lvl, idx, digest, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM l
  UNION ALL
  SELECT grp, any_value(lvl) + 1, idx // 16 AS up, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY grp, idx // 16
), sub AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM low WHERE n = 1
), high(lvl, idx, digest, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 16 AS up, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY idx // 16
), nodes AS (
  SELECT grp, lvl, idx, digest FROM low WHERE n > 1 UNION ALL SELECT '/', lvl, idx, digest FROM high WHERE n > 1
), sides AS (
  SELECT grp, lvl, idx,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes WINDOW w AS (PARTITION BY grp, lvl, idx // 16 ORDER BY idx)
), walk(grp, pos, src, spot, lvl, cur, proof) AS (
  SELECT grp, pos, grp, pos, 0, coalesce(changed, leaf), '' FROM l
  UNION ALL
  SELECT w.grp, w.pos, coalesce(s.grp, '/'), coalesce(s.idx // 16, b.pos), CASE WHEN s.grp IS NULL THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN s.grp IS NULL THEN w.cur ELSE sha256(s.lft || w.cur || s.rgt) END, w.proof || coalesce(s.lft || s.rgt, '')
  FROM walk w LEFT JOIN sides s ON s.grp = w.src AND s.lvl = w.lvl AND s.idx = w.spot LEFT JOIN sub b ON b.grp = w.src
  WHERE s.grp IS NOT NULL OR w.src <> '/'
), ends AS (
  SELECT grp, pos, arg_max(cur, len) AS folded_root, sha256(arg_max(proof, len)) AS proof_sha256
  FROM (SELECT *, (CASE WHEN src = '/' THEN 1000 ELSE 0 END) + lvl AS len FROM walk) GROUP BY grp, pos
)
SELECT doc_id, leaf, subroot, digest AS root, proof_sha256, folded_root, folded_root = digest AS verified
FROM l JOIN sub USING (grp) JOIN ends ON ends.grp = l.grp AND ends.pos = l.pos JOIN (SELECT digest FROM high WHERE n = 1) ON true
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Leaf, roots and proof of every document; every fifth is checked with its text in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, directory, "documents"), F.when(drawn, lower).otherwise(F.col("text")))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")
