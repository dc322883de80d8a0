"""The named queries of the operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import alignment, decontam, langid, lines, neardup, negatives, packing, pages, pii, quality, search, shards, toxicity

#: Key of the pseudonyms in the registered query; a deployment passes its own.
PII_KEY = "parley-query-key"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_table(spark, folder, "embeddings"))


def op2_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_recurring(_table(spark, folder, "documents"))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents")).drop("mark")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(_table(spark, folder, "pages"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary of the installed public tokenizers, the word-piece one if none is named; executors find it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = shards.shard_documents(_table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", shards.law().alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_pii_pseudonyms, op3_line_dedup, op4_near_dedup, op5_main_text, op6_decontamination, op7_language, op8_packing, op9_toxicity, op10_sharding, op11_hard_negatives, op12_quality, op13_token_alignment)}

ORACLES = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank
  FROM scored WHERE same
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, p.positive_rank,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
  WHERE p.positive_rank <= 5 AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM negatives WHERE rank <= 10
""",
}
