"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import perspective_turns
from tessera.llm.common import BATCH_BYTES, materialize
from tessera.llm.decontamination import contaminated
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.packing import best_fit_pack, cut_documents
from tessera.llm.quality import quality_scores
from tessera.llm.secrets import BASE, find_secrets, spans_text
from tessera.llm.spelling import spelling_variants
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.token_output import pack_token_ids
from tessera.llm.toxicity import score_toxicity, train_toxicity

CAPACITY = 4096

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (ORDER BY conv_id, turn, role, text) AS k FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
named AS (
  SELECT t.conv_id, perspective, turn, k, text,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named),
rendered AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY k) AS BIGINT) AS "end" FROM rendered)
SELECT conv_id, perspective, turn, role, name, segment, "end" - length(segment) AS start, "end",
       CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN "end" END AS mask_end
FROM placed
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the named public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def line_dedup_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def substring_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"), window=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspective_turns(_table(spark, sf_dir, "conversations"))


def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_token_ids(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=CAPACITY)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = materialize(cut_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=CAPACITY), BATCH_BYTES)
    return best_fit_pack(cut, CAPACITY)


def spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), least_length=5, least_count=3, thin=97)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels").where(fold != 2))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, t.vec_id AS id, a.label = t.label AS same, CAST(list_inner_product(a.e, t.e) AS BIGINT) AS score
  FROM v a JOIN v t ON a.vec_id <> t.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def queries():
    return {
        "op1_benchmark_decontamination": benchmark_decontamination,
        "op2_line_dedup": line_dedup_patience,
        "op3_minhash_near_dedup": minhash_near_dedup,
        "op4_secret_scans": secret_scans,
        "op5_substring_dedup": substring_dedup_words,
        "op6_suffix_array_dedup": suffix_array_dedup,
        "op7_quality_rules": quality_rules,
        "op8_chat_formatting": chat_formatting,
        "op9_token_id_output": token_id_output,
        "op10_best_fit_packing": best_fit_packing,
        "op11_spelling_variants": spelling_variant_grouping,
        "op12_toxicity": toxicity,
        "op13_hard_negatives": hard_negative_mining,
    }


def oracle_sql():
    return {"op8_chat_formatting": CHAT_SQL, "op13_hard_negatives": NEGATIVES_SQL}
