"""Documents through quality rules, line dedup, near-dedup, benchmark decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import BATCH_BYTES, materialize
from tessera.llm.decontamination import decontaminate
from tessera.llm.line_dedup import without_repeated_lines
from tessera.llm.minhash_dedup import drop_near_duplicates
from tessera.llm.packing import best_fit_pack, cut_documents
from tessera.llm.quality import quality_filter
from tessera.llm.queries import CAPACITY, tokenizer_path



def _beside(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs, _beside(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the later one."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, _beside(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a packed sequence."""
    return best_fit_pack(materialize(cut_documents(docs, tokenizer_path(), capacity=CAPACITY), BATCH_BYTES), CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages' hashes, fingerprints and tokens can't be had in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of sf_dir, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
