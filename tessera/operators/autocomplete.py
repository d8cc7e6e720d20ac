"""Autocomplete of source values by what their value, name or code begins with.

The index has a row for each text of a source value: its folded key (case and accents aside), sorted, in files of key ranges.
So `startswith` is a range that Parquet's statistics answer: a search opens the files and row groups whose keys can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import folded
from tessera.operators.vocabulary import source_values
from tessera.sources.cdm import Cdm
from tessera.sources.scratch import shared_folder, written

ROWS_A_FILE = 1_000_000


def completion_index(cdm: Cdm, path: str | None = None) -> DataFrame:
    """Write the index of all source values, and read it: (key, kind) before the columns of source_values().

    kind is value, name or code; codes are those of the Drug domain.
    """
    rows = written(source_values(cdm))  # counted, ranged and indexed below: three times
    texts = [("value", F.col("source_value")), ("name", F.col("source_name")), ("code", F.when(F.col("domain") == "Drug", F.col("source_atc")))]
    keyed = rows.select("*", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), folded(text).alias("key")) for kind, text in texts])).alias("x")).where("x.key is not null")
    keyed = keyed.select("x.key", "x.kind", *rows.columns)
    path = path or shared_folder(rows.sparkSession)
    files = max(1, keyed.count() // ROWS_A_FILE)
    keyed.repartitionByRange(files, "key", "kind", "source_value").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(keyed.schema).parquet(path)


def _begins(text: str) -> Column:
    """The key begins with text; as a literal, so that it reaches the scan."""
    plain = _folded(text)
    return F.col("key").startswith(plain)


def _folded(text: str) -> str:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return spark.range(1).select(folded(F.lit(text)).alias("x")).first()["x"]


def _hits(index: DataFrame, text: str, domain: str | None, columns: list[str]) -> DataFrame:
    rows = index.where(_begins(text))
    if domain:
        rows = rows.where(F.col("domain") == domain)
    return rows.select(*columns).distinct()


def of_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the source values of a page of completions, before they are ranked."""
    return rows.join(F.broadcast(found.select("source_value").distinct()), "source_value", "left_semi")


def with_pending(found: DataFrame, cdm: Cdm, decided: DataFrame) -> DataFrame:
    """found with pending: an unmapped value gets the target of its decision (source_value, target_concept_id), and is pending."""
    names = cdm.table("concept").select(F.col("concept_id").alias("target_concept_id"), F.struct("concept_id", "concept_name", "vocabulary_id", "standard_concept").alias("t"))
    target = decided.select("source_value", "target_concept_id").join(names, "target_concept_id").select("source_value", "t")
    rows = found.join(target, "source_value", "left").withColumn("pending", F.coalesce(F.col("concept_id"), F.lit(0)).eqNullSafe(0) & F.col("t").isNotNull())
    return rows.select(*[F.when(F.col("pending"), F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) if c in ("concept_id", "concept_name", "vocabulary_id", "standard_concept") else F.col(c) for c in found.columns], "pending")


def complete(index: DataFrame, text: str, domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The most frequent source values with a text that begins with `text`, with total, the number of all that do."""
    columns = [c for c in index.columns if c not in ("key", "kind")]
    rows = _hits(index, text, domain, columns)
    order = [F.desc("n_records"), "domain", "source_value", "source_name", "source_atc", "concept_id"]
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def complete_fast(index: DataFrame, text: str, domain: str | None = None, limit: int = 20) -> DataFrame:
    """Only the distinct (domain, source_value, source_name, source_atc), first in that order; nothing for under two letters."""
    columns = ["domain", "source_value", "source_name", "source_atc"]
    rows = _hits(index, text, domain, columns)
    return rows.where(F.lit(len(text) >= 2)).orderBy(*columns).limit(limit)
