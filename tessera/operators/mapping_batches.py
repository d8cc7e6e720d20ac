"""Mappings applied in batches that can be previewed and taken back one by one.

The domain's table is never rewritten.  A ledger, partitioned by batch, has the terms that each batch gave a target; the table as
it is now is its rows with the targets of the batches in force over the unmapped ones.  So a rollback restores exactly what
its batch changed, in whatever order batches are taken back, and rewrites one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.mapping import DECIDED, apply_mappings, consensus, mapped_terms, redundant, warnings
from tessera.sources.cdm import DOMAINS, Cdm
from tessera.sources.scratch import written

#: Ids and terms that are broadcast, at about 64 bytes each.
BROADCAST_ROWS = 1 << 18
LEDGER = "source_value string, previous_concept_id long, new_concept_id long, n_rows long, rolled_back boolean, batch string"


def agreed(decisions: DataFrame, users: int = 2) -> DataFrame:
    """The latest decision of each term and target that so many users approved, as decisions."""
    # pairs of too few decisions go before users are told apart: where most do, only a hash of them is shuffled
    yes, pair = decisions.where(F.col("action").isin(*DECIDED)), F.xxhash64("source_value", "target_concept_id")
    often = yes.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).where(F.col("n") >= users).select("pair")
    some = yes.withColumn("pair", pair).join(_few(often), "pair", "left_semi")
    return decisions.join(_few(consensus(some, users).select("decision_id")), "decision_id", "left_semi")


def _few(rows: DataFrame) -> DataFrame:
    """rows, written and counted; broadcast where they are few, so that what meets them is not shuffled."""
    rows = written(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _met(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of few terms; all rows where the terms are many and would cost more than they save."""
    terms = written(terms)
    return rows.join(F.broadcast(terms), "source_value", "left_semi") if terms.count() <= BROADCAST_ROWS else rows


def effective(cdm: Cdm, domain: str, decisions: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Decisions on terms that aren't in the data as decided already."""
    return decisions.where(F.col("action").isin(*DECIDED)).join(redundant(cdm, domain, decisions, mapped), "source_value", "left_anti")


def preview(cdm: Cdm, domain: str, decisions: DataFrame) -> DataFrame:
    """One row: what applying decisions would do.

    total_decisions, n_codes and n_redundant terms; rows and persons with these codes; codes with each warning, with any, and
    n_pushable_codes, those without.
    """
    # decisions and what the data has of their terms are worked out once each; all else is made from them
    decisions = written(decisions)
    mapped = written(_met(mapped_terms(cdm, domain), decisions.select("source_value").distinct()))
    useful = written(effective(cdm, domain, decisions, mapped))
    codes = _few(useful.select("source_value").distinct())
    warned = warnings(cdm, domain, useful, mapped)
    rows = cdm.events(domain).join(codes, "source_value", "left_semi").agg(F.count("*").alias("impacted_rows"), F.countDistinct("person_id").alias("impacted_persons"))
    n = lambda kind: F.count(F.when(F.col("warning") == kind, 1))
    flags = warned.agg(n("several targets").alias("n_several_targets"), n("already mapped").alias("n_already_mapped"), n("several concepts").alias("n_several_concepts"), F.countDistinct("source_value").alias("n_flagged"))
    counts = useful.agg(F.count("*").alias("total_decisions"), F.countDistinct("source_value").alias("n_codes"))
    gone = redundant(cdm, domain, decisions, mapped).agg(F.count("*").alias("n_redundant"))
    return counts.crossJoin(gone).crossJoin(rows).crossJoin(flags).withColumn("n_pushable_codes", F.col("n_codes") - F.col("n_flagged"))


class Ledger:
    """The batches applied to one domain of a model; path is a folder of Parquet partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def start(self) -> Ledger:
        self._write(self.spark.createDataFrame([], LEDGER))
        return self

    def current(self, cdm: Cdm, domain: str) -> Cdm:
        """The model with the targets of all batches in force in the domain's table."""
        force = self.rows().where("not rolled_back and source_value is not null").select("source_value", F.col("new_concept_id").alias("target_concept_id"))
        return Cdm({**cdm.tables, DOMAINS[domain].table: apply_mappings(cdm, domain, force)}, cdm.as_of)

    def apply(self, cdm: Cdm, domain: str, decisions: DataFrame, batch: str) -> DataFrame:
        """Put a new batch in force: the decided terms that are unmapped as things are now and have one target; its rows."""
        if self.rows().where(F.col("batch") == batch).limit(1).count():
            raise ValueError(f"there is a batch {batch} already")
        now = self.current(cdm, domain)
        decisions = written(decisions.where(F.col("action").isin(*DECIDED)).select("source_value", "target_concept_id", "action", "synced"))
        # one pass over the data gives all that is asked of the decided terms
        some = _met(now.events(domain), decisions.select("source_value").distinct())
        concept = F.when(F.col("concept_id") > 0, F.col("concept_id"))
        before = written(some.groupBy("source_value").agg(F.min(concept).alias("a"), F.max(concept).alias("b"), F.max("concept_id").cast("long").alias("previous_concept_id"), F.count("*").alias("n_rows")))
        mapped = before.where("a is not null").select("source_value", "a", "b")
        useful = written(effective(now, domain, decisions, mapped))
        push = useful.join(warnings(now, domain, useful, mapped).select("source_value").distinct(), "source_value", "left_anti")
        push = push.groupBy("source_value").agg(F.max("target_concept_id").cast("long").alias("new_concept_id"))
        rows = push.join(before, "source_value").select("source_value", "previous_concept_id", "new_concept_id", "n_rows", F.lit(False).alias("rolled_back"), F.lit(batch).alias("batch"))
        # a row without term says that there is the batch, be it empty
        self._write(rows.unionByName(self.spark.createDataFrame([(None, None, None, 0, False, batch)], LEDGER)))
        return self.terms(batch)

    def terms(self, batch: str) -> DataFrame:
        """What a batch gave a target."""
        return self.rows().where((F.col("batch") == batch) & F.col("source_value").isNotNull())

    def roll_back(self, batch: str) -> DataFrame:
        """Take a batch out of force; its rows.  Only its partition is written."""
        rows = self.rows().where((F.col("batch") == batch) & ~F.col("rolled_back"))
        held = rows.select("source_value", "previous_concept_id", "new_concept_id", "n_rows", F.lit(True).alias("rolled_back"), "batch")
        held = written(held)  # a partition can't be read while it is overwritten
        if not held.limit(1).count():
            raise ValueError(f"there is no batch {batch} in force")
        self._write(held)
        return self.terms(batch)
