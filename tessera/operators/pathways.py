"""Treatment pathways: eras, steps, sequences and their prefix tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cohort import concept_events
from tessera.sources.cdm import Cdm


def pathway_events(cdm: Cdm, target: DataFrame, event_cohorts: list[dict]) -> DataFrame:
    """(person_id, event_name, event_start, event_end) of the target's events inside their observation periods."""
    period = cdm.table("observation_period").join(target.select("person_id").distinct(), "person_id", "left_semi")
    parts = []
    for e in event_cohorts:
        rows = concept_events(cdm, {"domain": e["domain"], "concepts": e.get("concept_ids", []), "include_descendants": e.get("include_descendants", True), "source_codes": e.get("source_codes", [])})
        parts.append(rows.select("person_id", F.lit(e["name"]).alias("event_name"), F.col("event_date").alias("event_start"), F.col("event_end_date").alias("event_end")))
    rows = reduce(DataFrame.unionByName, parts).join(period, "person_id")
    return rows.where(F.col("event_start").between(F.col("observation_period_start_date"), F.col("observation_period_end_date"))).select("person_id", "event_name", "event_start", "event_end")


def eras(events: DataFrame, gap: int = 0, running_max: bool = False) -> DataFrame:
    """Collapse events into eras: a new one starts more than gap days after the end of the event before.

    With running_max the latest end so far counts, so an event inside a long one doesn't cut it.
    """
    w = Window.partitionBy("person_id", "event_name").orderBy("event_start", "event_end")
    before = F.max("event_end").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running_max else F.lag("event_end").over(w)
    fresh = events.withColumn("before", before).withColumn("fresh", F.when(F.col("before").isNull() | (F.col("event_start") > F.date_add("before", gap)), 1).otherwise(0))
    numbered = fresh.withColumn("era", F.sum("fresh").over(Window.partitionBy("person_id", "event_name").orderBy("event_start", "event_end")))
    return numbered.groupBy("person_id", "event_name", "era").agg(F.min("event_start").alias("era_start"), F.max("event_end").alias("era_end")).drop("era")


def steps(era_rows: DataFrame, max_depth: int = 5) -> DataFrame:
    """(person_id, step, label): eras ranked by start; names that start on one day are one step, joined by +."""
    ranked = era_rows.withColumn("step", F.dense_rank().over(Window.partitionBy("person_id").orderBy("era_start"))).where(F.col("step") <= max_depth)
    return ranked.groupBy("person_id", "step").agg(F.array_join(F.sort_array(F.collect_set("event_name")), "+").alias("label"))


def sequences(step_rows: DataFrame) -> DataFrame:
    """(person_id, path): the labels of a person in order; at most max_depth of them."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "label")))
    return step_rows.groupBy("person_id").agg(F.transform(ordered, lambda x: x["label"]).alias("path"))


def pathway_table(paths: DataFrame, target_size: int | Column, min_cell: int = 5) -> DataFrame:
    counts = paths.groupBy(F.array_join("path", " > ").alias("pathway")).agg(F.count("*").alias("n_persons")).where(F.col("n_persons") >= min_cell)
    return counts.select("pathway", "n_persons", F.round(100.0 * F.col("n_persons") / target_size, 2).alias("pct"))


def sunburst(paths: DataFrame, target_size: int | Column, min_cell: int = 5) -> DataFrame:
    """(prefix, depth, n_persons, pct) of every prefix that enough people share; an ancestor never has fewer."""
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("p"))
    counts = prefixes.groupBy(F.array_join("p", " > ").alias("prefix"), F.size("p").alias("depth")).agg(F.count("*").alias("n_persons"))
    return counts.where(F.col("n_persons") >= min_cell).withColumn("pct", F.round(100.0 * F.col("n_persons") / target_size, 2))
