"""What is known of single concepts, of cohort members and of their visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import folded
from tessera.operators.cohort import build_cohort, concept_events
from tessera.operators.vocabulary import concept_set
from tessera.sources.cdm import DOMAINS, Cdm

RELATIONS = 200


def concept_details(cdm: Cdm, concept_id: int) -> DataFrame:
    """(section, key, related_id, related_name): a concept's own row, at most 200 valid relations, and its synonyms."""
    concept, links = cdm.table("concept"), cdm.table("concept_relationship")
    if "invalid_reason" in links.columns:
        links = links.where("invalid_reason is null")
    own = concept.where(F.col("concept_id") == concept_id).select(F.lit("concept").alias("section"), F.col("vocabulary_id").alias("key"), F.col("concept_id").cast("long").alias("related_id"), F.col("concept_name").alias("related_name"))
    other = concept.select(F.col("concept_id").alias("concept_id_2"), "concept_name")
    relations = links.where(F.col("concept_id_1") == concept_id).join(other, "concept_id_2").orderBy("relationship_id", "concept_name", "concept_id_2").limit(RELATIONS)
    relations = relations.select(F.lit("relation").alias("section"), F.col("relationship_id").alias("key"), F.col("concept_id_2").cast("long").alias("related_id"), F.col("concept_name").alias("related_name"))
    out = own.unionByName(relations)
    if cdm.has("concept_synonym"):
        names = cdm.table("concept_synonym").where(F.col("concept_id") == concept_id)
        out = out.unionByName(names.select(F.lit("synonym").alias("section"), F.lit(None).cast("string").alias("key"), F.col("concept_id").cast("long").alias("related_id"), F.col("concept_synonym_name").alias("related_name")))
    return out


def _coded(cdm: Cdm, domain: str) -> DataFrame | None:
    """A domain's (person_id, concept_id, source_concept_id, source_value); None where it has no source values."""
    d = DOMAINS[domain]
    table = cdm.table(d.table)
    if d.source_value is None:
        return None
    code = d.source_value.replace("_source_value", "_source_concept_id")
    source = F.col(code) if code in table.columns else F.lit(None)
    return table.select("person_id", F.col(d.concept).cast("long").alias("concept_id"), source.cast("long").alias("source_concept_id"), F.col(d.source_value).alias("source_value"))


def concept_source_values(cdm: Cdm, concept_id: int, each: int = 50) -> DataFrame:
    """The most frequent source values of each domain whose standard or source concept is the one given."""
    parts = []
    for domain in cdm.domains():
        if (rows := _coded(cdm, domain)) is not None:
            parts.append(rows.where((F.col("concept_id") == concept_id) | (F.col("source_concept_id") == concept_id)).where("source_value is not null").withColumn("domain", F.lit(domain)))
    counts = reduce(DataFrame.unionByName, parts).groupBy("domain", "source_value").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n_records"), "source_value"))
    return counts.withColumn("k", rank).where(F.col("k") <= each).drop("k")


def source_concept_counts(cdm: Cdm, ids: list[int], domains: list[str] | None = None) -> DataFrame:
    """Records and persons by source concept, summed over domains."""
    parts = [rows.withColumn("domain", F.lit(d)) for d in domains or cdm.domains() if (rows := _coded(cdm, d)) is not None]
    each = reduce(DataFrame.unionByName, parts).where(F.col("source_concept_id").isin(ids)).groupBy("domain", "source_concept_id").agg(F.count("*").alias("r"), F.countDistinct("person_id").alias("p"))
    return each.groupBy(F.col("source_concept_id").alias("concept_id")).agg(F.sum("r").alias("n_source_records"), F.sum("p").alias("n_source_persons"))


def concept_set_counts(cdm: Cdm, items: list[dict]) -> DataFrame:
    """Records and persons of each concept that a set resolves to, summed over domains."""
    parts = [cdm.events(d).select(F.lit(d).alias("domain"), "person_id", F.col("concept_id").cast("long").alias("concept_id")) for d in cdm.domains()]
    rows = reduce(DataFrame.unionByName, parts).join(concept_set(cdm, items), "concept_id", "left_semi")
    each = rows.groupBy("domain", "concept_id").agg(F.count("*").alias("r"), F.countDistinct("person_id").alias("p"))
    return each.groupBy("concept_id").agg(F.sum("r").alias("n_records"), F.sum("p").alias("n_persons"))


def code_labels(values: DataFrame, concept: DataFrame, vocabulary: str = "ATC", code: str = "source_atc") -> DataFrame:
    """(code, label): the names in a vocabulary of the codes that the data has, upper case and without white space around."""
    tidy = lambda c: F.upper(F.trim(c))
    codes = values.select(tidy(F.col(code)).alias("code")).where("code <> ''").distinct()
    names = concept.where(F.col("vocabulary_id") == vocabulary).select(F.col("concept_code").alias("code"), F.trim("concept_name").alias("label")).where("label <> ''")
    return names.join(codes, "code", "left_semi").distinct()


def concept_page(cdm: Cdm, text: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the concepts that hold text, by name, each with the total of all pages."""
    holds = lambda c: folded(F.col(c)).contains(folded(F.lit(text)))
    rows = cdm.table("concept").where(holds("concept_name") | holds("concept_code"))
    # the total is an aggregate beside the page, so no window takes all rows into one task
    page = rows.orderBy("concept_name", "concept_id").offset(offset).limit(limit).select("concept_id", "concept_name")
    return page.select("*", rows.agg(F.count("*")).scalar().alias("total"))


def sample_details(cdm: Cdm, criteria: dict, n: int | None = None, seed: int = 7) -> DataFrame:
    """Members with what met each inclusion criterion: crit_k_code, and for measurements crit_k_value.

    Of several events that meet a criterion the first is taken (by date, then concept).  The code is the source value or
    the concept's code, then the source name or the concept's name; it is null where both codes are, and the value where
    the number is.  With n the rows are a sample: the n persons whose seeded hash is least.
    """
    people = build_cohort(cdm, criteria).select("person_id").distinct().join(cdm.table("person").select("person_id", "year_of_birth"), "person_id")
    if n is not None:
        people = people.orderBy(F.xxhash64("person_id", F.lit(seed)), "person_id").limit(n)
    names = cdm.table("concept").select("concept_id", "concept_code", "concept_name")
    out = people
    for k, criterion in enumerate((criteria.get("inclusion") or {}).get("criteria", [])):
        first = Window.partitionBy("person_id").orderBy(F.asc_nulls_last("event_date"), "concept_id", "source_value", "value_as_number")
        rows = concept_events(cdm, criterion).join(people.select("person_id"), "person_id", "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").join(names, "concept_id", "left")
        dash = lambda c: F.coalesce(F.concat(F.lit(" — "), F.nullif(c, F.lit(""))), F.lit(""))
        found = [F.concat(F.coalesce("source_value", "concept_code"), dash(F.coalesce("source_name", "concept_name"))).alias(f"crit_{k}_code")]
        if criterion["domain"] == "Measurement":
            found.append(F.col("value_as_number").cast("string").alias(f"crit_{k}_value"))
        out = out.join(rows.select("person_id", *found), "person_id", "left")
    return out


def _durations(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    names = cdm.table("concept").select(F.col("concept_id").alias("visit_concept_id"), F.col("concept_name").alias("visit_type"))
    visits = cdm.table("visit_occurrence").where("visit_start_date is not null and visit_end_date is not null").join(cohort, "person_id", "left_semi").join(names, "visit_concept_id", "left")
    return visits.select(F.coalesce("visit_type", F.lit("Unknown")).alias("visit_type"), F.greatest(F.datediff("visit_end_date", "visit_start_date"), F.lit(0)).alias("days"))


def visit_duration(cdm: Cdm, cohort: DataFrame, n: int = 10) -> DataFrame:
    """Days of visits, overall and for the n most frequent types, from one pass with grouping sets."""
    days = F.col("days")
    sets = _durations(cdm, cohort).groupingSets([[], ["visit_type"]], "visit_type").agg(
        F.grouping("visit_type").alias("g"), F.count("*").alias("n_visits"), F.round(F.avg(days), 1).alias("mean_days"), F.round(F.stddev_samp(days), 1).alias("std_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"), F.round(F.percentile(days, 0.5), 1).alias("median_days")
    )
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n_visits"), "visit_type"))
    return sets.withColumn("k", rank).where((F.col("g") == 1) | (F.col("k") <= n)).select(F.when(F.col("g") == 1, "all").otherwise(F.col("visit_type")).alias("visit_type"), "n_visits", "mean_days", "std_days", "min_days", "max_days", "median_days")


def domain_coverage(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """(domain, n_persons, pct): members of a cohort with any record of a domain."""
    size = cohort.agg(F.countDistinct("person_id")).scalar()
    # a row for each person of a domain meets the cohort, not one for each event; a semi join would go down to the events
    people = [cdm.events(d).select("person_id").distinct().select(F.lit(d).alias("domain"), "person_id") for d in cdm.domains()]
    rows = reduce(DataFrame.unionByName, people).join(cohort.select("person_id").distinct(), "person_id").groupBy("domain").agg(F.count("*").alias("n_persons"))
    return rows.select("domain", "n_persons", F.round(100.0 * F.col("n_persons") / size, 1).alias("pct"))


def mapping_rates(snapshots: DataFrame) -> DataFrame:
    """(version, total_terms, unmapped_terms, pct_terms_mapped, pct_rows_mapped) of snapshots (version, source_value, mapped, n_records)."""
    open_ = F.col("mapped") == 0
    rows = snapshots.groupBy("version").agg(F.count("*").alias("total_terms"), F.count(F.when(open_, 1)).alias("unmapped_terms"), F.sum("n_records").alias("r"), F.sum(F.when(open_, F.col("n_records")).otherwise(0)).alias("u"))
    share = lambda bad, all_: F.round(100.0 * (F.col(all_) - F.col(bad)) / F.col(all_), 2)
    return rows.select("version", "total_terms", "unmapped_terms", share("unmapped_terms", "total_terms").alias("pct_terms_mapped"), share("u", "r").alias("pct_rows_mapped"))


def code_families(values: DataFrame, column: str, size: int = 3, least: int = 3) -> DataFrame:
    """(family, n_values): codes by their first characters; values that are short or only marks are left out."""
    kept = values.where(F.length(F.trim(column)) >= least).where(~F.col(column).rlike(r"^[\W_]+$"))
    return kept.groupBy(F.substring(column, 1, size).alias("family")).agg(F.countDistinct(column).alias("n_values"))


def newest(parts: list[tuple[str, DataFrame]], n: int = 10) -> DataFrame:
    """The n latest rows (kind, key, at) of several sources of (key, at)."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "at") for kind, df in parts])
    return every.orderBy(F.desc("at"), "kind", "key").limit(n)


def json_fields(documents: DataFrame, column: str) -> DataFrame:
    """(key, n, total): the integer fields of JSON objects by name; text that is no object has none."""
    rows = documents.select(F.explode(F.from_json(column, "map<string,bigint>")).alias("key", "number"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("number").alias("total"))
