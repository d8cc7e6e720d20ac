"""Vocabulary search, hierarchy, counts and source values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import folded
from tessera.sources.cdm import Cdm


def _events(cdm: Cdm) -> DataFrame:
    parts = [cdm.events(d).select(F.lit(d).alias("domain"), "person_id", "concept_id", "source_value", "source_name", "source_atc") for d in cdm.domains()]
    return reduce(DataFrame.unionByName, parts)


def concept_search(cdm: Cdm, text: str, domain: str | None = None, vocabulary: str | None = None, standard_only: bool = False, limit: int = 50, offset: int = 0, codes: bool = False) -> DataFrame:
    """Valid concepts whose name or code holds text, accents and case aside; digits search the id, with codes also the codes.

    Standard concepts first, then short names, then by name.
    """
    rows = cdm.table("concept").where("invalid_reason is null")
    if text.isdigit():
        by_id = F.col("concept_id") == int(text)
        rows = rows.where(by_id | F.col("concept_code").contains(text) if codes else by_id)
    else:
        rows = rows.where(folded(F.col("concept_name")).contains(folded(F.lit(text))) | folded(F.col("concept_code")).contains(folded(F.lit(text))))
    for column, wanted in (("domain_id", domain), ("vocabulary_id", vocabulary)):
        if wanted:
            rows = rows.where(F.col(column) == wanted)
    if standard_only:
        rows = rows.where(F.col("standard_concept") == "S")
    order = [F.when(F.col("standard_concept") == "S", 0).otherwise(1), F.length("concept_name"), F.col("concept_name"), F.col("concept_id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def concept_hierarchy(cdm: Cdm, concept_id: int, ancestors: int = 100, descendants: int = 200) -> DataFrame:
    """(direction, concept_id, concept_name, levels) of a concept's relatives, itself left out."""
    names = cdm.table("concept").select("concept_id", "concept_name")
    tree = cdm.table("concept_ancestor").where("ancestor_concept_id <> descendant_concept_id")
    up = tree.where(F.col("descendant_concept_id") == concept_id).select(F.lit("ancestor").alias("direction"), F.col("ancestor_concept_id").alias("concept_id"), F.col("min_levels_of_separation").alias("levels"))
    down = tree.where(F.col("ancestor_concept_id") == concept_id).select(F.lit("descendant").alias("direction"), F.col("descendant_concept_id").alias("concept_id"), F.col("min_levels_of_separation").alias("levels"))
    first = lambda df, n: df.orderBy("levels", "concept_id").limit(n)
    return first(up, ancestors).unionByName(first(down, descendants)).join(names, "concept_id")


def concept_counts(cdm: Cdm, ids: list[int]) -> DataFrame:
    """Records and persons of concepts, summed over domains, so a person of two domains counts twice."""
    each = _events(cdm).where(F.col("concept_id").isin(ids)).groupBy("domain", "concept_id").agg(F.count("*").alias("r"), F.countDistinct("person_id").alias("p"))
    return each.groupBy("concept_id").agg(F.sum("r").alias("n_records"), F.sum("p").alias("n_persons"))


def facets(cdm: Cdm, column: str) -> DataFrame:
    return cdm.table("concept").groupBy(column).agg(F.count("*").alias("n_concepts"))


def concept_set(cdm: Cdm, items: list[dict]) -> DataFrame:
    """concept_id of a concept set: items with their descendants if asked, less the excluded ones."""
    tree = cdm.table("concept_ancestor")

    def part(excluded: bool) -> DataFrame | None:
        rows = [i for i in items if bool(i.get("is_excluded")) == excluded]
        if not rows:
            return None
        own = tree.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(i["concept_id"])).cast("long") for i in rows])).alias("concept_id"))
        below = [int(i["concept_id"]) for i in rows if i.get("include_descendants", True)]
        return own.unionByName(tree.where(F.col("ancestor_concept_id").isin(below)).select(F.col("descendant_concept_id").cast("long").alias("concept_id"))).distinct()

    wanted, unwanted = part(False), part(True)
    return wanted if unwanted is None else wanted.join(unwanted, "concept_id", "left_anti")


def source_values(cdm: Cdm) -> DataFrame:
    """Records and persons of every source value of every domain with its concept's label."""
    names = cdm.table("concept").select("concept_id", "concept_name", "vocabulary_id", "standard_concept")
    rows = _events(cdm).where("source_value is not null")
    counts = rows.groupBy("domain", "source_value", "source_name", "source_atc", "concept_id").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons"))
    return counts.join(names, "concept_id", "left")


def labelled_source_values(cdm: Cdm, codebooks: DataFrame) -> DataFrame:
    """source_values() named by the codebooks (name, domain, code, description) of their domain; other names are kept."""
    parts = [codebook_labels(codebooks.where(F.col("domain") == d)).select(F.lit(d).alias("domain"), F.col("code").alias("source_value"), "label") for d in cdm.domains()]
    rows = source_values(cdm)
    return rows.join(reduce(DataFrame.unionByName, parts), ["domain", "source_value"], "left").withColumn("source_name", F.coalesce("label", "source_name")).select(*rows.columns)


def source_value_search(cdm: Cdm, text: str, limit: int = 50) -> DataFrame:
    rows = _events(cdm).where(folded(F.col("source_value")).contains(folded(F.lit(text))))
    return rows.groupBy("domain", "source_value").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons")).orderBy(F.desc("n_records"), "domain", "source_value").limit(limit)


def codebook_labels(codebooks: DataFrame) -> DataFrame:
    """(code, label): the non-empty label from the codebook with the most codes that has one."""
    size = codebooks.groupBy("name").agg(F.count("*").alias("size"))
    rows = codebooks.where(F.length(F.trim("description")) > 0).join(size, "name")
    return rows.groupBy("code").agg(F.min(F.struct(-F.col("size"), F.col("name"), F.col("description"))).alias("x")).select("code", F.col("x.description").alias("label"))


def global_search(cdm: Cdm, text: str, each: int = 10, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, key, label) of concepts and source values that hold text, case and accents aside, `each` of a kind at most.

    others adds kinds, such as cohorts, saved queries or mapping decisions: tables (key, label) searched by their label, in its order.
    """
    concepts = concept_search(cdm, text, limit=each).select(F.lit("concept").alias("kind"), F.col("concept_id").cast("string").alias("key"), F.col("concept_name").alias("label"))
    values = source_value_search(cdm, text, each).select(F.lit("source value").alias("kind"), F.col("source_value").alias("key"), F.col("domain").alias("label"))
    found = concepts.unionByName(values)
    for kind, rows in (others or {}).items():
        hits = rows.where(folded(F.col("label")).contains(folded(F.lit(text)))).select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "label")
        found = found.unionByName(hits.orderBy("label", "key").limit(each))
    return found
