"""Mapping of source terms to concepts: suggestions, decisions and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.cdm import DOMAINS, Cdm
from tessera.sources.scratch import written

DECIDED = ("approved", "modified")
#: Rows of names and their best concepts that are broadcast, at about 256 bytes each.
BROADCAST_ROWS = 1 << 17


def list_unmapped(cdm: Cdm, domain: str, search: str | None = None) -> DataFrame:
    """Source terms without concept, with counts; in no order, as a rule other terms are joined."""
    rows = cdm.events(domain).where("(concept_id is null or concept_id = 0) and source_value is not null")
    if search:
        rows = rows.where(F.lower("source_value").contains(search.lower()))
    return rows.groupBy("source_value").agg(F.min("source_name").alias("source_name"), F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons"))


def _usable(cdm: Cdm) -> DataFrame:
    return cdm.table("concept").where("standard_concept = 'S' and invalid_reason is null")


def _suggestion(df: DataFrame, strategy: str, confidence: Column) -> DataFrame:
    return df.select("source_value", F.col("concept_id").cast("long").alias("concept_id"), "concept_name", F.lit(strategy).alias("strategy"), confidence.cast("int").alias("confidence"))


def suggest_exact(cdm: Cdm, terms: DataFrame, domain: str) -> DataFrame:
    """Standard valid concepts whose code is the source value: confidence 95."""
    c = _usable(cdm).where(F.col("domain_id") == domain)
    return _suggestion(terms.join(c, F.col("source_value") == F.col("concept_code")), "exact", F.lit(95))


def suggest_relationship(cdm: Cdm, terms: DataFrame, domain: str) -> DataFrame:
    """Standard concepts that non-standard ones of the source code map to: confidence 85; needs a source name."""
    c = cdm.table("concept").select(F.col("concept_id").alias("concept_id_1"), F.col("concept_code").alias("code"))
    links = cdm.table("concept_relationship").where("relationship_id = 'Maps to'")
    to = _usable(cdm).where(F.col("domain_id") == domain).withColumnRenamed("concept_id", "concept_id_2")
    rows = terms.where("source_name is not null").join(c, F.col("source_value") == F.col("code")).join(links, "concept_id_1").join(to, "concept_id_2").withColumnRenamed("concept_id_2", "concept_id")
    return _suggestion(rows.dropDuplicates(["source_value", "concept_id"]), "relationship", F.lit(85))


def parse_drug_name(name: Column) -> Column:
    """struct(ingredient, dosage, brand) of "MOLECULE DOSE FORM (BRAND)"."""
    brand = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    dosage = F.regexp_extract(name, r"(?i)(\d+(?:[.,]\d+)?\s*(?:MG|G|MCG|UG|UI|ML|%))", 1)
    bare = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"(?i)\s*\d.*$", "")
    null = lambda c: F.when(F.length(c) > 0, c)
    return F.struct(null(F.trim(bare)).alias("ingredient"), null(dosage).alias("dosage"), null(F.trim(brand)).alias("brand"))


def suggest_ingredient(cdm: Cdm, terms: DataFrame, domain: str, each: int = 5) -> DataFrame:
    """Concepts whose name has the term's ingredient as its words: 85 for the same name, else 78; 5 more for the brand.

    The join is on the name's words, so only concepts that share the ingredient's last word are compared.  Of concepts of one
    name only the `each` least ids can be in a result, so no others meet ingredients.  Concepts are ranked once for each distinct ingredient and brand, and only the best of them meet the terms.
    """
    words = lambda c: F.split(F.lower(c), r"\s+")
    t = terms.select("source_value", parse_drug_name(F.coalesce("source_name", "source_value")).alias("p")).where("p.ingredient is not null").select("source_value", "p.ingredient", "p.brand")
    names = t.select("ingredient", "brand").distinct().withColumn("word", F.element_at(words(F.col("ingredient")), -1))
    least = F.row_number().over(Window.partitionBy("concept_name").orderBy("concept_id"))
    c = _usable(cdm).where(F.col("domain_id") == domain).select("concept_id", "concept_name").withColumn("k", least).where(F.col("k") <= each)
    c = c.select("concept_id", "concept_name", F.explode(F.array_distinct(words(F.col("concept_name")))).alias("word"))
    rows = names.join(c, "word").where(F.lower("ingredient").contains(F.lower("concept_name")) | F.lower("concept_name").contains(F.lower("ingredient")))
    score = F.when(F.lower("concept_name") == F.lower("ingredient"), 85).otherwise(78) + F.when(F.lower("concept_name").contains(F.lower("brand")), 5).otherwise(0)
    rows = rows.withColumn("confidence", F.least(F.lit(95), score))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.length("concept_name"), "concept_id"))
    found = rows.withColumn("k", best("ingredient", "brand")).where(F.col("k") <= each).select(F.col("ingredient").alias("__ingredient"), F.col("brand").alias("__brand"), "concept_id", "concept_name", "confidence")
    found = written(found)  # few rows may be for all terms: these are not shuffled or held to meet them
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = _suggestion(t.join(found, F.col("ingredient").eqNullSafe(F.col("__ingredient")) & F.col("brand").eqNullSafe(F.col("__brand"))), "ingredient", F.col("confidence"))
    # a term may have several names
    return rows.withColumn("k", best("source_value")).where(F.col("k") <= each).drop("k")


def suggest_merged(parts: list[DataFrame], each: int = 5) -> DataFrame:
    """One suggestion for each concept, from the first strategy that has it; the best `each` of a term."""
    every = reduce(DataFrame.unionByName, [p.withColumn("turn", F.lit(k)) for k, p in enumerate(parts)])
    first = every.withColumn("k", F.row_number().over(Window.partitionBy("source_value", "concept_id").orderBy("turn", F.desc("confidence")))).where("k = 1")
    best = Window.partitionBy("source_value").orderBy(F.desc("confidence"), "turn", "concept_id")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= each).drop("k", "turn")


def consensus(decisions: DataFrame, users: int = 2) -> DataFrame:
    """Terms and targets that at least so many users approved, with the latest decision's id."""
    rows = decisions.where(F.col("action").isin(*DECIDED))
    return rows.groupBy("source_value", "target_concept_id").agg(F.countDistinct("user_id").alias("n_users"), F.max(F.struct("created_on", "decision_id")).alias("x")).where(F.col("n_users") >= users).select("source_value", "target_concept_id", "n_users", F.col("x.decision_id").alias("decision_id"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last approved or modified decision of each term."""
    last = Window.partitionBy("source_value").orderBy(F.desc("created_on"), F.desc("decision_id"))
    return decisions.where(F.col("action").isin(*DECIDED)).withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def pending(cdm: Cdm, domain: str, decisions: DataFrame) -> DataFrame:
    """Unmapped terms with the target that a decision waits to give them."""
    return list_unmapped(cdm, domain).join(latest_decisions(decisions).select("source_value", "target_concept_id", "decision_id"), "source_value", "left")


def mapped_terms(cdm: Cdm, domain: str) -> DataFrame:
    """(source_value, a, b): the least and the greatest concept of each term that the data has mapped."""
    return cdm.events(domain).where("concept_id > 0").groupBy("source_value").agg(F.min("concept_id").alias("a"), F.max("concept_id").alias("b"))


def warnings(cdm: Cdm, domain: str, decisions: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """(source_value, warning): several targets, already mapped, or several concepts in the data."""
    targets = decisions.where(F.col("action").isin(*DECIDED)).groupBy("source_value").agg(F.countDistinct("target_concept_id").alias("n_targets"))
    rows = targets.join(mapped_terms(cdm, domain) if mapped is None else mapped, "source_value", "left")
    found = F.array_compact(F.array(F.when(F.col("n_targets") >= 2, F.lit("several targets")), F.when(F.col("a").isNotNull(), F.lit("already mapped")), F.when(F.col("a") < F.col("b"), F.lit("several concepts"))))
    return rows.select("source_value", F.explode(found).alias("warning"))


def redundant(cdm: Cdm, domain: str, decisions: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Terms that are synced, or whose only target is the only concept that the data has for them."""
    rows = decisions.where(F.col("action").isin(*DECIDED)).groupBy("source_value").agg(F.max("synced").alias("synced"), F.min("target_concept_id").alias("lo"), F.max("target_concept_id").alias("hi"))
    mapped = mapped_terms(cdm, domain) if mapped is None else mapped
    same = (F.col("lo") == F.col("hi")) & (F.col("a") == F.col("b")) & (F.col("lo") == F.col("a"))
    return rows.join(mapped, "source_value", "left").where((F.col("synced") == 1) | F.coalesce(same, F.lit(False))).select("source_value")


def apply_mappings(cdm: Cdm, domain: str, decided: DataFrame) -> DataFrame:
    """The domain's table with targets over its unmapped rows; decided is (source_value, target_concept_id), a row a term."""
    d = DOMAINS[domain]
    table = cdm.table(d.table)
    new = decided.select(F.col("source_value").alias("__term"), F.col("target_concept_id").alias("__target"))
    open_ = F.col(d.concept).isNull() | (F.col(d.concept) == 0)
    rows = table.join(new, F.col(d.source_value) == F.col("__term"), "left").withColumn(d.concept, F.when(open_, F.coalesce("__target", d.concept)).otherwise(F.col(d.concept)))
    return rows.select(*table.columns)


def rollback_mappings(table: DataFrame, domain: str, decided: DataFrame) -> DataFrame:
    """The inverse: rows of decided terms that carry their target become unmapped again."""
    d = DOMAINS[domain]
    old = decided.select(F.col("source_value").alias("__term"), F.col("target_concept_id").alias("__target"))
    rows = table.join(old, (F.col(d.source_value) == F.col("__term")) & (F.col(d.concept) == F.col("__target")), "left")
    return rows.withColumn(d.concept, F.when(F.col("__term").isNotNull(), 0).otherwise(F.col(d.concept))).select(*table.columns)


def bulk_decisions(terms: DataFrame, decisions: DataFrame, user_id: int) -> DataFrame:
    """Terms that the user hasn't decided on yet."""
    return terms.join(decisions.where(F.col("user_id") == user_id).select("source_value").distinct(), "source_value", "left_anti")


def strategy_stats(decisions: DataFrame) -> DataFrame:
    """Decisions, approval rate and mean confidence of each suggestion strategy."""
    n = lambda action: F.count(F.when(F.col("action") == action, 1))
    return decisions.groupBy("suggestion_source").agg(F.count("*").alias("n"), n("approved").alias("n_approved"), n("rejected").alias("n_rejected"), n("modified").alias("n_modified"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(100.0 * n("approved") / F.count("*"), 2).alias("pct_approved"))


def pipeline_kpis(decisions: DataFrame) -> DataFrame:
    """Counts of validated, pending, to-push and rejected terms, by their last decision."""
    last = Window.partitionBy("source_value").orderBy(F.desc("created_on"), F.desc("decision_id"))
    rows = decisions.withColumn("k", F.row_number().over(last)).where("k = 1")
    yes = F.col("action").isin(*DECIDED)
    return rows.agg(F.count(F.when(yes & (F.col("synced") == 1), 1)).alias("validated"), F.count(F.when(yes & (F.col("synced") == 0), 1)).alias("to_push"), F.count(F.when(F.col("action") == "rejected", 1)).alias("rejected"), F.count("*").alias("n_terms"))


def domain_kpis(decisions: DataFrame, snapshots: DataFrame, pushes: DataFrame, domains: list[str], users: int = 2) -> DataFrame:
    """One row for each domain: its last snapshot's mapping rates, and where its decisions stand.

    decisions have a domain; snapshots are (domain, version, created_on, n_terms, n_mapped_terms, n_rows, n_mapped_rows), pushes
    (domain, applied_on).  A term and target that `users` approved is validated, to be pushed while it isn't synced, and pending
    with fewer; rejected counts terms.  A snapshot is stale if something was pushed after it; a domain without any was
    never analyzed.
    """
    pairs = decisions.where(F.col("action").isin(*DECIDED) & F.col("target_concept_id").isNotNull()).groupBy("domain", "source_value", "target_concept_id").agg(F.countDistinct("user_id").alias("n"), F.max("synced").alias("synced"))
    done = F.col("n") >= users
    stand = pairs.groupBy("domain").agg(F.count(F.when(done, 1)).alias("validated"), F.count(F.when(~done, 1)).alias("pending"), F.count(F.when(done & (F.col("synced") == 0), 1)).alias("to_push"))
    rejected = decisions.where("action = 'rejected'").groupBy("domain").agg(F.countDistinct("source_value").alias("rejected"))
    last = snapshots.groupBy("domain").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "domain"]), "version").alias("x")).select("domain", "x.*")
    pushed = pushes.groupBy("domain").agg(F.max("applied_on").alias("last_push"))
    every = decisions.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    rows = every
    for part in (last, stand, rejected, pushed):
        rows = rows.join(part, "domain", "left")
    pct = lambda part, whole: F.round(100.0 * F.col(part) / F.col(whole), 2)
    return rows.select(
        "domain", "version", F.col("created_on").alias("snapshot_date"), "n_terms", "n_mapped_terms", pct("n_mapped_terms", "n_terms").alias("pct_terms"), "n_rows", "n_mapped_rows", pct("n_mapped_rows", "n_rows").alias("pct_rows"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("validated", "pending", "rejected", "to_push")],
        F.coalesce(F.col("last_push") > F.col("created_on"), F.lit(False)).alias("stale"), F.col("version").isNull().alias("never_analyzed"),
    )
