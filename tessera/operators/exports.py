"""Rows of the CSV files in which mappings, their history and audit logs are handed out; `sources.files.write_csv` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import csv_guard
from tessera.operators import mapping
from tessera.sources.cdm import Cdm

OPTIONAL = {"source_name": "string", "target_concept_name": "string", "target_vocabulary_id": "string", "previous_concept_id": "long", "reason": "string", "domain": "string"}


def _filled(decisions: DataFrame) -> DataFrame:
    """The decisions with null for each optional column that they lack."""
    lacking = {n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in decisions.columns}
    return decisions.withColumns(lacking) if lacking else decisions


def _written(decisions: DataFrame) -> Column:
    """The time of a decision as ISO text: with a T before the hours if it has hours."""
    kind = dict(decisions.dtypes)["created_on"]
    return F.col("created_on").cast("string") if kind == "date" else F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss")


def mapping_export(cdm: Cdm, domain: str, decisions: DataFrame, source_vocabulary: str = "", users: int = 2) -> DataFrame:
    """A row of 25 columns, as mapping tools read them, for each target that enough users agree on.

    Terms that need no push any more (synced, or the data has the only target already) are left out.  Frequencies are the
    records of the term in the domain, 0 for none.  The latest decision speaks for a target, of several at one time the one of
    the largest id, then user; all users are listed by name.  A null is an empty cell.
    """
    yes = _filled(decisions).withColumn("written", _written(decisions)).where(F.col("action").isin(*mapping.DECIDED))
    told = ["created_on", "decision_id", "user_id", "confidence", "written", *[c for c in OPTIONAL if c != "domain"]]
    by = F.collect_set(F.col("user_id").cast("string"))
    agreed = yes.groupBy("source_value", "target_concept_id").agg(F.max(F.struct(*told)).alias("last"), by.alias("by")).where(F.size("by") >= users)
    agreed = agreed.select("source_value", "target_concept_id", "last.*", F.array_join(F.array_sort("by"), ";").alias("approvers"))
    frequency = cdm.events(domain).groupBy("source_value").agg(F.count("*").alias("n"))
    target = cdm.table("concept").select(F.col("concept_id").alias("target_concept_id"), "concept_code", "concept_class_id", F.col("concept_name").alias("known_name"), F.col("vocabulary_id").alias("known_vocabulary"))
    rows = agreed.join(mapping.redundant(cdm, domain, decisions), "source_value", "left_anti").join(frequency, "source_value", "left").join(target, "target_concept_id", "left")
    name = csv_guard(F.coalesce("target_concept_name", "known_name"))
    cells = {
        "sourceCode": csv_guard(F.col("source_value")),
        "sourceName": csv_guard(F.coalesce(F.nullif("source_name", F.lit("")), "source_value")),
        "sourceFrequency": F.coalesce("n", F.lit(0)),
        "sourceAutoAssignedConceptIds": F.coalesce("previous_concept_id", F.lit(0)),
        "ADD_INFO:source_name_fr": csv_guard(F.col("source_name")),
        "ADD_INFO:matchScore": F.nullif("confidence", F.lit(0)),
        "mappingStatus": F.lit("APPROVED"),
        "equivalence": F.lit("EQUAL"),
        "statusSetBy": csv_guard(F.col("approvers")),
        "statusSetOn": F.coalesce("written", F.lit("")),
        "conceptId": F.col("target_concept_id"),
        "conceptName": name,
        "domainId": csv_guard(F.lit(domain)),
        "mappingType": F.lit("MAPS_TO"),
        "comment": csv_guard(F.col("reason")),
        "createdBy": csv_guard(F.col("user_id")),
        "createdOn": F.coalesce("written", F.lit("")),
        "assignedReviewers": F.lit(""),
        "srce_vocabulary": csv_guard(F.lit(source_vocabulary)),
        "concept_code": csv_guard(F.col("concept_code")),
        "concept_name": name,
        "domain_id": csv_guard(F.lit(domain)),
        "vocabulary_id": csv_guard(F.coalesce("target_vocabulary_id", "known_vocabulary")),
        "concept_class_id": csv_guard(F.col("concept_class_id")),
        "standard_concept": F.lit("S"),
    }
    return rows.select(*[c.alias(n) for n, c in cells.items()])


def mapping_history(decisions: DataFrame, domain: str | None = None, action: str | None = None, user: object = None) -> DataFrame:
    """A row of 13 columns for each decision, of one domain, action or user if such is named; text is safe for spreadsheets."""
    rows = _filled(decisions)
    for name, wanted in (("domain", domain), ("action", action), ("user_id", user)):
        rows = rows.where(F.col(name) == wanted) if wanted is not None else rows
    text = lambda *names: [csv_guard(F.col(n)).alias(n) for n in names]
    return rows.select(
        *text("domain", "source_value", "source_name", "action"),
        "target_concept_id",
        *text("target_concept_name", "target_vocabulary_id"),
        F.nullif("previous_concept_id", F.lit(0)).alias("previous_concept_id"),
        *text("suggestion_source"),
        F.col("confidence").alias("confidence_score"),
        csv_guard(F.col("user_id")).alias("user"),
        *text("reason"),
        F.coalesce(_written(decisions), F.lit("")).alias("created_at"),
    )


def audit_export(lines: DataFrame, first: str, last: str, user: str | None = None, action: str | None = None) -> DataFrame:
    """Audit lines of the days first to last, both included, of a user and of actions that begin so, if such are named.

    lines has ts (ISO text), user, roles (array), action, method, path, status, duration_ms and ip; roles are joined by commas.
    """
    rows = lines.where(F.substring("ts", 1, 10).between(first, last))
    rows = rows.where(F.col("user") == user) if user else rows
    rows = rows.where(F.col("action").startswith(action)) if action else rows
    text = lambda n: csv_guard(F.col(n)).alias(n)
    roles = csv_guard(F.array_join("roles", ",")).alias("roles")
    return rows.select(F.col("ts").alias("timestamp"), text("user"), roles, text("action"), text("method"), text("path"), "status", "duration_ms", text("ip"))
