"""Checks of what users send: identifiers, criteria documents and read-only SQL."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_DEPTH, MAX_CONCEPTS = 10, 10_000
#: Statements that change data and are no commands for the parser; functions that run code.
CHANGING = {"InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable"}
RUNNING = {"reflect", "java_method", "try_reflect"}


def identifier(name: str) -> str:
    """The name, if it is a plain SQL identifier of at most 63 characters; else ValueError."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def checked_criteria(document: dict, depth: int = 0) -> dict:
    """The document, if its groups are objects, not nested too deep, without raw SQL and with integer concepts."""
    if depth > MAX_DEPTH:
        raise ValueError("criteria are nested too deep")
    if not isinstance(document, dict):
        raise ValueError("criteria must be an object")
    for section in ("inclusion", "exclusion"):
        group = document.get(section)
        if group is None:
            continue
        if not isinstance(group, dict):
            raise ValueError(f"{section} must be an object")
        for criterion in group.get("criteria", []):
            if not isinstance(criterion, dict):
                raise ValueError(f"a criterion of {section} must be an object")
            if "nested_cohort_sql" in criterion:
                raise ValueError("a criterion must not hold SQL")
            ids = criterion.get("concept_ids", [])
            if not isinstance(ids, list) or len(ids) > MAX_CONCEPTS or not all(isinstance(x, (int, float)) for x in ids):
                raise ValueError("concept_ids must be a list of integers that is not too long")
        for below in group.get("groups", []):
            checked_criteria({"inclusion": below}, depth + 1)
    return document


def _walked(plan):
    """A parsed plan's nodes, those of its subqueries and common table expressions included."""
    yield plan
    more = [plan.children(), plan.subqueries(), plan.innerChildren()]
    for nodes in more:
        for k in range(nodes.size()):
            if hasattr(nodes.apply(k), "subqueries"):
                yield from _walked(nodes.apply(k))


def read_only(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """The rows of a statement that only reads, at most `limit` unless its outermost part has a LIMIT of its own.

    The parsed plan decides, not the text: it must have no command in it (EXPLAIN of a statement that only reads is
    allowed), and call no function that runs code.  So a text cell may say "update", and an inner LIMIT is no outer one.
    """
    text = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise ValueError("this is not one statement of SQL") from e
    kind = spark._jvm.java.lang.Class.forName
    command = kind("org.apache.spark.sql.catalyst.plans.logical.Command")
    explain = plan.nodeName().startswith("Explain")
    root = plan.logicalPlan() if explain else plan
    for node in _walked(root):
        name = node.getClass().getSimpleName()
        if command.isInstance(node) or name in CHANGING:
            raise ValueError(f"{name} is not allowed")
    called = {w.lower() for w in re.findall(r"(\w+)`?\s*\(", text)}
    if found := called & RUNNING:
        raise ValueError(f"{sorted(found)[0]} is not allowed")
    while root.nodeName() in ("UnresolvedWith", "WithCTE"):
        root = root.children().apply(0)
    rows = spark.sql(text)
    return rows if explain or root.nodeName() in ("GlobalLimit", "LocalLimit") else rows.limit(limit)


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, shared): columns of tables, and whether a column named like a key is in others too."""
    keys = [c for df in tables.values() for c in df.columns if c.endswith("_id")]
    rows = [(name, f.name, f.dataType.simpleString(), keys.count(f.name) > 1) for name, df in sorted(tables.items()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string, shared boolean")
