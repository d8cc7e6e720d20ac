"""The clinical data model: domains, table access, and the adapter from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """Where the events of a domain are; optional columns may be missing from a table."""

    table: str
    date: str
    concept: str
    source_value: str | None
    end_date: str | None = None
    source_name: str | None = None
    source_atc: str | None = None


# fixed values: the domains of the published data model
DOMAINS = {
    "Condition": Domain("condition_occurrence", "condition_start_date", "condition_concept_id", "condition_source_value", "condition_end_date"),
    "Drug": Domain("drug_exposure", "drug_exposure_start_date", "drug_concept_id", "drug_source_value", "drug_exposure_end_date", "drug_source_name", "drug_source_atc"),
    "Measurement": Domain("measurement", "measurement_date", "measurement_concept_id", "measurement_source_value", None, "measurement_source_name"),
    "Observation": Domain("observation", "observation_date", "observation_concept_id", "observation_source_value"),
    "Procedure": Domain("procedure_occurrence", "procedure_date", "procedure_concept_id", "procedure_source_value"),
    "Visit": Domain("visit_occurrence", "visit_start_date", "visit_concept_id", "visit_source_value", "visit_end_date"),
    "Device": Domain("device_exposure", "device_exposure_start_date", "device_concept_id", "device_source_value", "device_exposure_end_date"),
    "Death": Domain("death", "death_date", "cause_concept_id", "cause_source_value"),
    "Specimen": Domain("specimen", "specimen_date", "specimen_concept_id", "specimen_source_value"),
    "Note": Domain("note", "note_date", "note_type_concept_id", None),
    "Payer_Plan_Period": Domain("payer_plan_period", "payer_plan_period_start_date", "payer_concept_id", "payer_source_value"),
}


class Cdm:
    """Named tables as DataFrames, with the date that stands for today."""

    def __init__(self, tables: dict[str, DataFrame], as_of: str = "2024-06-30"):
        self.tables, self.as_of = tables, as_of

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def has(self, name: str) -> bool:
        return name in self.tables

    def domains(self) -> list[str]:
        return [k for k, d in DOMAINS.items() if self.has(d.table)]

    def events(self, domain: str) -> DataFrame:
        """The domain's table with the common names: person_id, visit_occurrence_id, concept_id, start, end and sources."""
        d = DOMAINS[domain]
        df = self.table(d.table)
        col = lambda name, kind="string": F.col(name) if name and name in df.columns else F.lit(None).cast(kind)
        return df.select(
            "person_id",
            col("visit_occurrence_id", "long").alias("visit_occurrence_id"),
            F.col(d.concept).alias("concept_id"),
            F.col(d.date).alias("event_date"),
            F.coalesce(col(d.end_date, "date"), F.col(d.date)).alias("event_end_date"),
            col(d.source_value).alias("source_value"),
            col(d.source_name).alias("source_name"),
            col(d.source_atc).alias("source_atc"),
            col("value_as_number", "double").alias("value_as_number"),
            col("value_as_concept_id", "int").alias("value_as_concept_id"),
            col("unit_concept_id", "int").alias("unit_concept_id"),
        )


#: The adapter's tables, in SQL that Spark and DuckDB both run; order matters.
TABLE_SQL = {
    "person": """SELECT c_custkey AS person_id, CAST(1930 + c_custkey % 80 AS INT) AS year_of_birth, CAST(1 + c_custkey % 12 AS INT) AS month_of_birth,
        CAST(1 + c_custkey % 28 AS INT) AS day_of_birth, CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
        n_regionkey + 1 AS race_concept_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 38003563 ELSE 38003564 END AS ethnicity_concept_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "drug_exposure": """SELECT l_orderkey * 10 + l_linenumber AS drug_exposure_id, o_custkey AS person_id, l_orderkey AS visit_occurrence_id,
        CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 1000000 + l_partkey END AS drug_concept_id, CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
        CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS DATE) AS drug_exposure_end_date, l_quantity AS quantity,
        p_name AS drug_source_value, p_type || ' ' || p_name AS drug_source_name, p_brand AS drug_source_atc
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "visit_occurrence": """SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, CAST(9000 + CAST(substring(o_orderpriority, 1, 1) AS INT) AS INT) AS visit_concept_id,
        CAST(o_orderdate AS DATE) AS visit_start_date, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INT) AS DATE) AS visit_end_date,
        o_orderpriority AS visit_source_value FROM orders""",
    "observation_period": """SELECT person_id, min(d) AS observation_period_start_date, max(d) AS observation_period_end_date FROM (
        SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS d FROM orders
        UNION ALL SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT user_id, CAST(ts AS DATE) FROM events) x GROUP BY person_id""",
    "condition_occurrence": """SELECT event_id AS condition_occurrence_id, user_id AS person_id, CASE event_type WHEN 'error' THEN 2001 ELSE 2002 END AS condition_concept_id,
        CAST(ts AS DATE) AS condition_start_date, CAST(CAST(ts AS DATE) + CAST(event_id % 4 AS INT) AS DATE) AS condition_end_date, event_type AS condition_source_value
        FROM events WHERE event_type IN ('error', 'signup')""",
    "measurement": """SELECT event_id AS measurement_id, user_id AS person_id, CASE event_type WHEN 'purchase' THEN 3001 WHEN 'click' THEN 3002 ELSE 3003 END AS measurement_concept_id,
        CAST(ts AS DATE) AS measurement_date, value AS value_as_number, CAST(8840 + event_id % 3 AS INT) AS unit_concept_id, event_type AS measurement_source_value
        FROM events WHERE event_type IN ('purchase', 'click', 'view')""",
    "concept": """SELECT 1000000 + p_partkey AS concept_id, p_name AS concept_name, CAST(p_partkey AS VARCHAR(20)) AS concept_code, 'Drug' AS domain_id, p_brand AS vocabulary_id,
        p_type AS concept_class_id, CASE WHEN p_partkey % 5 <> 0 THEN 'S' END AS standard_concept, CASE WHEN p_partkey % 17 = 0 THEN 'D' END AS invalid_reason FROM part
        UNION ALL SELECT DISTINCT 500000 + CAST(substring(p_brand, 7, 9) AS INT), p_brand, p_brand, 'Drug', 'Brand', 'Brand', 'S', CAST(NULL AS VARCHAR(1)) FROM part
        UNION ALL SELECT DISTINCT 600000 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END, p_type, p_type, 'Drug', 'Type', 'Type', 'C', CAST(NULL AS VARCHAR(1)) FROM part
        UNION ALL SELECT DISTINCT 9000 + CAST(substring(o_orderpriority, 1, 1) AS INT), o_orderpriority, o_orderpriority, 'Visit', 'Priority', 'Visit', 'S', CAST(NULL AS VARCHAR(1)) FROM orders
        UNION ALL SELECT 8507, 'MALE', 'M', 'Gender', 'Gender', 'Gender', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT 8532, 'FEMALE', 'F', 'Gender', 'Gender', 'Gender', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT r_regionkey + 1, r_name, r_name, 'Race', 'Race', 'Race', 'S', CAST(NULL AS VARCHAR(1)) FROM region
        UNION ALL SELECT 2001, 'error', 'error', 'Condition', 'Event', 'Event', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT 2002, 'signup', 'signup', 'Condition', 'Event', 'Event', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT 3001, 'purchase', 'purchase', 'Measurement', 'Event', 'Event', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT 3002, 'click', 'click', 'Measurement', 'Event', 'Event', 'S', CAST(NULL AS VARCHAR(1))
        UNION ALL SELECT 3003, 'view', 'view', 'Measurement', 'Event', 'Event', 'S', CAST(NULL AS VARCHAR(1))""",
    "concept_ancestor": """SELECT 500000 + CAST(substring(p_brand, 7, 9) AS INT) AS ancestor_concept_id, 1000000 + p_partkey AS descendant_concept_id, 1 AS min_levels_of_separation FROM part
        UNION ALL SELECT 600000 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END, 1000000 + p_partkey, 1 FROM part
        UNION ALL SELECT 1000000 + p_partkey, 1000000 + p_partkey, 0 FROM part""",
    "concept_relationship": """SELECT 1000000 + p_partkey AS concept_id_1, 1000001 + p_partkey AS concept_id_2, 'Maps to' AS relationship_id FROM part WHERE p_partkey % 5 = 0""",
    "concept_synonym": """SELECT 1000000 + p_partkey AS concept_id, p_type || ' ' || p_name AS concept_synonym_name FROM part""",
    "decision": """SELECT l_orderkey * 10 + l_linenumber AS decision_id, p_name AS source_value, CASE WHEN l_linenumber % 4 = 0 THEN 'rejected' WHEN l_linenumber % 4 = 1 THEN 'modified' ELSE 'approved' END AS action,
        1000000 + l_suppkey AS target_concept_id, CAST(l_quantity AS INT) % 5 AS user_id, CAST(l_shipdate AS DATE) AS created_on, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS synced,
        CASE l_linenumber % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'ingredient' ELSE 'sapbert' END AS suggestion_source, l_discount * 1000 AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def star_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    """The data model over the star-schema tables of a folder."""
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return Cdm({name: spark.sql(sql.replace("VARCHAR(20)", "STRING").replace("VARCHAR(1)", "STRING")) for name, sql in TABLE_SQL.items()})


def with_tables(sql: str, *names: str) -> str:
    """The adapter's tables as common table expressions before a SELECT of DuckDB."""
    wanted = [n for n in TABLE_SQL if n in names or (not names and n in sql)]
    head = ",\n".join(f"{n} AS ({TABLE_SQL[n].replace('VARCHAR(20)', 'VARCHAR').replace('VARCHAR(1)', 'VARCHAR')})" for n in wanted)
    sql = sql.strip()
    return f"WITH {head},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head}\n{sql}"
