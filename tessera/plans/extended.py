"""More registered queries, each with SQL for its rows; registered in the catalogue when it is asked for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import guards, scalars
from tessera.operators import cohort as co
from tessera.operators import details, drug_names, exports, lineage, mapping, stats
from tessera.plans.catalog import _DATED, B1, B2, EVENTS_SQL, _all, _base, _cdm, _people, _raw, _read, _risk, _tgt, _out, brand, measure
from tessera.sources.cdm import TABLE_SQL, Cdm

# ---------------------------------------------------------------------------------------------
# survival

_SURVIVAL = f"""t AS (SELECT person_id, min(d) AS d FROM {B1} a GROUP BY person_id),
 o AS (SELECT person_id, min(d) AS d FROM {B2} b GROUP BY person_id),
 q AS (SELECT t.person_id, t.d AS a, observation_period_end_date AS z, o.d AS x, year_of_birth, coalesce(concept_name, 'Unknown') AS gender
  FROM t JOIN observation_period p ON p.person_id = t.person_id AND t.d BETWEEN observation_period_start_date AND observation_period_end_date
  JOIN person pe ON pe.person_id = t.person_id LEFT JOIN concept ON concept_id = gender_concept_id LEFT JOIN o ON o.person_id = t.person_id),
 sv AS (SELECT person_id, ((CASE WHEN x BETWEEN a AND z THEN x ELSE z END) - a)::DOUBLE AS days, CASE WHEN x BETWEEN a AND z THEN 1 ELSE 0 END AS event, gender,
  CASE WHEN extract(year FROM a) - year_of_birth < 18 THEN '0-17' WHEN extract(year FROM a) - year_of_birth < 40 THEN '18-39'
   WHEN extract(year FROM a) - year_of_birth < 65 THEN '40-64' ELSE '65+' END AS age_group FROM q)"""
_survival = lambda cdm, unit="days": stats.survival_rows(cdm, _tgt(cdm), _out(cdm), None, unit)
_cdm("survival_rows", _survival, f"WITH {_SURVIVAL} SELECT person_id, days AS time, event, gender, age_group FROM sv WHERE days > 0")
_cdm("survival_months", lambda cdm: _survival(cdm, "months").select("person_id", F.round("time", 6).alias("months"), "event"), f"WITH {_SURVIVAL} SELECT person_id, round(days / 30.44, 6) AS months, event FROM sv WHERE days > 0")
_cdm("survival_years", lambda cdm: _survival(cdm, "years").select("person_id", F.round("time", 6).alias("years"), "event"), f"WITH {_SURVIVAL} SELECT person_id, round(days / 365.25, 6) AS years, event FROM sv WHERE days > 0")

#: For groups of one letter each: (O - E)^2 / V of each of them.
_TERMS_OF = """SELECT g, power(sum(d1) - sum(n1 * d * 1.0::DOUBLE / n), 2) / sum(CASE WHEN n > 1 THEN n1 * (n - n1)::DOUBLE * d * (n - d) / (n::DOUBLE * n * (n - 1)) ELSE 0 END) AS x FROM
 (SELECT gs.g, ts.t, count(*) AS n, sum(CASE WHEN r.t = ts.t THEN e ELSE 0 END) AS d, sum(CASE WHEN r.g = gs.g THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN r.t = ts.t AND r.g = gs.g THEN e ELSE 0 END) AS d1
  FROM (SELECT DISTINCT t FROM r WHERE e = 1) ts JOIN r ON r.t >= ts.t CROSS JOIN (SELECT DISTINCT g FROM r) gs GROUP BY gs.g, ts.t) y GROUP BY g"""
_AGES = ["18-39", "40-64", "65+"]
_cdm(
    "log_rank_age",
    lambda cdm: stats.log_rank(_survival(cdm).where(F.col("age_group").isin(_AGES)), "age_group", _AGES),
    f"""WITH {_SURVIVAL}, r AS (SELECT days AS t, event AS e, age_group AS g FROM sv WHERE days > 0 AND age_group IN ('18-39', '40-64', '65+')),
 tx AS ({_TERMS_OF}) SELECT round(sum(x), 4) AS chi_square, round(exp(-sum(x) / 2), 6) AS p_value, 2 AS df FROM tx WHERE g <> '65+'""",
)
# fixed values: a published rational approximation of the normal tail (Abramowitz and Stegun 26.2.17)
_TAIL = "exp(-x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
_cdm(
    "log_rank_gender",
    lambda cdm: stats.log_rank(_survival(cdm), "gender", ["FEMALE", "MALE"]),
    f"""WITH {_SURVIVAL}, r AS (SELECT days AS t, event AS e, gender AS g FROM sv WHERE days > 0), tx AS ({_TERMS_OF}),
 z AS (SELECT sum(x) AS x, 1 / (1 + 0.2316419 * sqrt(sum(x))) AS t FROM tx WHERE g = 'FEMALE')
 SELECT round(x, 4) AS chi_square, round(CASE WHEN x <= 0 THEN 1.0 ELSE 2 * {_TAIL} END, 6) AS p_value, 1 AS df FROM z""",
)

# ---------------------------------------------------------------------------------------------
# concepts

_cdm(
    "concept_details",
    lambda cdm: details.concept_details(cdm, 1000005),
    """SELECT 'concept' AS section, vocabulary_id AS key, concept_id AS related_id, concept_name AS related_name FROM concept WHERE concept_id = 1000005
 UNION ALL SELECT 'relation', relationship_id, concept_id, concept_name FROM concept_relationship JOIN concept ON concept_id = concept_id_2 WHERE concept_id_1 = 1000005
 UNION ALL SELECT 'synonym', NULL, concept_id, concept_synonym_name FROM concept_synonym WHERE concept_id = 1000005""",
)
_cdm(
    "concept_source_values",
    lambda cdm: details.concept_source_values(cdm, 2001),
    f"""SELECT domain, source_value, n_records, n_persons FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n_records DESC, source_value) AS k FROM (
  SELECT domain, source_value, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM ({EVENTS_SQL}) x WHERE concept_id = 2001 AND source_value IS NOT NULL GROUP BY 1, 2) y) z WHERE k <= 50""",
)
_SET = [{"concept_id": 500001}, {"concept_id": 600001, "is_excluded": True}, {"concept_id": 2001, "include_descendants": False}]
_cdm(
    "concept_set_counts",
    lambda cdm: details.concept_set_counts(cdm, _SET),
    f"""SELECT concept_id, sum(r)::BIGINT AS n_records, sum(p)::BIGINT AS n_persons FROM (SELECT domain, concept_id, count(*) AS r, count(DISTINCT person_id) AS p FROM ({EVENTS_SQL}) x
  WHERE (concept_id IN (500001, 2001) OR concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 500001))
   AND concept_id <> 600001 AND concept_id NOT IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 600001) GROUP BY 1, 2) y GROUP BY 1""",
)
_cdm(
    "concept_page",
    lambda cdm: details.concept_page(cdm, "gear", 10, 20),
    "SELECT concept_id, concept_name, (SELECT count(*) FROM concept WHERE lower(concept_name) LIKE '%gear%' OR lower(concept_code) LIKE '%gear%') AS total FROM concept WHERE lower(concept_name) LIKE '%gear%' OR lower(concept_code) LIKE '%gear%' ORDER BY concept_name, concept_id LIMIT 10 OFFSET 20",
)
_cdm(
    "code_labels",
    lambda cdm: details.code_labels(cdm.table("drug_exposure").select(F.concat(F.lit(" "), F.lower("drug_source_atc")).alias("source_atc")), cdm.table("concept").withColumn("concept_code", F.upper("concept_code")), "Brand"),
    "SELECT DISTINCT upper(concept_code) AS code, concept_name AS label FROM concept WHERE vocabulary_id = 'Brand' AND upper(concept_code) IN (SELECT upper(drug_source_atc) FROM drug_exposure)",
)
_cdm(
    "synonym_matches",
    lambda cdm: cdm.table("concept_synonym").where(scalars.folded(F.col("concept_synonym_name")).contains("gear")).join(cdm.table("concept"), "concept_id").select("concept_id", "concept_name", "concept_synonym_name").dropDuplicates(["concept_id"]),
    "SELECT c.concept_id, concept_name, concept_synonym_name FROM concept_synonym s JOIN concept c ON c.concept_id = s.concept_id WHERE lower(concept_synonym_name) LIKE '%gear%'",
)
_raw(
    "source_concept_counts",
    lambda spark, d: details.source_concept_counts(_sourced(spark, d), [0, 1, 2, 3, 4, 5]),
    """SELECT (event_id % 9)::BIGINT AS concept_id, count(*) AS n_source_records, count(DISTINCT user_id) AS n_source_persons FROM events WHERE event_type IN ('error', 'signup') AND event_id % 9 < 6 GROUP BY 1""",
)


def _sourced(spark, folder):
    """A model of one domain whose events carry source concepts."""
    rows = _read(spark, folder, "events").where("event_type in ('error', 'signup')")
    return Cdm({"condition_occurrence": rows.select(F.col("user_id").alias("person_id"), F.lit(1).alias("condition_concept_id"), (F.col("event_id") % 9).alias("condition_source_concept_id"), F.col("event_type").alias("condition_source_value"), F.to_date("ts").alias("condition_start_date"))})


# ---------------------------------------------------------------------------------------------
# members and visits

_DETAILED = {"inclusion": _all(brand(1), measure("purchase"))}
_MEMBERS = f"(SELECT person_id FROM {B1} x INTERSECT SELECT person_id FROM measurement WHERE measurement_concept_id = 3001)"
_cdm(
    "sample_details",
    lambda cdm: details.sample_details(cdm, _DETAILED),
    f"""WITH m AS {_MEMBERS},
 a AS (SELECT person_id, drug_source_value || ' — ' || drug_source_name AS v FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY drug_exposure_start_date, drug_concept_id, drug_source_value) AS k FROM drug_exposure
  WHERE drug_concept_id = 500001 OR drug_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 500001)) x WHERE k = 1),
 b AS (SELECT person_id, v FROM (SELECT person_id, value_as_number AS v, row_number() OVER (PARTITION BY person_id ORDER BY measurement_date, value_as_number) AS k FROM measurement WHERE measurement_concept_id = 3001) x WHERE k = 1)
 SELECT p.person_id, year_of_birth, a.v AS crit_0_code, 'purchase — purchase' AS crit_1_code, CAST(b.v AS VARCHAR) AS crit_1_value FROM m JOIN person p ON p.person_id = m.person_id LEFT JOIN a ON a.person_id = p.person_id LEFT JOIN b ON b.person_id = p.person_id""",
)
_DAYS = f"(SELECT coalesce(concept_name, 'Unknown') AS visit_type, greatest(visit_end_date - visit_start_date, 0) AS days FROM visit_occurrence LEFT JOIN concept ON concept_id = visit_concept_id WHERE person_id IN ({_people(B1)}))"
_MEASURES = "count(*) AS n_visits, round(avg(days), 1) AS mean_days, round(stddev_samp(days), 1) AS std_days, min(days) AS min_days, max(days) AS max_days, round(quantile_cont(days, 0.5), 1) AS median_days"
_cdm("visit_duration", lambda cdm: details.visit_duration(cdm, _base(cdm)), f"SELECT 'all' AS visit_type, {_MEASURES} FROM {_DAYS} x UNION ALL SELECT * FROM (SELECT visit_type, {_MEASURES} FROM {_DAYS} y GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) z")
_cdm(
    "domain_coverage",
    lambda cdm: details.domain_coverage(cdm, _base(cdm)),
    f"SELECT domain, count(DISTINCT person_id) AS n_persons, round(100.0 * count(DISTINCT person_id) / (SELECT count(*) FROM ({_people(B1)}) c), 1) AS pct FROM ({EVENTS_SQL}) x WHERE person_id IN ({_people(B1)}) GROUP BY 1",
)
_cdm(
    "cohort_same_visit_exclusion",
    lambda cdm: co.build_cohort(cdm, {"inclusion": _all(brand(1), brand(2), op="AND", sameVisit=True), "exclusion": _all(brand(3), sameVisit=True)}).select("person_id", "visit_occurrence_id"),
    f"SELECT person_id, visit_occurrence_id FROM {B1} a INTERSECT SELECT person_id, visit_occurrence_id FROM {B2} b EXCEPT SELECT person_id, visit_occurrence_id FROM {B1.replace('500001', '500003')} c",
)

# ---------------------------------------------------------------------------------------------
# mapping, logs and checks

_raw(
    "mapping_rates",
    lambda spark, d: details.mapping_rates(_read(spark, d, "lineitem").join(_read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("l_linenumber") % 4).alias("version"), F.col("p_name").alias("source_value")).agg(F.max((F.col("l_partkey") % 10 != 0).cast("int")).alias("mapped"), F.count("*").alias("n_records"))),
    """SELECT version, count(*) AS total_terms, count(CASE WHEN mapped = 0 THEN 1 END) AS unmapped_terms, round(100.0 * count(CASE WHEN mapped <> 0 THEN 1 END) / count(*), 2) AS pct_terms_mapped,
 round(100.0 * sum(CASE WHEN mapped <> 0 THEN n ELSE 0 END) / sum(n), 2) AS pct_rows_mapped FROM (SELECT l_linenumber % 4 AS version, p_name, max(CASE WHEN l_partkey % 10 <> 0 THEN 1 ELSE 0 END) AS mapped, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x GROUP BY 1""",
)
_cdm(
    "mapping_rollback",
    lambda cdm: _rolled_back(cdm).groupBy("drug_concept_id").agg(F.count("*").alias("n")),
    """WITH l AS (SELECT source_value, target_concept_id FROM (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY created_on DESC, decision_id DESC) AS k FROM decision WHERE action IN ('approved', 'modified')) x WHERE k = 1),
 ap AS (SELECT drug_source_value AS v, CASE WHEN drug_concept_id = 0 THEN coalesce(target_concept_id, 0) ELSE drug_concept_id END AS c FROM drug_exposure LEFT JOIN l ON source_value = drug_source_value)
 SELECT CASE WHEN target_concept_id = c THEN 0 ELSE c END AS drug_concept_id, count(*) AS n FROM ap LEFT JOIN l ON source_value = v GROUP BY 1""",
)


def _rolled_back(cdm):
    last = mapping.latest_decisions(cdm.table("decision"))
    return mapping.rollback_mappings(mapping.apply_mappings(cdm, "Drug", last), "Drug", last)


_raw("code_families", lambda spark, d: details.code_families(_read(spark, d, "part"), "p_name"), "SELECT substring(p_name, 1, 3) AS family, count(DISTINCT p_name) AS n_values FROM part WHERE length(trim(p_name)) >= 3 AND NOT regexp_full_match(p_name, '[\\W_]+') GROUP BY 1")
_raw(
    "newest_rows",
    lambda spark, d: details.newest([("event", _read(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("at"))), ("order", _read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at")))], 10),
    """SELECT kind, key, "at" FROM (SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS key, ts AS "at" FROM events UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderdate FROM orders) x ORDER BY "at" DESC, kind, key LIMIT 10""",
)
_raw("json_fields", lambda spark, d: details.json_fields(_read(spark, d, "events"), "props"), "SELECT key, count(*) AS n, sum(CAST(json_extract_string(props, key) AS BIGINT))::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) x GROUP BY 1")
_raw("read_only_sql", lambda spark, d: _selected(spark, d), "SELECT r_regionkey, r_name FROM region")
_raw(
    "csv_guard_spaces",
    lambda spark, d: _read(spark, d, "part").select("p_partkey", scalars.csv_guard(F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" \t="), "p_name", F.lit("  "))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("\t"), "p_name")).otherwise(F.concat(F.lit(" - "), "p_name"))).alias("cell")),
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '''=' || p_name WHEN p_partkey % 5 = 2 THEN p_name ELSE '''- ' || p_name END AS cell FROM part",
)
_raw("null_concat", lambda spark, d: _read(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), F.nullif("source", F.lit("src0"))).alias("place")), "SELECT doc_id, lang || '/' || nullif(source, 'src0') AS place FROM documents")


def _selected(spark, folder):
    _read(spark, folder, "region").createOrReplaceTempView("region")
    return guards.read_only(spark, "SELECT r_regionkey, r_name FROM region;")


# ---------------------------------------------------------------------------------------------
# exports

_CHOSEN = """yes AS (SELECT * FROM decision WHERE action IN ('approved', 'modified')),
 agreed AS (SELECT source_value, target_concept_id, string_agg(DISTINCT CAST(user_id AS VARCHAR), ';' ORDER BY CAST(user_id AS VARCHAR)) AS users, max((created_on, decision_id, user_id, confidence)) AS last
  FROM yes GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2),
 known AS (SELECT drug_source_value AS source_value, min(drug_concept_id) AS a, max(drug_concept_id) AS b FROM drug_exposure WHERE drug_concept_id > 0 GROUP BY 1),
 done AS (SELECT source_value FROM (SELECT source_value, max(synced) AS s, min(target_concept_id) AS lo, max(target_concept_id) AS hi FROM yes GROUP BY 1) x LEFT JOIN known USING (source_value)
  WHERE s = 1 OR (lo = hi AND a = b AND lo = a)),
 f AS (SELECT drug_source_value AS source_value, count(*) AS n FROM drug_exposure GROUP BY 1)"""
# of decisions that no sync has taken, or every term would be done
_OPEN = TABLE_SQL["decision"].replace("CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END", "0")
_cdm(
    "mapping_export",
    lambda cdm: exports.mapping_export(cdm, "Drug", cdm.table("decision").withColumn("synced", F.lit(0)), "Local"),
    f"""WITH {_CHOSEN.replace("FROM decision WHERE", f"FROM ({_OPEN}) dd WHERE")}
 SELECT g.source_value AS "sourceCode", g.source_value AS "sourceName", coalesce(n, 0) AS "sourceFrequency", 0 AS "sourceAutoAssignedConceptIds", '' AS "ADD_INFO:source_name_fr",
  nullif(last[4], 0) AS "ADD_INFO:matchScore", 'APPROVED' AS "mappingStatus", 'EQUAL' AS equivalence, users AS "statusSetBy", CAST(last[1] AS VARCHAR) AS "statusSetOn", g.target_concept_id AS "conceptId",
  coalesce(concept_name, '') AS "conceptName", 'Drug' AS "domainId", 'MAPS_TO' AS "mappingType", '' AS comment, CAST(last[3] AS VARCHAR) AS "createdBy", CAST(last[1] AS VARCHAR) AS "createdOn", '' AS "assignedReviewers",
  'Local' AS srce_vocabulary, coalesce(concept_code, '') AS concept_code, coalesce(concept_name, '') AS concept_name, 'Drug' AS domain_id, coalesce(vocabulary_id, '') AS vocabulary_id, coalesce(concept_class_id, '') AS concept_class_id,
  'S' AS standard_concept FROM agreed g LEFT JOIN f ON f.source_value = g.source_value LEFT JOIN concept ON concept_id = g.target_concept_id
  WHERE g.source_value NOT IN (SELECT source_value FROM done)""",
)
_cdm(
    "mapping_history",
    lambda cdm: exports.mapping_history(cdm.table("decision"), action="modified", user=3),
    """SELECT '' AS domain, source_value, '' AS source_name, action, target_concept_id, '' AS target_concept_name, '' AS target_vocabulary_id, CAST(NULL AS BIGINT) AS previous_concept_id, suggestion_source, confidence AS confidence_score,
 CAST(user_id AS VARCHAR) AS "user", '' AS reason, CAST(created_on AS VARCHAR) AS created_at FROM decision WHERE action = 'modified' AND user_id = 3""",
)
_AUDIT = (
    "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts", "concat('u', user_id) AS user", "array('r', concat('=', event_type)) AS roles", "concat('data.', event_type) AS action",
    "'GET' AS method", "concat('/x/', event_id) AS path", "200 AS status", "value AS duration_ms", "'' AS ip",
)
_raw(
    "audit_export",
    lambda spark, d: exports.audit_export(_read(spark, d, "events").selectExpr(*_AUDIT), "2024-01-02", "2024-01-20", action="data.c"),
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'u' || user_id AS "user", 'r,=' || event_type AS roles, 'data.' || event_type AS action, 'GET' AS method, '/x/' || event_id AS path, 200 AS status, value AS duration_ms, '' AS ip
 FROM events WHERE event_type LIKE 'c%' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'""",
)


# ---------------------------------------------------------------------------------------------
# drug names

_LABEL = "p_name || ' ' || p_size || ' MG ' || CASE p_partkey % 3 WHEN 0 THEN 'CPR' WHEN 1 THEN 'INJ' ELSE 'SIROP' END || ' (' || p_brand || ')'"
_CALLED = "p_name || ' ' || p_size || ' MG ' || CASE WHEN p_partkey % 4 < 2 THEN 'Oral Tablet' ELSE 'Injection' END || ' [' || p_brand || ']'"
_raw(
    "drug_name_parts",
    lambda spark, d: _read(spark, d, "part").select("p_partkey", drug_names.parsed(F.expr(_LABEL)).alias("p")).select("p_partkey", "p.ingredient", "p.dosage", F.array_join("p.forms", "|").alias("forms"), "p.brand"),
    """SELECT p_partkey, upper(p_name) AS ingredient, p_size || ' MG' AS dosage, CASE p_partkey % 3 WHEN 0 THEN 'Oral Tablet' WHEN 1 THEN 'Injectable|Injection' ELSE 'Oral Solution' END AS forms, upper(p_brand) AS brand FROM part""",
)
_raw(
    "suggest_by_name",
    lambda spark, d: drug_names.suggest_by_name(_labelled(spark, d), _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_value"), F.expr(_LABEL).alias("source_name")), "Drug"),
    f"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS source_value, {_LABEL} AS source_name, p_name AS g, p_size || ' MG' AS dose, p_partkey % 3 AS f, p_brand AS brand FROM part),
 n AS (SELECT DISTINCT g, dose, f, brand FROM t),
 c AS (SELECT p_partkey AS id, {_CALLED} AS nm, p_type || ' ' || p_name || ' ' || p_size || ' MG' AS syn, p_partkey % 2 = 0 AS dom FROM part),
 r AS (SELECT n.*, c.*, 0 AS turn FROM n JOIN c ON f <> 1 AND strpos(substring(nm, strpos(nm, g) + length(g)), dose) > 0 AND contains(nm, g)
  UNION ALL SELECT n.*, c.*, 1 FROM n JOIN c ON contains(nm, g)
  UNION ALL SELECT n.*, c.*, 4 FROM n JOIN c ON strpos(substring(syn, strpos(syn, g) + length(g)), dose) > 0 AND contains(syn, g)),
 b AS (SELECT *, turn < 4 AND contains(nm, brand) AS br, turn < 4 AND ((f = 0 AND contains(nm, 'Oral Tablet')) OR (f = 1 AND contains(nm, 'Injection'))) AS fo FROM r),
 k AS (SELECT *, row_number() OVER (PARTITION BY g, dose, f, brand, turn ORDER BY dom DESC, br DESC, fo DESC, length(nm), id) AS k FROM b),
 a AS (SELECT *, row_number() OVER (PARTITION BY g, dose, f, brand, id ORDER BY turn) AS again FROM k WHERE k <= 5),
 h AS (SELECT *, count(*) OVER (PARTITION BY g, dose, f, brand ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM a WHERE again = 1)
 SELECT source_value, source_name, id AS concept_id, nm AS concept_name, CASE WHEN turn < 4 THEN 'ingredient' ELSE 'synonym' END AS strategy,
  least(95, (CASE turn WHEN 0 THEN 85 ELSE 78 END) + (CASE WHEN br THEN 5 ELSE 0 END) + (CASE WHEN fo THEN 5 ELSE 0 END)) AS confidence FROM h JOIN t USING (g, dose, f, brand) WHERE had < 5""",
)


def _labelled(spark, folder):
    """A model of drug concepts that are named with dose, form and brand."""
    c = _read(spark, folder, "part")
    domain = F.when(F.col("p_partkey") % 2 == 0, "Drug").otherwise("Observation")
    concept = c.select(F.col("p_partkey").alias("concept_id"), F.expr(_CALLED).alias("concept_name"), domain.alias("domain_id"), F.lit("S").alias("standard_concept"), F.lit(None).cast("string").alias("invalid_reason"))
    synonym = c.select(F.col("p_partkey").alias("concept_id"), F.expr("p_type || ' ' || p_name || ' ' || p_size || ' MG'").alias("concept_synonym_name"))
    return Cdm({"concept": concept, "concept_synonym": synonym})


# ---------------------------------------------------------------------------------------------
# lineage documents: one for each customer, with a block for each order, and one more for each third order

_LAYERS, _SYSTEMS = {"app": "source", "stage": "staging", "final": "omop"}, ["app"]


def _documents(spark, folder):
    """(o_custkey, html): the orders of a customer as transformations of a table each."""
    no = F.col("o_orderkey").cast("string")
    head = lambda source, target: F.concat(F.lit("<table><tr><th><em>Source</em><br/>"), source, F.lit("</th> <th><em>Destination</em><br>"), target, F.lit("</th></tr>"))
    priority = F.substring("o_orderpriority", 1, 1)
    source = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("app.<b>p"), priority, F.lit("</b>"))).otherwise("class Parent")
    block = F.concat(
        F.lit("<h2 id='b'>1/1) Fichier 'stage.3_s"), priority, F.lit("_to_o.java'</h2>\n<h4>Order <i>"), no, F.lit("</i></h4>"), head(source, F.concat(F.lit("stage.o"), no)),
        F.lit("<tr><td>key</td><td>o_"), no, F.lit(" (NUMBER, 10)</td><td></td></tr></table><h4>SQL</h4><pre>select "), no, F.lit("</pre><h4>Clause WHERE</h4><pre>k = "), no, F.lit("</pre><h5>Clé primaire: 'k'</h5>"),
    )
    last = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<h2>1/1) Fichier 'final.x'</h2>"), head(F.concat(F.lit("final.o"), no), F.lit("final.person")), F.lit("</table>")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("b")))), lambda x: x.b), "")
    rows = _read(spark, folder, "orders").groupBy("o_custkey").agg(listed(block).alias("a"), listed(last).alias("z"))
    return rows.select("o_custkey", F.concat(F.lit("<h3>doc</h3><h1>1/2) Repertoire 'stage'</h1>"), "a", F.lit("<h1 class='x'>2/2) Repertoire 'final'</h1>"), "z").alias("html"))


_FROM = "CASE WHEN o_orderkey % 2 = 0 THEN 'app.p' ELSE 'stage.s' END || substring(o_orderpriority, 1, 1)"
_raw(
    "lineage_blocks",
    lambda spark, d: lineage.blocks(_documents(spark, d), "o_custkey", "html", ("final",)).select(
        "o_custkey", "block_no", "repertoire", "file", "description", "source_table", "dest_table", F.expr("columns[0].destination || ' ' || columns[0].type").alias("first_column"), "sql", "where_filter", "source_primary_key"
    ),
    f"""SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS block_no, 'stage' AS repertoire, 'stage.3_s' || substring(o_orderpriority, 1, 1) || '_to_o.java' AS file, 'Order ' || o_orderkey AS description,
 {_FROM} AS source_table, 'stage.o' || o_orderkey AS dest_table, 'o_' || o_orderkey || ' NUMBER, 10' AS first_column, 'select ' || o_orderkey AS sql, 'k = ' || o_orderkey AS where_filter, 'k' AS source_primary_key FROM orders""",
)


def _graph(spark, folder):
    found = lineage.blocks(_documents(spark, folder), "o_custkey", "html")
    return lineage.graph(found, "o_custkey", _LAYERS, _SYSTEMS, "final", "stage", ("person",))


_raw(
    "lineage_nodes",
    lambda spark, d: _graph(spark, d)[0],
    f"""SELECT DISTINCT o_custkey, {_FROM} AS "table", CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'staging' END AS layer, CASE WHEN o_orderkey % 2 = 0 THEN 'app' ELSE 'unknown' END AS system FROM orders
 UNION ALL SELECT DISTINCT o_custkey, 'stage.o' || o_orderkey, 'staging', 'stage' FROM orders UNION ALL SELECT DISTINCT o_custkey, 'final.person', 'omop', 'final' FROM orders WHERE o_orderkey % 3 = 0""",
)
_raw(
    "lineage_edges",
    lambda spark, d: _graph(spark, d)[1].select("o_custkey", "source", "target", "description", "n_columns"),
    f"""SELECT o_custkey, {_FROM} AS source, 'stage.o' || o_orderkey AS target, 'Order ' || o_orderkey AS description, 1 AS n_columns FROM orders
 UNION ALL SELECT o_custkey, 'stage.o' || o_orderkey, 'final.person', NULL, 0 FROM orders WHERE o_orderkey % 3 = 0""",
)
