"""The registered queries and, beside each, SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import cohort as co
from tessera.operators import lineage, mapping, pathways, quality, similarity, stats, vocabulary
from tessera.sources.cdm import Cdm, star_cdm, with_tables
from tessera.streaming.sessions import sessions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MAKES: dict[str, Callable[[Cdm], DataFrame]] = {}
YEAR = 2024


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cdm(name: str, make: Callable[[Cdm], DataFrame], sql: str | None = None) -> None:
    """Register a query over the data model; sql may name the model's tables."""
    _MAKES[name], _QUERIES[name] = make, lambda spark, sf_dir: make(star_cdm(spark, sf_dir))
    if sql:
        _SQL[name] = with_tables(sql)


def _raw(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = make
    if sql:
        _SQL[name] = sql


# ---------------------------------------------------------------------------------------------
# cohorts


def brand(n: int, **more) -> dict:
    return {"id": f"brand{n}", "domain": "Drug", "concepts": [500000 + n], **more}


def condition(name: str, **more) -> dict:
    return {"id": name, "domain": "Condition", "concepts": [{"error": 2001, "signup": 2002}[name]], "include_descendants": False, **more}


def measure(name: str, **more) -> dict:
    return {"id": name, "domain": "Measurement", "concepts": [{"purchase": 3001, "click": 3002, "view": 3003}[name]], "include_descendants": False, **more}


def type_(n: int, **more) -> dict:
    return {"id": f"type{n}", "domain": "Drug", "concepts": [600000 + n], **more}


def _drug(*ids: int) -> str:
    some = ", ".join(map(str, ids))
    return f"(SELECT person_id, visit_occurrence_id, drug_exposure_start_date AS d, drug_exposure_end_date AS e FROM drug_exposure WHERE drug_concept_id IN ({some}) OR drug_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({some})))"


B1, B2, B3 = (_drug(500000 + n) for n in (1, 2, 3))
ERR = "(SELECT person_id, condition_start_date AS d, condition_end_date AS e FROM condition_occurrence WHERE condition_concept_id = 2001)"
SGN = ERR.replace("2001", "2002")
PUR = "(SELECT person_id, measurement_date AS d, measurement_date AS e, value_as_number AS v FROM measurement WHERE measurement_concept_id = 3001)"
CLK = PUR.replace("3001", "3002")


def _people(sql: str) -> str:
    return f"SELECT DISTINCT person_id FROM {sql} x"


def _cohort(name: str, criteria: dict, sql: str) -> None:
    _cdm(name, lambda cdm, c=criteria: co.build_cohort(cdm, c), sql)


def _all(*items, op="AND", **more) -> dict:
    return {"operator": op, "criteria": list(items), **more}


FLAGSHIP = {"inclusion": _all(brand(1, occurrence={"type": "at_least", "count": 2})), "demographics": {"gender": [8507], "age": {"min": 20, "max": 80}}, "exclusion": _all(brand(2))}
FLAGSHIP_SQL = f"""SELECT person_id FROM {B1} x GROUP BY person_id HAVING count(*) >= 2
  INTERSECT SELECT person_id FROM person WHERE gender_concept_id = 8507 AND {YEAR} - year_of_birth BETWEEN 20 AND 80
  EXCEPT SELECT person_id FROM {B2} y"""
_cdm("cohort_flagship", lambda cdm: co.cohort_count(cdm, FLAGSHIP), f"SELECT count(*) AS n_persons FROM ({FLAGSHIP_SQL}) z")
_cohort("cohort_single", {"inclusion": _all(brand(1))}, _people(B1))
_cohort("cohort_no_descendants", {"inclusion": _all({"domain": "Drug", "concepts": [1000001, 1000002, 1000003], "include_descendants": False})}, "SELECT DISTINCT person_id FROM drug_exposure WHERE drug_concept_id IN (1000001, 1000002, 1000003)")
_cohort("cohort_source_codes", {"inclusion": _all({"domain": "Drug", "source_codes": ["hot gear", "Brand#4"]})}, "SELECT DISTINCT person_id FROM drug_exposure WHERE drug_source_value IN ('hot gear', 'Brand#4') OR drug_source_name IN ('hot gear', 'Brand#4') OR drug_source_atc IN ('hot gear', 'Brand#4')")
_cohort("cohort_concept_or_source", {"inclusion": _all({"domain": "Drug", "concepts": [500003], "source_codes": ["red widget"]})}, f"SELECT person_id FROM {B3} x UNION SELECT person_id FROM drug_exposure WHERE drug_source_value = 'red widget'")
_cohort("cohort_and", {"inclusion": _all(brand(1), brand(2))}, f"SELECT person_id FROM {B1} x INTERSECT SELECT person_id FROM {B2} y")
_cohort("cohort_or", {"inclusion": _all(brand(1), brand(2), op="OR")}, f"SELECT person_id FROM {B1} x UNION SELECT person_id FROM {B2} y")
_cohort("cohort_mixed_ops", {"inclusion": _all(brand(1, operatorWithNext="OR"), brand(2), brand(3))}, f"(SELECT person_id FROM {B1} x UNION SELECT person_id FROM {B2} y) INTERSECT SELECT person_id FROM {B3} z")
_cohort("cohort_nested", {"inclusion": {"operator": "AND", "criteria": [brand(1)], "groups": [_all(brand(2), brand(3), op="OR")]}}, f"SELECT person_id FROM {B1} x INTERSECT (SELECT person_id FROM {B2} y UNION SELECT person_id FROM {B3} z)")
_cohort("cohort_exclusion", {"inclusion": _all(brand(1)), "exclusion": _all(brand(2), brand(3))}, f"SELECT person_id FROM {B1} x EXCEPT (SELECT person_id FROM {B2} y INTERSECT SELECT person_id FROM {B3} z)")
_cohort("cohort_same_visit", {"inclusion": _all(brand(1), type_(1), sameVisit=True)}, f"SELECT DISTINCT a.person_id, a.visit_occurrence_id FROM {B1} a JOIN {_drug(600001)} b ON a.person_id = b.person_id AND a.visit_occurrence_id = b.visit_occurrence_id")
_cohort("cohort_value_between", {"inclusion": _all(measure("purchase", value={"operator": "between", "value": 100, "value_high": 110}))}, f"SELECT DISTINCT person_id FROM {PUR} x WHERE v BETWEEN 100 AND 110")
_cohort("cohort_value_above", {"inclusion": _all(measure("click", value={"operator": ">", "value": 250, "unit_concept_id": 8841}))}, "SELECT DISTINCT person_id FROM measurement WHERE measurement_concept_id = 3002 AND value_as_number > 250 AND unit_concept_id = 8841")
_cohort("cohort_abs_window", {"inclusion": _all(brand(1, temporal={"type": "absolute_window", "date_from": "1996-03-01", "date_to": "1996-09-30"}))}, f"SELECT DISTINCT person_id FROM {B1} x WHERE d BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'")
for _kind, _op, _n in (("at_least", ">=", 3), ("exactly", "=", 2), ("at_most", "<=", 1)):
    _cohort(f"cohort_{_kind}", {"inclusion": _all(brand(1, occurrence={"type": _kind, "count": _n}))}, f"SELECT person_id FROM {B1} x GROUP BY person_id HAVING count(*) {_op} {_n}")
_cohort("cohort_windowed_freq", {"inclusion": _all(condition("error", occurrence={"type": "at_least", "count": 4, "within_days": 5}))}, f"SELECT DISTINCT person_id FROM (SELECT person_id, count(*) OVER (PARTITION BY person_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 5 DAY FOLLOWING) AS n FROM {ERR} x) y WHERE n >= 4")
_cohort("cohort_initial_event", {"initial_event_criterion_id": "signup", "inclusion": _all(condition("signup"), condition("error", temporal={"type": "within_days", "relative_to": "index", "days_before": 2, "days_after": 1}))}, f"WITH s AS (SELECT person_id, min(d) AS i FROM {SGN} x GROUP BY person_id), r AS (SELECT person_id, min(d) AS d FROM {ERR} y GROUP BY person_id) SELECT DISTINCT s.person_id FROM s JOIN r ON s.person_id = r.person_id WHERE r.d BETWEEN i - INTERVAL 2 DAY AND i + INTERVAL 1 DAY")
_cdm("cohort_within_index", lambda cdm: co.CohortBuilder(cdm, {}).criterion(condition("error", temporal={"type": "within_days", "relative_to": "index", "days_after": 3})).select("person_id", "event_date").distinct(), f"WITH r AS (SELECT *, min(d) OVER (PARTITION BY person_id) AS i FROM {ERR} y) SELECT DISTINCT person_id, d AS event_date FROM r WHERE d <= i + INTERVAL 3 DAY")
ALLEN = {"before": "a.d < r.d", "after": "a.d > r.d", "starts_before": "a.d < r.d", "starts_after": "a.d > r.d", "ends_before": "a.e < r.e", "ends_after": "a.e > r.e", "overlaps": "a.d < r.e AND a.e > r.d", "contains": "a.d <= r.d AND a.e >= r.e", "during": "a.d >= r.d AND a.e <= r.e"}
for _name, _test in ALLEN.items():
    _first, _second = ("error", "purchase") if _name == "contains" else ("purchase", "error")
    _a, _r = (ERR, PUR) if _name == "contains" else (PUR, ERR)
    _made = {"condition": condition, "measurement": measure}
    _x = condition(_first, temporal={"type": "relative_to_criterion", "reference_criterion_id": _second, "relation": _name}) if _first == "error" else measure(_first, temporal={"type": "relative_to_criterion", "reference_criterion_id": _second, "relation": _name})
    _y = measure(_second) if _second == "purchase" else condition(_second)
    _cohort(f"allen_{_name}", {"inclusion": _all(_y, _x)}, f"WITH a AS (SELECT person_id, min(d) AS d, max(e) AS e FROM {_a} x GROUP BY person_id), r AS (SELECT person_id, min(d) AS d, max(e) AS e FROM {_r} y GROUP BY person_id) SELECT a.person_id FROM a JOIN r ON a.person_id = r.person_id WHERE {_test}")
_cohort("cohort_demographics", {"demographics": {"gender": [8532], "race": [1, 3], "ethnicity": [38003564], "age": {"min": 30, "max": 60}}}, f"SELECT person_id FROM person WHERE gender_concept_id = 8532 AND race_concept_id IN (1, 3) AND ethnicity_concept_id = 38003564 AND {YEAR} - year_of_birth BETWEEN 30 AND 60")
_cohort("cohort_age_at_index", {"inclusion": _all(brand(1)), "demographics": {"age": {"min": 18, "max": 40, "at": "index"}}}, f"SELECT p.person_id FROM person p JOIN (SELECT person_id, min(d) AS i FROM {B1} x GROUP BY person_id) y ON p.person_id = y.person_id WHERE extract(year FROM i) - year_of_birth BETWEEN 18 AND 40")
STEPS = {"inclusion": _all(brand(1), brand(2)), "exclusion": _all(brand(3)), "demographics": {"gender": [8507]}}
_M = "SELECT person_id FROM person WHERE gender_concept_id = 8507"
_cdm("cohort_attrition", lambda cdm: co.attrition(cdm, STEPS), f"""SELECT 0 AS step, 'all persons' AS label, count(*) AS n_persons FROM person
 UNION ALL SELECT 1, '+ brand1', count(*) FROM (SELECT person_id FROM {B1} a INTERSECT {_M}) x
 UNION ALL SELECT 2, '+ brand2', count(*) FROM (SELECT person_id FROM {B1} a INTERSECT SELECT person_id FROM {B2} b INTERSECT {_M}) x
 UNION ALL SELECT 3, '- brand3', count(*) FROM ((SELECT person_id FROM {B1} a INTERSECT SELECT person_id FROM {B2} b INTERSECT {_M}) EXCEPT SELECT person_id FROM {B3} c) x""")
_START = f"(SELECT t.person_id, min(drug_exposure_start_date) AS cohort_start_date FROM drug_exposure t WHERE t.person_id IN (SELECT person_id FROM {B1} b) GROUP BY t.person_id)"
_DATED = {"inclusion": _all(brand(1))}
_cdm("cohort_dated_eoo", lambda cdm: co.dated_cohort(cdm, _DATED, "Drug"), f"SELECT s.person_id, cohort_start_date, observation_period_end_date AS cohort_end_date FROM {_START} s JOIN observation_period o ON s.person_id = o.person_id")
_cdm("cohort_dated_fixed", lambda cdm: co.dated_cohort(cdm, _DATED | {"exit_criteria": {"type": "fixed_duration", "duration_days": 180}}, "Drug"), f"SELECT s.person_id, cohort_start_date, CAST(least(observation_period_end_date, cohort_start_date + INTERVAL 180 DAY) AS DATE) AS cohort_end_date FROM {_START} s JOIN observation_period o ON s.person_id = o.person_id")
_cdm("cohort_dated_event", lambda cdm: co.dated_cohort(cdm, _DATED | {"exit_criteria": {"type": "event_based", "exit_event": _all({"domain": "Visit", "concepts": [9001], "include_descendants": False})}}, "Drug"), f"""SELECT s.person_id, cohort_start_date, coalesce(CASE WHEN x > cohort_start_date THEN x END, observation_period_end_date) AS cohort_end_date
 FROM {_START} s JOIN observation_period o ON s.person_id = o.person_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date
 LEFT JOIN (SELECT person_id, min(visit_start_date) AS x FROM visit_occurrence WHERE person_id IN (SELECT person_id FROM visit_occurrence WHERE visit_concept_id = 9001) GROUP BY person_id) e ON s.person_id = e.person_id""")
_cdm("cohort_export", lambda cdm: co.cohort_export(cdm, _DATED), f"SELECT p.person_id, year_of_birth, coalesce(g.concept_name, 'Unknown') AS gender, coalesce(r.concept_name, 'Unknown') AS race, observation_period_start_date, observation_period_end_date FROM person p LEFT JOIN concept g ON g.concept_id = gender_concept_id AND g.domain_id = 'Gender' LEFT JOIN concept r ON r.concept_id = race_concept_id AND r.domain_id = 'Race' LEFT JOIN observation_period o ON o.person_id = p.person_id WHERE p.person_id IN ({_people(B1)})")
_cdm("cohort_sample", lambda cdm: co.cohort_sample(cdm, _DATED, 10))
_cdm("cohort_count_approx", lambda cdm: co.cohort_count_approx(cdm, _DATED))
_cdm("patient_journey", lambda cdm: co.patient_journey(cdm, 5), """SELECT domain, x.concept_id, coalesce(concept_name, 'Unknown') AS concept_name, event_date, event_end_date, source_value, value_as_number FROM (
 SELECT 'Drug' AS domain, drug_concept_id AS concept_id, drug_exposure_start_date AS event_date, drug_exposure_end_date AS event_end_date, drug_source_value AS source_value, CAST(NULL AS DOUBLE) AS value_as_number FROM drug_exposure WHERE person_id = 5
 UNION ALL SELECT 'Visit', visit_concept_id, visit_start_date, visit_end_date, visit_source_value, NULL FROM visit_occurrence WHERE person_id = 5
 UNION ALL SELECT 'Condition', condition_concept_id, condition_start_date, condition_end_date, condition_source_value, NULL FROM condition_occurrence WHERE person_id = 5
 UNION ALL SELECT 'Measurement', measurement_concept_id, measurement_date, measurement_date, measurement_source_value, value_as_number FROM measurement WHERE person_id = 5) x LEFT JOIN concept c ON c.concept_id = x.concept_id""")
_cdm("extract_person", lambda cdm: co.extract_table(cdm, co.build_cohort(cdm, _DATED), "visit_occurrence", ["visit_occurrence_id", "person_id", "visit_start_date"]), f"SELECT visit_occurrence_id, person_id, visit_start_date FROM visit_occurrence WHERE person_id IN ({_people(B1)})")
_cdm("extract_visit", lambda cdm: co.extract_table(cdm, co.build_cohort(cdm, {"inclusion": _all(brand(1), type_(1), sameVisit=True)}), "drug_exposure", ["drug_exposure_id", "person_id", "quantity"], True), f"SELECT drug_exposure_id, person_id, quantity FROM drug_exposure WHERE visit_occurrence_id IN (SELECT a.visit_occurrence_id FROM {B1} a JOIN {_drug(600001)} b ON a.person_id = b.person_id AND a.visit_occurrence_id = b.visit_occurrence_id)")
_raw("criteria_diff", lambda spark, _: co.criteria_diff(spark, FLAGSHIP, STEPS), "SELECT * FROM (VALUES ('inclusion', 'brand2', 'added'), ('inclusion', 'brand1', 'modified'), ('exclusion', 'brand3', 'added'), ('exclusion', 'brand2', 'removed'), ('demographics', 'demographics', 'modified')) t(section, criterion, change)")

# ---------------------------------------------------------------------------------------------
# data quality

EVENTS_SQL = """SELECT 'Condition' AS domain, person_id, condition_concept_id AS concept_id, condition_source_value AS source_value FROM condition_occurrence
 UNION ALL SELECT 'Drug', person_id, drug_concept_id, drug_source_value FROM drug_exposure
 UNION ALL SELECT 'Measurement', person_id, measurement_concept_id, measurement_source_value FROM measurement
 UNION ALL SELECT 'Visit', person_id, visit_concept_id, visit_source_value FROM visit_occurrence"""
_cdm("dq_dashboard", quality.dashboard, f"SELECT domain, count(*) AS n_records, count(DISTINCT person_id) AS n_persons, count(DISTINCT source_value) AS n_terms, count(DISTINCT CASE WHEN concept_id > 0 THEN source_value END) AS n_mapped_terms, round(100.0 * count(DISTINCT CASE WHEN concept_id > 0 THEN source_value END) / count(DISTINCT source_value), 2) AS pct_mapped FROM ({EVENTS_SQL}) x GROUP BY domain")
for _c in ("gender", "race"):
    _cdm(f"dq_person_{_c}", lambda cdm, c=_c: quality.person_counts(cdm, f"{c}_concept_id"), f"SELECT coalesce(concept_name, 'UNKNOWN') AS label, count(*) AS n_persons FROM person LEFT JOIN concept ON concept_id = {_c}_concept_id GROUP BY 1")
_cdm("dq_birth_year", quality.birth_years, f"SELECT year_of_birth, count(*) AS n_persons FROM person WHERE year_of_birth BETWEEN 1850 AND {YEAR} GROUP BY 1")
_PER = """per AS (SELECT o.person_id, observation_period_start_date AS s, observation_period_end_date AS e, make_date(year_of_birth, month_of_birth, day_of_birth) AS b, coalesce(concept_name, 'UNKNOWN') AS gender
 FROM observation_period o JOIN person p ON o.person_id = p.person_id LEFT JOIN concept ON concept_id = gender_concept_id)"""
_MONTHS = "((extract(year FROM {1}) - extract(year FROM {0})) * 12 + extract(month FROM {1}) - extract(month FROM {0}) - CASE WHEN extract(day FROM {1}) < extract(day FROM {0}) THEN 1 ELSE 0 END)"
_LEN = f"greatest(0, {_MONTHS.format('s', 'e')})"
_Q = ", ".join(f"round(quantile_cont(x, {p}), 4) AS p{int(p * 100)}" for p in quality.PERCENTS)
_PERS = ("person", "observation_period", "concept")
_cdm("obs_age_first", quality.obs_age_first, f"WITH {_PER} SELECT CAST(floor({_MONTHS.format('b', 's')} / 12.0) AS BIGINT) AS age, count(*) AS n_persons FROM per WHERE floor({_MONTHS.format('b', 's')} / 12.0) BETWEEN 0 AND 120 GROUP BY 1")
_cdm("obs_age_gender", quality.obs_age_gender, f"WITH {_PER} SELECT gender, count(x) AS n, round(avg(x), 4) AS mean, {_Q} FROM (SELECT gender, (s - b) / 365.25 AS x FROM per) y GROUP BY gender")
_cdm("obs_length", quality.obs_length, f"WITH {_PER} SELECT CAST(least({_LEN}, 120) AS INT) AS months, count(*) AS n_persons FROM per GROUP BY 1")
_cdm("obs_duration_gender", quality.obs_duration_gender, f"WITH {_PER} SELECT gender, count(x) AS n, round(avg(x), 4) AS mean, {_Q} FROM (SELECT gender, CAST({_LEN} AS DOUBLE) AS x FROM per) y GROUP BY gender")
_cdm("obs_cumulative", quality.obs_cumulative, f"WITH {_PER}, h AS (SELECT CAST(least({_LEN}, 120) AS INT) AS months, count(*) AS n FROM per GROUP BY 1) SELECT months, round(100.0 * sum(n) OVER (ORDER BY months DESC) / sum(n) OVER (), 2) AS pct FROM h")
_cdm("obs_continuous", quality.obs_continuous, "SELECT CAST(y AS INT) AS year, count(DISTINCT person_id) AS n_persons FROM observation_period, range(1990, 2030) t(y) WHERE observation_period_start_date <= make_date(y, 1, 1) AND observation_period_end_date >= make_date(y, 12, 31) GROUP BY 1")
_cdm("clin_global", lambda cdm: quality.domain_totals(cdm, "Drug"), "SELECT count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM drug_exposure")
_cdm("clin_monthly", lambda cdm: quality.monthly(cdm, "Drug"), "SELECT CAST(date_trunc('month', drug_exposure_start_date) AS DATE) AS month, count(*) AS n_records FROM drug_exposure GROUP BY 1")
_cdm("clin_rpp", lambda cdm: quality.records_per_person(cdm, "Drug", 40), "SELECT least(n, 40) AS n_records, count(*) AS n_persons FROM (SELECT person_id, count(*) AS n FROM drug_exposure GROUP BY 1) x GROUP BY 1")
_cdm("clin_top_concepts", lambda cdm: quality.top_concepts(cdm, "Drug", 20), "WITH r AS (SELECT d.*, c.concept_name FROM drug_exposure d JOIN concept c ON drug_concept_id = concept_id WHERE drug_concept_id > 0) SELECT drug_concept_id AS concept_id, concept_name, count(*) AS n_records, count(DISTINCT person_id) AS n_persons, string_agg(DISTINCT drug_source_value, ', ' ORDER BY drug_source_value) AS source_values FROM r GROUP BY 1, 2 ORDER BY n_records DESC, concept_id LIMIT 20")
_cdm("clin_mapping", lambda cdm: quality.mapping_rates(cdm, "Drug"), "SELECT count(DISTINCT drug_source_value) AS n_terms, count(DISTINCT CASE WHEN drug_concept_id > 0 THEN drug_source_value END) AS n_mapped_terms, count(*) AS n_rows, count(CASE WHEN drug_concept_id > 0 THEN 1 END) AS n_mapped_rows, count(CASE WHEN drug_concept_id IS NULL OR drug_concept_id = 0 THEN 1 END) AS n_unmapped_rows, round(100.0 * count(CASE WHEN drug_concept_id > 0 THEN 1 END) / count(*), 2) AS pct_rows FROM drug_exposure")
_cdm("clin_top_unmapped", lambda cdm: quality.top_unmapped(cdm, "Drug", 25), "SELECT drug_source_value AS source_value, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM drug_exposure WHERE drug_concept_id = 0 GROUP BY 1 ORDER BY n_records DESC, source_value LIMIT 25")
_grade = lambda n, ok, warn: f"round(CASE WHEN n > 0 THEN 100.0 * {n} / n ELSE 0 END, 4) AS pct, CASE WHEN 100.0 * {n} / n < {ok} THEN 'pass' WHEN 100.0 * {n} / n < {warn} THEN 'warning' ELSE 'fail' END AS status"
_DOMS = {"Condition": ("condition_occurrence", "condition_concept_id", "condition_start_date"), "Drug": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date"), "Measurement": ("measurement", "measurement_concept_id", "measurement_date"), "Visit": ("visit_occurrence", "visit_concept_id", "visit_start_date")}
_parts = " UNION ALL ".join(f"SELECT '{d}_unmapped', k, {_grade('k', 5, 20)} FROM (SELECT count(CASE WHEN {c} IS NULL OR {c} = 0 THEN 1 END) AS k, count(*) AS n FROM {t}) x UNION ALL SELECT '{d}_future', k, NULL, CASE WHEN k = 0 THEN 'pass' WHEN k < 100 THEN 'warning' ELSE 'fail' END FROM (SELECT count(CASE WHEN {day} > DATE '2024-06-30' THEN 1 END) AS k FROM {t}) x" for d, (t, c, day) in _DOMS.items())
_cdm("conformity", quality.conformity, f"""SELECT 'persons_without_observation' AS check_name, k AS n_violations, {_grade('k', 1, 10)} FROM (SELECT count(CASE WHEN o.person_id IS NULL THEN 1 END) AS k, count(*) AS n FROM person p LEFT JOIN observation_period o ON p.person_id = o.person_id) x
 UNION ALL SELECT 'unmapped_gender', 0, 0.0, 'pass' UNION ALL SELECT 'future_births', 0, NULL, 'pass' UNION ALL SELECT 'several_observation_periods', 0, NULL, 'pass'
 UNION ALL SELECT 'future_observation', k, NULL, CASE WHEN k = 0 THEN 'pass' ELSE 'warning' END FROM (SELECT count(*) AS k FROM observation_period WHERE observation_period_end_date > DATE '2024-06-30') x
 UNION ALL {_parts} UNION ALL SELECT 'Drug_orphan_visits', 0, NULL, 'pass'""")
_snap = lambda c: f"SELECT domain, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM ({EVENTS_SQL}) x WHERE {c} GROUP BY domain"
_SNAP = lambda cdm, c: quality._union([cdm.events(d).select(F.lit(d).alias("domain"), "person_id") for d in cdm.domains()]).where(c).groupBy("domain").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons"))
_cdm("snapshot_compare", lambda cdm: quality.compare_snapshots(_SNAP(cdm, "person_id % 10 < 9"), _SNAP(cdm, "person_id % 10 > 0 and person_id % 5 <> 1"), "domain"), f"""WITH a AS (SELECT domain, unnest(['n_records', 'n_persons']) AS metric, CAST(unnest([n_records, n_persons]) AS DOUBLE) AS value_a FROM ({_snap('person_id % 10 < 9')}) q),
 b AS (SELECT domain, unnest(['n_records', 'n_persons']) AS metric, CAST(unnest([n_records, n_persons]) AS DOUBLE) AS value_b FROM ({_snap('person_id % 10 > 0 AND person_id % 5 <> 1')}) q)
 SELECT domain, metric, value_a, value_b, round((value_b - value_a) / abs(value_a) * 100, 4) AS pct_change, CASE WHEN abs(round((value_b - value_a) / abs(value_a) * 100, 4)) > 10 THEN 'critical' WHEN abs(round((value_b - value_a) / abs(value_a) * 100, 4)) > 5 THEN 'warning' END AS alert FROM a FULL JOIN b USING (domain, metric)""")

# ---------------------------------------------------------------------------------------------
# characterization and comparison

_in = f"person_id IN ({_people(B1)})"
_base = lambda cdm: co.build_cohort(cdm, _DATED)
_cdm("t1_age", lambda cdm: quality.t1_age(cdm, _base(cdm)), f"SELECT count(a) AS n, round(avg(a), 4) AS mean, round(stddev_samp(a), 4) AS sd, min(a) AS min, max(a) AS max, quantile_cont(a, 0.25) AS p25, quantile_cont(a, 0.5) AS p50, quantile_cont(a, 0.75) AS p75 FROM (SELECT {YEAR} - year_of_birth AS a FROM person WHERE {_in}) x")
_case = " ".join(f"WHEN a BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in quality.AGE_GROUPS)
_cdm("t1_age_groups", lambda cdm: quality.t1_age_groups(cdm, _base(cdm)), f"SELECT CASE {_case} ELSE 'Other' END AS age_group, count(*) AS n_persons FROM (SELECT {YEAR} - year_of_birth AS a FROM person WHERE {_in}) x GROUP BY 1")
_cdm("t1_categoricals", lambda cdm: quality.t1_categoricals(cdm, _base(cdm)), " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(concept_name, 'Unknown') AS label, count(*) AS n_persons FROM person LEFT JOIN concept ON concept_id = {f}_concept_id WHERE {_in} GROUP BY 2" for f in ("gender", "race", "ethnicity")))
_cdm("t1_prevalence", lambda cdm: quality.t1_prevalence(cdm, _base(cdm)), f"SELECT domain, concept_id, concept_name, n_persons, round(100.0 * n_persons / (SELECT count(*) FROM ({_people(B1)}) c), 2) AS pct FROM (SELECT domain, x.concept_id, concept_name, count(DISTINCT person_id) AS n_persons, row_number() OVER (PARTITION BY domain ORDER BY count(DISTINCT person_id) DESC, x.concept_id) AS k FROM ({EVENTS_SQL}) x JOIN concept c ON c.concept_id = x.concept_id WHERE x.concept_id > 0 AND {_in} GROUP BY 1, 2, 3) y WHERE k <= 25")
_cdm("t1_measurements", lambda cdm: quality.t1_measurements(cdm, _base(cdm)), f"WITH r AS (SELECT measurement_concept_id AS concept_id, concept_name, person_id, value_as_number AS v, unit_concept_id AS u FROM measurement JOIN concept ON concept_id = measurement_concept_id WHERE {_in}), u AS (SELECT concept_id, u, row_number() OVER (PARTITION BY concept_id ORDER BY count(*) DESC, u) AS k FROM r GROUP BY 1, 2) SELECT r.concept_id, concept_name, count(*) AS n, count(DISTINCT person_id) AS n_persons, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.5), 4) AS median, min(v) AS min, max(v) AS max, max(u.u) AS unit FROM r JOIN u ON r.concept_id = u.concept_id AND k = 1 GROUP BY 1, 2")
_cdm("t1_visits", lambda cdm: quality.t1_visits(cdm, _base(cdm)), f"SELECT visit_concept_id AS concept_id, coalesce(concept_name, 'Unknown') AS label, count(*) AS n_visits, count(DISTINCT person_id) AS n_persons, round(avg(x), 4) AS mean_days, quantile_cont(x, 0.5) AS median_days, max(x) AS max_days FROM (SELECT *, CAST(greatest(visit_end_date - visit_start_date, 0) AS DOUBLE) AS x FROM visit_occurrence WHERE {_in}) v LEFT JOIN concept ON concept_id = visit_concept_id GROUP BY 1, 2")
_cdm("t1_obs_period", lambda cdm: quality.t1_obs_period(cdm, _base(cdm)), f"SELECT count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS median, min(observation_period_start_date) AS earliest, max(observation_period_end_date) AS latest FROM (SELECT *, CAST(observation_period_end_date - observation_period_start_date AS DOUBLE) AS x FROM observation_period WHERE {_in}) y")


def _smd_continuous(cdm: Cdm) -> DataFrame:
    a, b = (quality.t1_age(cdm, co.build_cohort(cdm, {"inclusion": _all(brand(n))})).select(F.lit("age").alias("variable"), F.col("mean").alias(f"mean_{s}"), F.col("sd").alias(f"sd_{s}")) for n, s in ((1, "a"), (2, "b")))
    both = a.join(b, "variable", "full_outer")
    return both.withColumn("smd", F.round(stats.smd_continuous(F.col("mean_a"), F.col("sd_a"), F.col("mean_b"), F.col("sd_b")), 4))


def _smd_categorical(cdm: Cdm) -> DataFrame:
    def shares(n: int, s: str) -> DataFrame:
        rows = quality.t1_categoricals(cdm, co.build_cohort(cdm, {"inclusion": _all(brand(n))})).where("field <> 'ethnicity'")
        size = rows.where("field = 'gender'").agg(F.sum("n_persons").alias("size"))
        return rows.select("field", "label", (F.col("n_persons") / size.scalar()).alias(f"p_{s}"))

    both = shares(1, "a").join(shares(2, "b"), ["field", "label"], "full_outer").na.fill(0.0)
    return both.select("field", "label", F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"), F.round(stats.smd_binary(F.col("p_a"), F.col("p_b")), 4).alias("smd"))


_age = lambda b: f"SELECT round(avg(a), 4) AS m, round(stddev_samp(a), 4) AS s FROM (SELECT {YEAR} - year_of_birth AS a FROM person WHERE person_id IN ({_people(b)})) x"
_cdm("smd_continuous", _smd_continuous, f"SELECT 'age' AS variable, x.m AS mean_a, x.s AS sd_a, y.m AS mean_b, y.s AS sd_b, round((x.m - y.m) / sqrt((x.s * x.s + y.s * y.s) / 2), 4) AS smd FROM ({_age(B1)}) x, ({_age(B2)}) y")
_share = lambda b: " UNION ALL ".join(f"SELECT '{f}' AS field, concept_name AS label, count(*) * 1.0 / (SELECT count(*) FROM ({_people(b)}) z) AS p FROM person JOIN concept ON concept_id = {f}_concept_id WHERE person_id IN ({_people(b)}) GROUP BY 2" for f in ("gender", "race"))
_cdm("smd_categorical", _smd_categorical, f"SELECT field, label, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round(CASE WHEN pa * (1 - pa) + pb * (1 - pb) > 0 THEN (pa - pb) / sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2) WHEN pa = pb THEN 0 END, 4) AS smd FROM (SELECT field, label, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb FROM ({_share(B1)}) x FULL JOIN ({_share(B2)}) y USING (field, label)) q")

# ---------------------------------------------------------------------------------------------
# pathways

_EVENTS = [{"name": n, "domain": d, "concept_ids": [c], "include_descendants": False} for n, d, c in (("error", "Condition", 2001), ("signup", "Condition", 2002), ("purchase", "Measurement", 3001))]
_target = lambda cdm: cdm.table("condition_occurrence").select("person_id").distinct()
_eras = lambda cdm: pathways.eras(pathways.pathway_events(cdm, _target(cdm), _EVENTS), 1)
_ERAS = """ev AS (SELECT x.* FROM (SELECT person_id, condition_source_value AS event_name, condition_start_date AS s, condition_end_date AS e FROM condition_occurrence UNION ALL SELECT person_id, 'purchase', measurement_date, measurement_date FROM measurement WHERE measurement_concept_id = 3001) x
  JOIN observation_period o ON x.person_id = o.person_id WHERE x.s BETWEEN observation_period_start_date AND observation_period_end_date AND x.person_id IN (SELECT person_id FROM condition_occurrence)),
 mk AS (SELECT *, lag(e) OVER (PARTITION BY person_id, event_name ORDER BY s, e) AS b FROM ev),
 nm AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, event_name ORDER BY s, e) AS k FROM mk),
 era AS (SELECT person_id, event_name, min(s) AS era_start, max(e) AS era_end FROM nm GROUP BY person_id, event_name, k)"""
_STEP = f"{_ERAS}, st AS (SELECT person_id, step, string_agg(DISTINCT event_name, '+' ORDER BY event_name) AS label FROM (SELECT *, dense_rank() OVER (PARTITION BY person_id ORDER BY era_start) AS step FROM era) r WHERE step <= 4 GROUP BY 1, 2)"
_cdm("pathway_eras", _eras, f"WITH {_ERAS} SELECT * FROM era")
_cdm("pathway_steps", lambda cdm: pathways.steps(_eras(cdm), 4), f"WITH {_STEP} SELECT person_id, CAST(step AS INT) AS step, label FROM st")
_size = lambda cdm: _target(cdm).agg(F.count("*")).scalar()
_paths = lambda cdm: pathways.sequences(pathways.steps(_eras(cdm), 4))
_PATH = f"{_STEP}, pa AS (SELECT person_id, string_agg(label, ' > ' ORDER BY step) AS pathway FROM st GROUP BY 1), sz AS (SELECT count(DISTINCT person_id) AS n FROM condition_occurrence)"
_cdm("pathway_table", lambda cdm: pathways.pathway_table(_paths(cdm), _size(cdm), 1), f"WITH {_PATH} SELECT pathway, count(*) AS n_persons, round(100.0 * count(*) / (SELECT n FROM sz), 2) AS pct FROM pa GROUP BY 1")
_cdm("pathway_sunburst", lambda cdm: pathways.sunburst(_paths(cdm), _size(cdm), 2), f"WITH {_PATH}, px AS (SELECT person_id, step AS depth, string_agg(label, ' > ') OVER (PARTITION BY person_id ORDER BY step) AS prefix FROM st) SELECT prefix, CAST(depth AS INT) AS depth, count(*) AS n_persons, round(100.0 * count(*) / (SELECT n FROM sz), 2) AS pct FROM px GROUP BY 1, 2 HAVING count(*) >= 2")

# ---------------------------------------------------------------------------------------------
# incidence and survival

_tgt = lambda cdm: co.dated_cohort(cdm, _DATED, "Drug", "matching")
_out = lambda cdm: co.dated_cohort(cdm, {"inclusion": _all(brand(2))}, "Drug", "matching")
_GROUPS = [(0, 39, "0-39"), (40, 64, "40-64"), (65, 200, "65+")]


def _risk(clean: int = 0) -> str:
    anti = f" AND NOT EXISTS (SELECT 1 FROM o x WHERE x.person_id = t.person_id AND x.d < t.d AND x.d >= t.d - INTERVAL {clean} DAY)" if clean else ""
    return f"""t AS (SELECT person_id, min(d) AS d FROM {B1} a GROUP BY person_id), o AS (SELECT person_id, min(d) AS d FROM {B2} b GROUP BY person_id),
 q AS (SELECT t.person_id, t.d AS a, least(observation_period_end_date, CAST(t.d + INTERVAL 365 DAY AS DATE)) AS z, o.d AS x, year_of_birth, concept_name AS gender_name FROM t JOIN observation_period p ON p.person_id = t.person_id AND t.d BETWEEN observation_period_start_date AND observation_period_end_date
  JOIN person pe ON pe.person_id = t.person_id JOIN concept ON concept_id = gender_concept_id LEFT JOIN o ON o.person_id = t.person_id WHERE t.d < observation_period_end_date{anti}),
 rr AS (SELECT person_id, CASE WHEN x BETWEEN a AND z THEN 1 ELSE 0 END AS had_outcome, CAST((CASE WHEN x BETWEEN a AND z THEN x ELSE z END) - a AS DOUBLE) AS time_days, CAST(extract(year FROM a) - year_of_birth AS INT) AS age, gender_name, CAST(extract(year FROM a) AS INT) AS calendar_year FROM q),
 risk AS (SELECT * FROM rr WHERE time_days > 0)"""


_rows = lambda cdm, clean=0: stats.risk_rows(cdm, _tgt(cdm), _out(cdm), 0, 365, clean)
_RATE = "SELECT stratum, value, count(*) AS target_count, sum(had_outcome)::BIGINT AS outcome_count, round(sum(time_days) / 365.25, 4) AS person_years, round(sum(had_outcome) / (sum(time_days) / 365.25), 6) AS rate, round(sum(had_outcome) * 1.0 / count(*), 6) AS proportion, round(CASE WHEN sum(had_outcome) > 0 THEN greatest(0, sum(had_outcome) / (sum(time_days) / 365.25) - 1.96 * sqrt(sum(had_outcome)) / (sum(time_days) / 365.25)) ELSE 0 END, 6) AS ci_lower, round(CASE WHEN sum(had_outcome) > 0 THEN sum(had_outcome) / (sum(time_days) / 365.25) + 1.96 * sqrt(sum(had_outcome)) / (sum(time_days) / 365.25) ELSE 0 END, 6) AS ci_upper FROM ({0}) s GROUP BY 1, 2"
_ALL = "SELECT 'overall' AS stratum, 'all' AS value, had_outcome, time_days FROM risk"
_cdm("incidence_rows", _rows, f"WITH {_risk()} SELECT * FROM risk")
_cdm("incidence_overall", lambda cdm: stats.incidence(_rows(cdm)), f"WITH {_risk()} {_RATE.format(_ALL)}")
_cdm("incidence_strata", lambda cdm: stats.incidence(_rows(cdm), ["gender_name", "age_group", "calendar_year"], _GROUPS), f"WITH {_risk()} {_RATE.format(_ALL + ' UNION ALL SELECT %s' % (chr(39) + 'gender_name' + chr(39) + ', gender_name, had_outcome, time_days FROM risk') + ' UNION ALL SELECT ' + chr(39) + 'age_group' + chr(39) + ', CASE WHEN age BETWEEN 0 AND 39 THEN ' + repr('0-39') + ' WHEN age BETWEEN 40 AND 64 THEN ' + repr('40-64') + ' WHEN age BETWEEN 65 AND 200 THEN ' + repr('65+') + ' ELSE ' + repr('Other') + ' END, had_outcome, time_days FROM risk UNION ALL SELECT ' + repr('calendar_year') + ', CAST(calendar_year AS VARCHAR), had_outcome, time_days FROM risk')}")
_cdm("incidence_clean_window", lambda cdm: stats.incidence(_rows(cdm, 180)), f"WITH {_risk(180)} {_RATE.format(_ALL)}")
_km = lambda cdm: _rows(cdm).select(F.col("time_days").alias("time"), F.col("had_outcome").alias("event"), F.col("gender_name").alias("gender"))


def _km_sql(by: str) -> str:
    part = "PARTITION BY gender " if by else ""
    return f"""WITH {_risk()}, r AS (SELECT time_days AS time, had_outcome AS event, gender_name AS gender FROM risk),
 tb AS (SELECT {by}time, sum(event)::BIGINT AS events, sum(1 - event)::BIGINT AS censored, count(*) AS n FROM r GROUP BY ALL),
 ar AS (SELECT *, (sum(n) OVER ({part}ORDER BY time DESC))::BIGINT AS at_risk FROM tb),
 cv AS (SELECT *, max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER ({part}ORDER BY time) AS gone, sum(CASE WHEN events < at_risk THEN ln(1 - events * 1.0::DOUBLE / at_risk) ELSE 0 END) OVER ({part}ORDER BY time) AS lg, sum(CASE WHEN events < at_risk THEN events * 1.0::DOUBLE / (at_risk * (at_risk - events)) ELSE 0 END) OVER ({part}ORDER BY time) AS g FROM ar WHERE events > 0),
 sv AS (SELECT *, CASE WHEN gone = 1 THEN 0 ELSE exp(lg) END AS s FROM cv),
 km AS (SELECT {by}time, round(s, 6) AS survival, round(greatest(0, s - 1.96 * s * sqrt(g)), 6) AS ci_lower, round(least(1, s + 1.96 * s * sqrt(g)), 6) AS ci_upper, at_risk, events, censored FROM sv
  UNION ALL SELECT {by}0.0, 1.0, 1.0, 1.0, count(*), 0, 0 FROM r GROUP BY ALL)"""


_cdm("km_curve", lambda cdm: stats.kaplan_meier(_km(cdm)), f"{_km_sql('')} SELECT * FROM km")
_cdm("km_strata", lambda cdm: stats.kaplan_meier(_km(cdm), ["gender"]), f"{_km_sql('gender, ')} SELECT * FROM km")
_cdm("km_median", lambda cdm: stats.median_survival(stats.kaplan_meier(_km(cdm), ["gender"]), ["gender"]), f"{_km_sql('gender, ')} SELECT gender, min(CASE WHEN survival <= 0.5 THEN time END) AS median_time FROM km GROUP BY 1")
_cdm("log_rank", lambda cdm: stats.log_rank(_km(cdm), "gender", ["FEMALE", "MALE"]).select("chi_square", "df"), f"""WITH {_risk()}, r AS (SELECT time_days AS t, had_outcome AS e, gender_name AS g FROM risk), ts AS (SELECT DISTINCT t FROM r WHERE e = 1),
 tt AS (SELECT ts.t, count(*) AS n, sum(CASE WHEN r.t = ts.t THEN e ELSE 0 END) AS d, sum(CASE WHEN g = 'FEMALE' THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN r.t = ts.t AND g = 'FEMALE' THEN e ELSE 0 END) AS d1 FROM ts JOIN r ON r.t >= ts.t GROUP BY ts.t)
 SELECT round(power(sum(d1) - sum(n1 * d * 1.0::DOUBLE / n), 2) / sum(CASE WHEN n > 1 THEN n1 * (n - n1)::DOUBLE * d * (n - d) / (n::DOUBLE * n * (n - 1)) ELSE 0 END), 4) AS chi_square, 1 AS df FROM tt""")

# ---------------------------------------------------------------------------------------------
# vocabulary

_cdm("concept_search", lambda cdm: vocabulary.concept_search(cdm, "red wid", domain="Drug", limit=20).select("concept_id", "concept_name", "standard_concept"), "SELECT concept_id, concept_name, standard_concept FROM concept WHERE (lower(concept_name) LIKE '%red wid%' OR lower(concept_code) LIKE '%red wid%') AND domain_id = 'Drug' AND invalid_reason IS NULL ORDER BY CASE WHEN standard_concept = 'S' THEN 0 ELSE 1 END, length(concept_name), concept_name, concept_id LIMIT 20")
_cdm("hierarchy", lambda cdm: vocabulary.concept_hierarchy(cdm, 500003), "SELECT 'descendant' AS direction, c.concept_id, concept_name, levels FROM (SELECT descendant_concept_id AS concept_id, min_levels_of_separation AS levels FROM concept_ancestor WHERE ancestor_concept_id = 500003 AND descendant_concept_id <> 500003 ORDER BY 2, 1 LIMIT 200) x JOIN concept c ON c.concept_id = x.concept_id")
_cdm("concept_counts", lambda cdm: vocabulary.concept_counts(cdm, [2001, 3001, 9001, 1000003]), f"SELECT concept_id, sum(r)::BIGINT AS n_records, sum(p)::BIGINT AS n_persons FROM (SELECT domain, concept_id, count(*) AS r, count(DISTINCT person_id) AS p FROM ({EVENTS_SQL}) x WHERE concept_id IN (2001, 3001, 9001, 1000003) GROUP BY 1, 2) y GROUP BY 1")
_cdm("concept_facets", lambda cdm: vocabulary.facets(cdm, "vocabulary_id"), "SELECT vocabulary_id, count(*) AS n_concepts FROM concept GROUP BY 1")
_cdm("concept_set_resolve", lambda cdm: vocabulary.concept_set(cdm, [{"concept_id": 500001}, {"concept_id": 600001, "is_excluded": True}]), "SELECT CAST(500001 AS BIGINT) AS concept_id UNION SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 500001 EXCEPT SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 600001")
_cdm("source_value_cache", vocabulary.source_values, "SELECT x.*, concept_name, vocabulary_id, standard_concept FROM (SELECT domain, source_value, source_name, source_atc, concept_id, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM (SELECT 'Drug' AS domain, person_id, drug_concept_id AS concept_id, drug_source_value AS source_value, drug_source_name AS source_name, drug_source_atc AS source_atc FROM drug_exposure UNION ALL SELECT 'Condition', person_id, condition_concept_id, condition_source_value, NULL, NULL FROM condition_occurrence UNION ALL SELECT 'Measurement', person_id, measurement_concept_id, measurement_source_value, NULL, NULL FROM measurement UNION ALL SELECT 'Visit', person_id, visit_concept_id, visit_source_value, NULL, NULL FROM visit_occurrence) q GROUP BY ALL) x LEFT JOIN concept c ON c.concept_id = x.concept_id")
_cdm("source_value_search", lambda cdm: vocabulary.source_value_search(cdm, "gear", 20), f"SELECT domain, source_value, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM ({EVENTS_SQL}) x WHERE lower(source_value) LIKE '%gear%' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
_cdm("global_search", lambda cdm: vocabulary.global_search(cdm, "gear"), f"SELECT * FROM (SELECT 'concept' AS kind, CAST(concept_id AS VARCHAR) AS key, concept_name AS label FROM concept WHERE (lower(concept_name) LIKE '%gear%' OR lower(concept_code) LIKE '%gear%') AND invalid_reason IS NULL ORDER BY CASE WHEN standard_concept = 'S' THEN 0 ELSE 1 END, length(concept_name), concept_name, concept_id LIMIT 10) a UNION ALL SELECT 'source value', source_value, domain FROM (SELECT domain, source_value, count(*) AS n FROM ({EVENTS_SQL}) x WHERE lower(source_value) LIKE '%gear%' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10) b")
_raw("codebook_labels", lambda spark, d: vocabulary.codebook_labels(_read(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("code"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("").alias("description"))), "WITH c AS (SELECT p_brand AS name, p_type AS code, CASE WHEN p_size > 5 THEN p_name ELSE '' END AS description FROM part), s AS (SELECT name, count(*) AS n FROM c GROUP BY 1) SELECT code, description AS label FROM (SELECT code, description, row_number() OVER (PARTITION BY code ORDER BY n DESC, c.name, description) AS k FROM c JOIN s ON c.name = s.name WHERE trim(description) <> '') x WHERE k = 1")

# ---------------------------------------------------------------------------------------------
# mapping

_UN = "(SELECT drug_source_value AS source_value, min(drug_source_name) AS source_name, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM drug_exposure WHERE drug_concept_id = 0 GROUP BY 1)"
_YES = "action IN ('approved', 'modified')"
_cdm("list_unmapped", lambda cdm: mapping.list_unmapped(cdm, "Drug"), f"SELECT * FROM {_UN} x")
_terms = lambda cdm: cdm.table("concept").where("domain_id = 'Drug'").select(F.col("concept_code").alias("source_value"), F.upper("concept_name").alias("source_name"))
_TERMS = "(SELECT concept_code AS source_value, upper(concept_name) AS source_name FROM concept WHERE domain_id = 'Drug')"
_OK = "standard_concept = 'S' AND invalid_reason IS NULL AND domain_id = 'Drug'"
_EXACT = f"SELECT source_value, concept_id, concept_name, 'exact' AS strategy, 95 AS confidence FROM {_TERMS} t JOIN concept ON concept_code = source_value WHERE {_OK}"
_REL = f"SELECT DISTINCT source_value, c2.concept_id, c2.concept_name, 'relationship' AS strategy, 85 AS confidence FROM {_TERMS} t JOIN concept c1 ON c1.concept_code = source_value JOIN concept_relationship ON concept_id_1 = c1.concept_id JOIN (SELECT * FROM concept WHERE {_OK}) c2 ON c2.concept_id = concept_id_2"
_ING = f"""SELECT source_value, concept_id, concept_name, 'ingredient' AS strategy, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY confidence DESC, length(concept_name), concept_id) AS k FROM (
 SELECT source_value, concept_id, concept_name, CASE WHEN lower(concept_name) = lower(g) THEN 85 ELSE 78 END AS confidence FROM (SELECT source_value, trim(regexp_replace(source_name, '\\s*\\d.*$', '')) AS g FROM {_TERMS} q) t JOIN concept ON list_contains(string_split(lower(concept_name), ' '), string_split(lower(g), ' ')[-1]) AND (contains(lower(g), lower(concept_name)) OR contains(lower(concept_name), lower(g))) WHERE {_OK} AND g <> '') x) y WHERE k <= 5"""
_cdm("suggest_exact", lambda cdm: mapping.suggest_exact(cdm, _terms(cdm), "Drug"), _EXACT)
_cdm("suggest_maps_to", lambda cdm: mapping.suggest_relationship(cdm, _terms(cdm), "Drug"), _REL)
_cdm("suggest_ingredient", lambda cdm: mapping.suggest_ingredient(cdm, _terms(cdm), "Drug"), _ING)
_cdm("suggest_merged", lambda cdm: mapping.suggest_merged([mapping.suggest_exact(cdm, _terms(cdm), "Drug"), mapping.suggest_relationship(cdm, _terms(cdm), "Drug"), mapping.suggest_ingredient(cdm, _terms(cdm), "Drug")]), f"WITH e AS (SELECT *, 0 AS turn FROM ({_EXACT}) a UNION ALL SELECT *, 1 FROM ({_REL}) b UNION ALL SELECT *, 2 FROM ({_ING}) c), f AS (SELECT *, row_number() OVER (PARTITION BY source_value, concept_id ORDER BY turn, confidence DESC) AS k FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY confidence DESC, turn, concept_id) AS rank FROM f WHERE k = 1) SELECT source_value, concept_id, concept_name, strategy, confidence, CAST(rank AS INT) AS rank FROM g WHERE rank <= 5")
_dec = lambda cdm: cdm.table("decision")
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY created_on DESC, decision_id DESC) AS k FROM decision WHERE {_YES}) x WHERE k = 1)"
_cdm("mapping_consensus", lambda cdm: mapping.consensus(_dec(cdm), 2), f"SELECT source_value, target_concept_id, count(DISTINCT user_id) AS n_users, arg_max(decision_id, (created_on, decision_id)) AS decision_id FROM decision WHERE {_YES} GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2")
_cdm("mapping_pending", lambda cdm: mapping.pending(cdm, "Drug", _dec(cdm)), f"SELECT x.*, target_concept_id, decision_id FROM {_UN} x LEFT JOIN {_LAST} d ON d.source_value = x.source_value")
_cdm("mapping_warnings", lambda cdm: mapping.warnings(cdm, "Drug", _dec(cdm)), f"WITH t AS (SELECT source_value, count(DISTINCT target_concept_id) AS n FROM decision WHERE {_YES} GROUP BY 1), m AS (SELECT drug_source_value AS source_value, count(DISTINCT drug_concept_id) AS c FROM drug_exposure WHERE drug_concept_id > 0 GROUP BY 1) SELECT source_value, 'several targets' AS warning FROM t WHERE n >= 2 UNION ALL SELECT t.source_value, 'already mapped' FROM t JOIN m USING (source_value) UNION ALL SELECT t.source_value, 'several concepts' FROM t JOIN m USING (source_value) WHERE c >= 2")
_cdm("mapping_redundant", lambda cdm: mapping.redundant(cdm, "Drug", _dec(cdm)), f"WITH t AS (SELECT source_value, max(synced) AS s, min(target_concept_id) AS lo, max(target_concept_id) AS hi FROM decision WHERE {_YES} GROUP BY 1), m AS (SELECT drug_source_value AS source_value, min(drug_concept_id) AS a, max(drug_concept_id) AS b FROM drug_exposure WHERE drug_concept_id > 0 GROUP BY 1) SELECT t.source_value FROM t LEFT JOIN m USING (source_value) WHERE s = 1 OR (lo = hi AND a = b AND lo = a)")
_cdm("mapping_apply_overlay", lambda cdm: mapping.apply_mappings(cdm, "Drug", mapping.latest_decisions(_dec(cdm))).groupBy("drug_concept_id").agg(F.count("*").alias("n")), f"SELECT CASE WHEN drug_concept_id = 0 THEN coalesce(target_concept_id, drug_concept_id) ELSE drug_concept_id END AS drug_concept_id, count(*) AS n FROM drug_exposure LEFT JOIN {_LAST} d ON d.source_value = drug_source_value GROUP BY 1")
_cdm("bulk_decisions", lambda cdm: mapping.bulk_decisions(mapping.list_unmapped(cdm, "Drug"), _dec(cdm), 3).select("source_value"), f"SELECT source_value FROM {_UN} x WHERE source_value NOT IN (SELECT source_value FROM decision WHERE user_id = 3)")
_cdm("strategy_stats", lambda cdm: mapping.strategy_stats(_dec(cdm)), "SELECT suggestion_source, count(*) AS n, count(*) FILTER (action = 'approved') AS n_approved, count(*) FILTER (action = 'rejected') AS n_rejected, count(*) FILTER (action = 'modified') AS n_modified, round(avg(confidence), 4) AS mean_confidence, round(100.0 * count(*) FILTER (action = 'approved') / count(*), 2) AS pct_approved FROM decision GROUP BY 1")
_cdm("mapping_kpis", lambda cdm: mapping.pipeline_kpis(_dec(cdm)), f"SELECT count(*) FILTER ({_YES} AND synced = 1) AS validated, count(*) FILTER ({_YES} AND synced = 0) AS to_push, count(*) FILTER (action = 'rejected') AS rejected, count(*) AS n_terms FROM (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY created_on DESC, decision_id DESC) AS k FROM decision) x WHERE k = 1")

# ---------------------------------------------------------------------------------------------
# similarity, text and lineage

_vectors = lambda spark, d: _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
_COS = "SELECT q.vec_id AS query_id, t.vec_id AS target_id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 4) AS similarity FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id"
_raw("embedding_topk", lambda spark, d: similarity.cosine_topk(_vectors(spark, d).where("id % 50 = 0"), _vectors(spark, d), 5), f"SELECT query_id, target_id, similarity, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS k FROM ({_COS}) x) y WHERE k <= 5")
_raw("semantic_concept_set", lambda spark, d: similarity.semantic_concept_set(_vectors(spark, d).where("id % 50 = 0"), _vectors(spark, d), _read(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), F.col("label").alias("group_key")), 100, 0.05, 0.1), f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS k, max(similarity) OVER (PARTITION BY query_id) AS best FROM ({_COS}) x), n AS (SELECT DISTINCT query_id, label FROM r JOIN embeddings ON vec_id = target_id WHERE k <= 100 AND best >= 0.1 AND similarity >= greatest(best - 0.05, 0.1)) SELECT query_id, n.label AS group_key, vec_id AS target_id FROM n JOIN embeddings e ON e.label = n.label")
_raw("accent_search", lambda spark, d: _read(spark, d, "documents").where(scalars.folded(F.col("text")).contains("etion")).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'etion')")
_raw("csv_guard", lambda spark, d: _read(spark, d, "part").select("p_partkey", scalars.csv_guard(F.concat(F.element_at(F.array(*map(F.lit, "=+-@ax")), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")).alias("cell")), "SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN '''' ELSE '' END || substring('=+-@ax', CAST(p_partkey % 6 + 1 AS INT), 1) || p_name AS cell FROM part")
_raw("drug_label_clean", lambda spark, d: _read(spark, d, "part").select("p_partkey", scalars.clean_drug_label(F.concat(F.upper("p_name"), F.lit(" 500 MG CPR ("), "p_type", F.lit(")"))).alias("label")), "SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS label FROM part")
_raw("drug_name_parse", lambda spark, d: _read(spark, d, "part").select("p_partkey", mapping.parse_drug_name(F.concat("p_name", F.lit(" "), "p_size", F.lit(" MG TABLET ("), "p_brand", F.lit(")"))).alias("p")).select("p_partkey", "p.*"), "SELECT p_partkey, p_name AS ingredient, p_size || ' MG' AS dosage, p_brand AS brand FROM part")
_edges = lambda spark, d: _read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("n"), ((F.col("n_nationkey") * 7 + 3) % 25)).alias("target"))
_raw("lineage_chains", lambda spark, d: lineage.upstream(_edges(spark, d)).select("target", "source", "hops"), "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS s, 'n' || ((n_nationkey * 7 + 3) % 25) AS t FROM nation), u AS (SELECT t AS target, s AS source, 1 AS hops, [t, s] AS p FROM e WHERE s <> t UNION ALL SELECT u.target, e.s, hops + 1, list_append(p, e.s) FROM u JOIN e ON u.source = e.t WHERE NOT list_contains(p, e.s)) SELECT target, source, hops FROM u")
_raw("lineage_parse", lambda spark, d: lineage.table_rows(_read(spark, d, "region").select("r_regionkey", F.concat(F.lit("<h2>S&amp;"), "r_name", F.lit("</h2><table><tr><td>a</td><td> <b>"), "r_name", F.lit("</b></td></tr></table>")).alias("html")), "r_regionkey", "html").select("r_regionkey", "section", F.array_join("cells", "|").alias("cells")), "SELECT r_regionkey, 'S&' || r_name AS section, 'a|' || r_name AS cells FROM region")
_raw("audit_stats", lambda spark, d: _read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.max("ts").alias("last")), "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, max(ts) AS last FROM events GROUP BY 1")
_raw("sessions", lambda spark, d: sessions(_read(spark, d, "events"), "30 minutes"), "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import extended, services  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
