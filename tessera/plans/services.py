"""Registered queries of the services around the model: lineage, streams, progress, autocomplete, audit logs, files and schemas."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import autocomplete, characterize, lineage, mapping, mapping_batches, quality, schema_keys, similarity, vocabulary
from tessera.operators.cohort import build_cohort
from tessera.plans import extended  # noqa: F401  its queries are used below
from tessera.plans.catalog import _COS, _LAST, _MAKES, _QUERIES, _SQL, B1, B2, EVENTS_SQL, YEAR, _all, _cdm, _people, _raw, _read, _vectors, brand
from tessera.sources import audit, codebooks
from tessera.sources.cdm import TABLE_SQL, Cdm, star_cdm, with_tables
from tessera.sources.scratch import shared_folder, written
from tessera.streaming.cache import cached_lookups
from tessera.streaming.progress import Batch, report
from tessera.streaming.sessions import closed_sessions, event_stream

# ---------------------------------------------------------------------------------------------
# lineage: chains of 32 orders, every other one a cycle, and a customer before each


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    last = F.pmod(key, F.lit(32)) == 31
    chain = orders.where(~last | (F.floor(key / 32) % 2 == 0)).select(name("o", key).alias("source"), name("o", F.when(last, key - 31).otherwise(key + 1)).alias("target"))
    return chain.unionByName(orders.where(F.pmod(key, F.lit(32)) == 0).select(name("c", F.col("o_custkey")).alias("source"), name("o", key).alias("target")))


_raw("lineage_reach", lambda spark, d: lineage.reach_in_parts(_order_edges(spark, d)), """WITH RECURSIVE
 e AS (SELECT 'o' || o_orderkey AS s, 'o' || CASE WHEN o_orderkey % 32 = 31 THEN o_orderkey - 31 ELSE o_orderkey + 1 END AS t FROM orders WHERE o_orderkey % 32 <> 31 OR (o_orderkey // 32) % 2 = 0),
 f AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS t FROM orders WHERE o_orderkey % 32 = 0),
 r AS (SELECT t AS target, s AS source, 1 AS hops FROM e UNION ALL SELECT target, s, hops + 1 FROM r JOIN e ON e.t = r.source WHERE e.s <> target)
 SELECT target, source, CAST(min(hops) AS INT) AS hops FROM (SELECT * FROM r UNION ALL SELECT t, s, 1 FROM f UNION ALL SELECT target, s, hops + 1 FROM r JOIN f ON f.t = r.source) x GROUP BY 1, 2""")

# ---------------------------------------------------------------------------------------------
# streams and progress

_raw("sessions_stream", lambda spark, d: closed_sessions(spark, f"{d}/events.parquet", shared_folder(spark)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}), f"SELECT * FROM ({_SQL['sessions']}) x WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")

_TTL, _ENTRIES = 2 * 86_400, 3


def _lookups(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("owner"), F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"))


def _cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups of the event files, run as a stream that appends to a table."""
    folder = shared_folder(spark)
    found = cached_lookups(_lookups(event_stream(spark, f"{sf_dir}/events.parquet")), _TTL, _ENTRIES)
    found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/lookups").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/lookups")


_raw("cache_lookups", _cache_stream, f"""WITH RECURSIVE l AS (SELECT user_id, event_id, event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 st AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS hit, CAST(NULL AS VARCHAR) AS put_out, CAST([] AS STRUCT(key VARCHAR, us BIGINT)[]) AS e FROM l
  UNION ALL
  SELECT user_id, k, event_id, hit, CASE WHEN NOT hit AND len(rest) >= {_ENTRIES} THEN rest[1].key END, CASE WHEN hit THEN e ELSE list_append(CASE WHEN len(rest) >= {_ENTRIES} THEN rest[2:] ELSE rest END, struct_pack(key := key, us := us)) END
  FROM (SELECT l.user_id, l.k, l.event_id, l.key, l.us, st.e, len([x for x in st.e if x.key = l.key AND l.us - x.us < {_TTL * 1_000_000}]) > 0 AS hit, [x for x in st.e if x.key <> l.key] AS rest FROM st JOIN l ON l.user_id = st.user_id AND l.k = st.k + 1) n)
 SELECT user_id AS owner, event_id AS id, hit, put_out FROM st WHERE k > 0""")

#: The sections of a quality batch, in the order they run.
SECTIONS = ("dq_dashboard", "dq_person_gender", "obs_age_gender", "obs_length", "clin_global", "clin_monthly", "clin_mapping")


def _shared_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    """The model with what several sections join and group written once: periods, and the columns of drugs that they use."""
    cdm = star_cdm(spark, sf_dir)
    drugs = cdm.table("drug_exposure").select("person_id", "drug_concept_id", "drug_exposure_start_date", "drug_source_value")
    return Cdm({**cdm.tables, "drug_exposure": written(drugs), "observation_period": written(cdm.table("observation_period"))}, cdm.as_of)


def _quality_batch(spark: SparkSession, sf_dir: str) -> Batch:
    shared = functools.cache(lambda: _shared_cdm(spark, sf_dir))  # written by the first section that runs
    return Batch(spark, {name: lambda name=name: _MAKES[name](shared()) for name in SECTIONS})


_raw("quality_progress", lambda spark, d: report(_quality_batch(spark, d)).drop("error"), " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS seq, '{name}' AS section, 'success' AS status, CAST({k} AS INT) AS completed, CAST({len(SECTIONS)} AS INT) AS total, (SELECT count(*) FROM ({_SQL[name]}) x) AS n_rows" for k, name in enumerate(SECTIONS, 1)))

_cdm("conformity_score", lambda cdm: quality.conformity_score(quality.conformity(cdm)), f"SELECT CASE WHEN count(*) > 0 THEN round_even(100.0 * count(*) FILTER (status = 'pass') / count(*), 1) ELSE 0 END AS score, count(*) AS total_checks, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'fail') AS failures FROM ({_SQL['conformity']}) x")

# ---------------------------------------------------------------------------------------------
# autocomplete

_CACHE = _SQL["source_value_cache"]


def _begins(text: str, more: str = "") -> str:
    return f"SELECT *, count(*) OVER () AS total FROM ({_CACHE}) x WHERE (starts_with(lower(source_value), '{text}') OR starts_with(lower(source_name), '{text}') OR (domain = 'Drug' AND starts_with(lower(source_atc), '{text}'))){more}"


_ORDER = "ORDER BY n_records DESC, domain, source_value, source_name NULLS FIRST, source_atc NULLS FIRST, concept_id NULLS FIRST"
_index = autocomplete.completion_index
_cdm("autocomplete_values", lambda cdm: autocomplete.complete(_index(cdm), "RED w", limit=60), f"{_begins('red w')} {_ORDER} LIMIT 60")
_cdm("autocomplete_names", lambda cdm: autocomplete.complete(_index(cdm), "large r", "Drug", 40, 2), f"{_begins('large r')} {_ORDER} LIMIT 40 OFFSET 2")
_cdm("autocomplete_codes", lambda cdm: autocomplete.complete_fast(_index(cdm), "brand#2", limit=100), f"SELECT DISTINCT domain, source_value, source_name, source_atc FROM ({_begins('brand#2')}) y ORDER BY ALL NULLS FIRST LIMIT 100")


def _pending(cdm: Cdm) -> DataFrame:
    found = autocomplete.complete(_index(cdm), "hot", "Drug", 100)
    return autocomplete.with_pending(found, cdm, mapping.latest_decisions(autocomplete.of_found(cdm.table("decision"), found)))


_cdm("autocomplete_pending", _pending,
     f"""SELECT y.domain, y.source_value, source_name, source_atc, n_records, n_persons, total, coalesce(y.concept_id, 0) = 0 AND c.concept_id IS NOT NULL AS pending,
 CASE WHEN coalesce(y.concept_id, 0) = 0 AND c.concept_id IS NOT NULL THEN c.concept_id ELSE y.concept_id END AS concept_id, CASE WHEN coalesce(y.concept_id, 0) = 0 AND c.concept_id IS NOT NULL THEN c.concept_name ELSE y.concept_name END AS concept_name,
 CASE WHEN coalesce(y.concept_id, 0) = 0 AND c.concept_id IS NOT NULL THEN c.vocabulary_id ELSE y.vocabulary_id END AS vocabulary_id, CASE WHEN coalesce(y.concept_id, 0) = 0 AND c.concept_id IS NOT NULL THEN c.standard_concept ELSE y.standard_concept END AS standard_concept
 FROM ({_begins('hot', " AND domain = 'Drug'")} {_ORDER} LIMIT 100) y LEFT JOIN {_LAST} d ON d.source_value = y.source_value LEFT JOIN concept c ON c.concept_id = d.target_concept_id""")  # fmt: skip

_kinds = lambda cdm: {"mapping": cdm.table("decision").select(F.col("decision_id").alias("key"), F.col("source_value").alias("label")), "set": cdm.table("concept").where("vocabulary_id = 'Type'").select(F.col("concept_code").alias("key"), F.lower("concept_name").alias("label"))}
_cdm("global_search_kinds", lambda cdm: vocabulary.global_search(cdm, "LAR", 8, _kinds(cdm)), f"""SELECT * FROM (SELECT 'concept' AS kind, CAST(concept_id AS VARCHAR) AS key, concept_name AS label FROM concept WHERE (lower(concept_name) LIKE '%lar%' OR lower(concept_code) LIKE '%lar%') AND invalid_reason IS NULL ORDER BY CASE WHEN standard_concept = 'S' THEN 0 ELSE 1 END, length(concept_name), concept_name, concept_id LIMIT 8) a
 UNION ALL SELECT 'source value', source_value, domain FROM (SELECT domain, source_value, count(*) AS n FROM ({EVENTS_SQL}) x WHERE lower(source_value) LIKE '%lar%' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8) b
 UNION ALL SELECT * FROM (SELECT 'mapping', CAST(decision_id AS VARCHAR) AS key, source_value FROM decision WHERE lower(source_value) LIKE '%lar%' ORDER BY source_value, key LIMIT 8) c
 UNION ALL SELECT * FROM (SELECT DISTINCT 'set', concept_code AS key, lower(concept_name) AS label FROM concept WHERE vocabulary_id = 'Type' AND lower(concept_name) LIKE '%lar%' ORDER BY label, key LIMIT 8) d""")

_cdm("concept_search_codes", lambda cdm: vocabulary.concept_search(cdm, "12", limit=30, codes=True).select("concept_id", "concept_name", "concept_code"), "SELECT concept_id, concept_name, concept_code FROM concept WHERE (concept_id = 12 OR contains(concept_code, '12')) AND invalid_reason IS NULL ORDER BY CASE WHEN standard_concept = 'S' THEN 0 ELSE 1 END, length(concept_name), concept_name, concept_id LIMIT 30")

# ---------------------------------------------------------------------------------------------
# audit logs: a line for each event, one in a hundred cut short


def _audit(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.concat(F.lit("user"), text("user_id")).alias("user"), F.array(F.lit("reader")).alias("roles"), F.col("event_type").alias("action"), F.lit("GET").alias("method"), F.concat(F.lit("/e/"), text("event_id")).alias("path"), F.lit(200).alias("status"), F.col("value").alias("duration_ms")))
    entries = _read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.when(F.col("event_id") % 100 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"))
    path = shared_folder(spark)
    audit.write_audit(entries.repartition("day"), path)
    return audit.read_days(spark, path, first, last)


_ENTRIES_SQL = "(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, 'user' || user_id AS \"user\", event_type AS action, '/e/' || event_id AS path, event_id % 100 = 0 AS bad, CAST(ts AS DATE) AS day FROM events)"
_raw("audit_page", lambda spark, d: audit.audit_page(_audit(spark, d, "2024-01-10", "2024-01-20"), 2, 20, action="er").select("ts", "user", "action", "path", "total"), f"SELECT ts, \"user\", action, path, count(*) OVER () AS total FROM {_ENTRIES_SQL} x WHERE NOT bad AND starts_with(action, 'er') AND day BETWEEN '2024-01-10' AND '2024-01-20' ORDER BY ts DESC, \"user\", action, path LIMIT 20 OFFSET 20")
_raw("audit_log_stats", lambda spark, d: audit.audit_stats(_audit(spark, d)), f"""WITH a AS (SELECT * FROM {_ENTRIES_SQL} x) SELECT 'events' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM a WHERE NOT bad UNION ALL SELECT 'malformed', NULL, count(*) FROM a WHERE bad
 UNION ALL SELECT * FROM (SELECT 'user', "user", count(*) FROM a WHERE NOT bad GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50) u UNION ALL SELECT * FROM (SELECT 'action', action, count(*) FROM a WHERE NOT bad GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50) v""")

# ---------------------------------------------------------------------------------------------
# files: parts as codebooks and mappings of two forms each


def _csv_files(rows: DataFrame, second: DataFrame) -> str:
    path = shared_folder(rows.sparkSession)
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/one")
    second.write.option("header", True).csv(f"{path}/two")
    return f"{path}/*/*.csv"


def _codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, even = _read(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 0
    label = F.concat(F.col("p_name"), F.lit(", été"))
    one = part.where(even).select(F.col("p_size").alias("taille"), F.col("p_partkey").alias("code"), label.alias("Libellé"))
    return codebooks.read_codebooks(spark, _csv_files(one, part.where(~even).select("p_partkey", label.alias("text"))), "parts")


_raw("codebook_files", _codebooks, "SELECT 'parts' AS name, CAST(p_partkey AS VARCHAR) AS code, p_name || ', été' AS description FROM part")


def _mappings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    rows = part.select(F.col("p_name").alias("source_code"), F.col("p_brand").alias("source_name"), F.when(key % 7 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("rank"), F.when(key % 11 != 0, key.cast("string")).alias("target_concept_id"), F.when(key % 13 == 0, "n/a").otherwise(F.format_string("0.%02d", (key % 100).cast("int"))).alias("similarity"))
    return codebooks.read_mappings(spark, _csv_files(rows.where(key % 2 == 0), rows.where(key % 2 == 1).drop("rank")), "Drug")


_MAP = "(SELECT *, p_partkey % 2 = 0 AND p_partkey % 7 = 0 AS bad_rank, p_partkey % 11 = 0 AS none, p_partkey % 13 = 0 AS bad_similarity FROM part)"
_raw("embedding_mappings", lambda spark, d: _mappings(spark, d)[0].select("domain", "source_code", "source_name", "rank", "target_concept_id", "similarity"), f"SELECT 'Drug' AS domain, p_name AS source_code, p_brand AS source_name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END AS INT) AS rank, CAST(p_partkey AS INT) AS target_concept_id, CAST((p_partkey % 100) / 100 AS DOUBLE) AS similarity FROM {_MAP} x WHERE NOT (bad_rank OR none OR bad_similarity)")
_raw("embedding_mapping_rejects", lambda spark, d: _mappings(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n")), f"SELECT CASE WHEN none THEN 'no code or target' ELSE 'no number: ' || concat_ws(', ', CASE WHEN bad_rank THEN 'rank' END, CASE WHEN bad_similarity THEN 'similarity' END) END AS reason, count(*) AS n FROM {_MAP} x WHERE bad_rank OR none OR bad_similarity GROUP BY 1")

# ---------------------------------------------------------------------------------------------
# schemas

_COLUMNS = {
    "region": ("r_regionkey", "r_name$"), "nation": ("n_nationkey", "n_name$", "n_regionkey"), "customer": ("c_custkey", "c_name$", "c_nationkey", "c_mktsegment$"),
    "supplier": ("s_suppkey", "s_name$", "s_nationkey"), "part": ("p_partkey", "p_name$", "p_brand$", "p_type$", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus$", "o_orderpriority$"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag$", "l_linestatus$"), "events": ("event_id", "user_id", "event_type$", "props$"),
}
_EACH = [(t, c.rstrip("$"), c.endswith("$")) for t, cs in _COLUMNS.items() for c in cs]
_tables = lambda spark, d: {t: _read(spark, d, t) for t in _COLUMNS}
_raw("schema_columns", lambda spark, d: schema_keys.schema_keys(_tables(spark, d))[0], " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AS is_key FROM {t}" for t, c, _ in _EACH))
_raw("schema_relations", lambda spark, d: schema_keys.schema_keys(_tables(spark, d))[1], " UNION ALL ".join(f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{u}' AS to_table, '{k}' AS to_column, (SELECT count(DISTINCT {c}) FROM {t}) AS n_values WHERE (SELECT count(*) = count(DISTINCT {k}) FROM {u}) AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {u}))" for (t, c, x), (u, k, y) in itertools.permutations(_EACH, 2) if t != u and x == y))

# ---------------------------------------------------------------------------------------------
# cohorts described and compared


def _described(cdm: Cdm) -> DataFrame:
    return characterize.characterize(cdm, characterize.members({n: build_cohort(cdm, {"inclusion": _all(brand(k))}) for k, n in ((1, "a"), (2, "b"))}))


_BRACKETS = " ".join(f"WHEN age BETWEEN {lo} AND {hi} THEN '{label}'" for lo, hi, label in quality.AGE_GROUPS)
_MARGINS = " UNION ALL ".join(f"SELECT cohort, '{f}' AS section, coalesce(CAST({f}_concept_id AS VARCHAR), 'Unknown') AS variable, count(*) AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS sd FROM pe GROUP BY 1, 3" for f in characterize.FIELDS)
_DESCRIBED = with_tables(f"""WITH who AS (SELECT DISTINCT 'a' AS cohort, person_id FROM ({_people(B1)}) x UNION ALL SELECT DISTINCT 'b', person_id FROM ({_people(B2)}) y),
 sz AS (SELECT cohort, count(*) AS size FROM who GROUP BY 1), pe AS (SELECT cohort, {YEAR} - year_of_birth AS age, person.* FROM person JOIN who USING (person_id)),
 ev AS (SELECT cohort, e.* FROM ({EVENTS_SQL}) e JOIN who USING (person_id)),
 al AS ({_MARGINS} UNION ALL SELECT cohort, 'age_group', CASE {_BRACKETS} ELSE 'Other' END, count(*), NULL, NULL FROM pe GROUP BY 1, 3
  UNION ALL SELECT cohort, 'size', '', count(*), NULL, NULL FROM pe GROUP BY 1 UNION ALL SELECT cohort, 'age', '', count(age), avg(age), stddev_samp(age) FROM pe GROUP BY 1
  UNION ALL SELECT cohort, 'prevalence_' || domain, CAST(concept_id AS VARCHAR), count(DISTINCT person_id), NULL, NULL FROM ev WHERE concept_id > 0 GROUP BY 1, 2, 3
  UNION ALL SELECT cohort, 'measurement', CAST(measurement_concept_id AS VARCHAR), count(value_as_number), avg(value_as_number), stddev_samp(value_as_number) FROM measurement JOIN who USING (person_id) GROUP BY 1, 3
  UNION ALL SELECT cohort, 'visit_type', CAST(visit_concept_id AS VARCHAR), count(*), NULL, NULL FROM visit_occurrence JOIN who USING (person_id) GROUP BY 1, 3
  UNION ALL SELECT cohort, 'observation', '', count(*), avg(observation_period_end_date - observation_period_start_date), stddev_samp(observation_period_end_date - observation_period_start_date) FROM observation_period JOIN who USING (person_id) GROUP BY 1),
 de AS (SELECT cohort, section, variable, n, CASE WHEN section IN ('age_group', 'gender', 'race', 'ethnicity') OR starts_with(section, 'prevalence_') THEN round(100.0 * n / size, 4) END AS pct, round(mean, 4) AS mean, round(sd, 4) AS sd FROM al JOIN sz USING (cohort))
 SELECT * FROM de""")
_COMPARED = _DESCRIBED.removesuffix("SELECT * FROM de") + """SELECT section, variable, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, CASE WHEN s THEN pa * 100 END AS pct_a, CASE WHEN s THEN pb * 100 END AS pct_b, x.mean AS mean_a, y.mean AS mean_b,
 round(CASE WHEN s THEN CASE WHEN pa * (1 - pa) + pb * (1 - pb) > 0 THEN (pa - pb) / sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2) WHEN pa = pb THEN 0 END
  WHEN x.mean IS NOT NULL AND y.mean IS NOT NULL THEN CASE WHEN x.sd * x.sd + y.sd * y.sd > 0 THEN (x.mean - y.mean) / sqrt((x.sd * x.sd + y.sd * y.sd) / 2) WHEN x.mean = y.mean THEN 0 END END, 4) + 0 AS smd
 FROM (SELECT * FROM de WHERE cohort = 'a') x FULL JOIN (SELECT * FROM de WHERE cohort = 'b') y USING (section, variable), LATERAL (SELECT coalesce(x.pct, 0) / 100 AS pa, coalesce(y.pct, 0) / 100 AS pb, x.pct IS NOT NULL OR y.pct IS NOT NULL AS s) z"""
_cdm("characterize", _described)
_cdm("compare_cohorts", lambda cdm: characterize.compare(_described(cdm), "a", "b"))
_SQL |= {"characterize": _DESCRIBED, "compare_cohorts": _COMPARED}

# ---------------------------------------------------------------------------------------------
# mapping batches: terms are parts, one each, so that some have no mapped row

_CODE = "p_name || ' ' || CAST(p_partkey AS VARCHAR(20))"
_BATCH_SQL = {"drug_exposure": TABLE_SQL["drug_exposure"].replace("p_name AS drug_source_value", f"{_CODE} AS drug_source_value"), "decision": TABLE_SQL["decision"].replace("p_name AS source_value", f"{_CODE} AS source_value")}


def _parts_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    cdm = star_cdm(spark, sf_dir)
    return Cdm({**cdm.tables, **{name: spark.sql(sql.replace("VARCHAR(20)", "STRING")) for name, sql in _BATCH_SQL.items()}}, cdm.as_of)


_BATCH_HEAD = "WITH " + ",\n ".join(f"{name} AS ({sql.replace('VARCHAR(20)', 'VARCHAR')})" for name, sql in _BATCH_SQL.items()) + """,
 mapped AS (SELECT drug_source_value AS source_value, min(drug_concept_id) AS lo, max(drug_concept_id) AS hi, count(DISTINCT drug_concept_id) AS n FROM drug_exposure WHERE drug_concept_id > 0 GROUP BY 1),
 yes AS (SELECT * FROM decision WHERE action IN ('approved', 'modified')),
 agreed AS (SELECT * FROM yes WHERE decision_id IN (SELECT arg_max(decision_id, (created_on, decision_id)) FROM yes GROUP BY source_value, target_concept_id HAVING count(DISTINCT user_id) >= 3))"""


def _pushable(decided: str, name: str) -> str:
    """Tables name_x (redundant terms), name_e (effective decisions), name_w (their terms with flags) and name_p (pushed terms)."""
    return f""",
 {name}_x AS (SELECT d.source_value FROM (SELECT source_value, max(synced) AS s, min(target_concept_id) AS lo, max(target_concept_id) AS hi FROM {decided} GROUP BY 1) d LEFT JOIN mapped m USING (source_value) WHERE s = 1 OR (d.lo = d.hi AND m.lo = m.hi AND d.lo = m.lo)),
 {name}_e AS (SELECT * FROM {decided} WHERE source_value NOT IN (SELECT source_value FROM {name}_x)),
 {name}_w AS (SELECT source_value, count(DISTINCT target_concept_id) >= 2 AS several, count(m.n) > 0 AS mapped, max(coalesce(m.n, 0)) >= 2 AS concepts, max(target_concept_id) AS target FROM {name}_e LEFT JOIN mapped m USING (source_value) GROUP BY 1),
 {name}_p AS (SELECT source_value, target FROM {name}_w WHERE NOT (several OR mapped OR concepts))"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, of agreed and of latest decisions, of which the first is taken back; rows of each concept then."""
    cdm = _parts_cdm(spark, sf_dir)
    ledger, decisions = mapping_batches.Ledger(spark, shared_folder(spark)).start(), cdm.table("decision")
    ledger.apply(cdm, "Drug", mapping_batches.agreed(decisions, 3), "agreed")
    ledger.apply(cdm, "Drug", mapping.latest_decisions(decisions), "latest")
    ledger.roll_back("agreed")
    return ledger.current(cdm, "Drug").table("drug_exposure").groupBy("drug_concept_id").agg(F.count("*").alias("n"))


_raw("mapping_preview", lambda spark, d: mapping_batches.preview((cdm := _parts_cdm(spark, d)), "Drug", mapping_batches.agreed(cdm.table("decision"), 3)), f"""{_BATCH_HEAD}{_pushable('agreed', 'a')}
 SELECT (SELECT count(*) FROM a_e) AS total_decisions, count(*) AS n_codes, (SELECT count(DISTINCT source_value) FROM a_x) AS n_redundant, (SELECT count(*) FROM drug_exposure WHERE drug_source_value IN (SELECT source_value FROM a_w)) AS impacted_rows,
 (SELECT count(DISTINCT person_id) FROM drug_exposure WHERE drug_source_value IN (SELECT source_value FROM a_w)) AS impacted_persons, count(*) FILTER (several) AS n_several_targets, count(*) FILTER (mapped) AS n_already_mapped, count(*) FILTER (concepts) AS n_several_concepts,
 count(*) FILTER (several OR mapped OR concepts) AS n_flagged, count(*) FILTER (NOT (several OR mapped OR concepts)) AS n_pushable_codes FROM a_w""")
_raw("mapping_batches", _applied, f"""{_BATCH_HEAD}{_pushable('agreed', 'a')},
 last AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_value ORDER BY created_on DESC, decision_id DESC) AS k FROM yes) x WHERE k = 1 AND source_value NOT IN (SELECT source_value FROM a_p)){_pushable('last', 'b')}
 SELECT CASE WHEN drug_concept_id = 0 THEN coalesce(target, drug_concept_id) ELSE drug_concept_id END AS drug_concept_id, count(*) AS n FROM drug_exposure LEFT JOIN b_p ON source_value = drug_source_value GROUP BY 1""")

# ---------------------------------------------------------------------------------------------
# suggestions from embeddings, and queries of two forms each

_raw("embedding_suggestions", lambda spark, d: similarity.embedding_suggestions(_vectors(spark, d).where("id % 50 = 0"), _vectors(spark, d), 10, 0.2), f"SELECT query_id, target_id, similarity, 'sapbert' AS strategy, CAST(floor(round(similarity * 100, 6)) AS INT) AS confidence, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS k FROM ({_COS}) x) y WHERE k <= 10 AND similarity >= 0.2")
_forms = lambda spark, d: _vectors(spark, d).where("id % 50 = 0").withColumn("query_id", F.floor(F.col("id") / 100))
_raw("semantic_forms", lambda spark, d: similarity.semantic_concept_set(_forms(spark, d), _vectors(spark, d), _read(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), F.when(F.col("label") > 4, F.col("label")).alias("group_key")), 50, None, 0.35), f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS k FROM ({_COS}) x),
 b AS (SELECT query_id // 100 AS query_id, target_id, max(similarity) AS similarity FROM f WHERE k <= 50 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS k FROM b),
 n AS (SELECT query_id, target_id, CASE WHEN label > 4 THEN label END AS label FROM r JOIN embeddings ON vec_id = target_id WHERE k <= 50 AND similarity >= 0.35)
 SELECT DISTINCT query_id, e.label AS group_key, vec_id AS target_id FROM n JOIN embeddings e ON e.label = n.label UNION ALL SELECT query_id, NULL, target_id FROM n WHERE label IS NULL""")

# ---------------------------------------------------------------------------------------------
# domains of the mapping pipeline, names by codebook, summaries

_DOMAIN = "CASE suggestion_source WHEN 'exact' THEN 'Drug' WHEN 'ingredient' THEN 'Condition' ELSE 'Measurement' END"
_SNAPSHOTS = (("Drug", 1, "2024-01-01"), ("Drug", 2, "2030-01-01"), ("Condition", 1, "1990-01-01"))


def _domain_kpis(cdm: Cdm) -> DataFrame:
    """Two snapshots of drugs, an old one of conditions, and none of measurements and visits."""
    decisions = cdm.table("decision").withColumn("domain", F.expr(_DOMAIN))
    rates = [quality.mapping_rates(cdm, d).select(F.lit(d).alias("domain"), F.lit(v).alias("version"), F.to_date(F.lit(day)).alias("created_on"), "n_terms", "n_mapped_terms", "n_rows", "n_mapped_rows") for d, v, day in _SNAPSHOTS]
    pushes = decisions.where("synced = 1").select("domain", F.col("created_on").alias("applied_on"))
    return mapping.domain_kpis(decisions, rates[0].unionByName(rates[1]).unionByName(rates[2]), pushes, ["Condition", "Drug", "Measurement", "Visit"])


def _rates(domain: str, table: str, concept: str, value: str, version: int, day: str) -> str:
    return f"SELECT '{domain}' AS domain, {version} AS version, DATE '{day}' AS created_on, count(DISTINCT {value}) AS n_terms, count(DISTINCT CASE WHEN {concept} > 0 THEN {value} END) AS n_mapped_terms, count(*) AS n_rows, count(*) FILTER ({concept} > 0) AS n_mapped_rows FROM {table}"


_cdm("mapping_domain_kpis", _domain_kpis, f"""WITH de AS (SELECT *, {_DOMAIN} AS domain FROM decision),
 sn AS ({_rates('Drug', 'drug_exposure', 'drug_concept_id', 'drug_source_value', 2, '2030-01-01')} UNION ALL {_rates('Condition', 'condition_occurrence', 'condition_concept_id', 'condition_source_value', 1, '1990-01-01')}),
 pa AS (SELECT domain, count(DISTINCT user_id) AS n, max(synced) AS s FROM de WHERE action IN ('approved', 'modified') GROUP BY domain, source_value, target_concept_id),
 st AS (SELECT domain, count(*) FILTER (n >= 2) AS validated, count(*) FILTER (n < 2) AS pending, count(*) FILTER (n >= 2 AND s = 0) AS to_push FROM pa GROUP BY 1),
 re AS (SELECT domain, count(DISTINCT source_value) AS rejected FROM de WHERE action = 'rejected' GROUP BY 1), pu AS (SELECT domain, max(created_on) AS last_push FROM de WHERE synced = 1 GROUP BY 1)
 SELECT d.domain, CAST(version AS INT) AS version, created_on AS snapshot_date, n_terms, n_mapped_terms, round(100.0 * n_mapped_terms / n_terms, 2) AS pct_terms, n_rows, n_mapped_rows, round(100.0 * n_mapped_rows / n_rows, 2) AS pct_rows,
  coalesce(validated, 0) AS validated, coalesce(pending, 0) AS pending, coalesce(rejected, 0) AS rejected, coalesce(to_push, 0) AS to_push, coalesce(last_push > created_on, false) AS stale, version IS NULL AS never_analyzed
 FROM (VALUES ('Condition'), ('Drug'), ('Measurement'), ('Visit')) d(domain) LEFT JOIN sn USING (domain) LEFT JOIN st USING (domain) LEFT JOIN re USING (domain) LEFT JOIN pu USING (domain)""")

_BOOK = "SELECT p_type AS name, 'Drug' AS domain, p_name AS code, CASE WHEN p_size > 25 THEN p_brand || ' label' ELSE '' END AS description FROM part"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdm = star_cdm(spark, sf_dir)
    return vocabulary.labelled_source_values(cdm, spark.sql(_BOOK)).groupBy("domain", "source_value", "source_name").agg(F.sum("n_records").alias("n_records"))


_raw("source_values_labelled", _labelled, f"""WITH b AS ({_BOOK}), z AS (SELECT name, count(*) AS n FROM b GROUP BY 1), l AS (SELECT code, description FROM (SELECT b.*, row_number() OVER (PARTITION BY code ORDER BY n DESC, b.name, description) AS k FROM b JOIN z ON z.name = b.name WHERE trim(description) <> '') x WHERE k = 1)
 SELECT domain, source_value, CASE WHEN domain = 'Drug' AND description IS NOT NULL THEN description ELSE source_name END AS source_name, CAST(sum(n_records) AS BIGINT) AS n_records FROM ({_CACHE}) c LEFT JOIN l ON domain = 'Drug' AND code = source_value GROUP BY 1, 2, 3""")
_raw("lineage_summary", lambda spark, d: lineage.layer_counts(_QUERIES["lineage_nodes"](spark, d)), f"SELECT layer, count(*) AS n_tables FROM ({_SQL['lineage_nodes']}) x GROUP BY 1")
_raw("bulk_rejections", lambda spark, d: mapping.bulk_decisions(mapping.list_unmapped((cdm := _parts_cdm(spark, d)), "Drug"), cdm.table("decision").where("action = 'rejected'"), 3).select("source_value", "n_records"), f"{_BATCH_HEAD} SELECT drug_source_value AS source_value, count(*) AS n_records FROM drug_exposure WHERE drug_concept_id = 0 AND drug_source_value NOT IN (SELECT source_value FROM decision WHERE user_id = 3 AND action = 'rejected') GROUP BY 1")
