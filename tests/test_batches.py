"""Batches of mappings: preview, apply, take back in any order; cohorts described from one scan a table."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import characterize, mapping_batches
from tessera.plans.services import _described
from tessera.sources.cdm import Cdm, star_cdm
from tests.oracle import SMALL

DRUG = "drug_exposure_id long, person_id long, drug_concept_id int, drug_exposure_start_date date, drug_source_value string"
DECISION = "decision_id long, source_value string, action string, target_concept_id int, user_id int, created_on date, synced int"


def model(spark):
    rows = [(1, 1, 0, "a"), (2, 2, None, "a"), (3, 1, 0, "b"), (4, 1, 7, "c"), (5, 3, 0, "c"), (6, 3, 0, "d"), (7, 4, 9, "e")]
    drugs = spark.createDataFrame([(i, p, c, None, v) for i, p, c, v in rows], DRUG)
    decided = [("a", 50, 1), ("a", 50, 2), ("b", 60, 1), ("b", 60, 2), ("c", 70, 1), ("c", 70, 2), ("d", 80, 1), ("d", 80, 2), ("d", 81, 1), ("d", 81, 2), ("e", 9, 1), ("e", 9, 2), ("x", 1, 1)]
    decisions = spark.createDataFrame([(k, v, "approved", t, u, None, 0) for k, (v, t, u) in enumerate(decided)], DECISION)
    return Cdm({"drug_exposure": drugs}), decisions


def concepts(cdm):
    return {r.drug_exposure_id: r.drug_concept_id for r in cdm.table("drug_exposure").collect()}


def test_preview(spark):
    cdm, decisions = model(spark)
    got = mapping_batches.preview(cdm, "Drug", mapping_batches.agreed(decisions)).first().asDict()
    # e is in the data as decided; c is mapped; d has two targets
    assert got == {"total_decisions": 5, "n_codes": 4, "n_redundant": 1, "impacted_rows": 6, "impacted_persons": 3, "n_several_targets": 1, "n_already_mapped": 1, "n_several_concepts": 0, "n_flagged": 2, "n_pushable_codes": 2}


def test_batches_are_taken_back_one_by_one(spark, tmp_path):
    cdm, decisions = model(spark)
    ledger = mapping_batches.Ledger(spark, str(tmp_path / "ledger")).start()
    before = concepts(cdm)
    a = decisions.where("source_value = 'a'")
    assert {(r.source_value, r.new_concept_id, r.n_rows) for r in ledger.apply(cdm, "Drug", a, "one").collect()} == {("a", 50, 2)}
    # a is mapped now, to another target than asked for, so that the second batch leaves it alone
    other = decisions.where("source_value in ('a', 'b')").withColumn("target_concept_id", F.col("target_concept_id") + 1)
    assert {(r.source_value, r.new_concept_id) for r in ledger.apply(cdm, "Drug", other, "two").collect()} == {("b", 61)}
    assert concepts(ledger.current(cdm, "Drug")) == {**before, 1: 50, 2: 50, 3: 61}
    ledger.roll_back("one")
    assert concepts(ledger.current(cdm, "Drug")) == {**before, 3: 61}
    with pytest.raises(ValueError):
        ledger.roll_back("one")
    with pytest.raises(ValueError):
        ledger.roll_back("three")
    with pytest.raises(ValueError):
        ledger.apply(cdm, "Drug", a, "two")
    ledger.apply(cdm, "Drug", a, "four")
    ledger.roll_back("two")
    assert concepts(ledger.current(cdm, "Drug")) == {**before, 1: 50, 2: 50}
    ledger.apply(cdm, "Drug", decisions.where("source_value = 'none'"), "empty")
    assert ledger.roll_back("empty").count() == 0


def test_each_table_is_scanned_once_for_all_cohorts(spark):
    cdm = star_cdm(spark, SMALL)
    text = _described(cdm)._jdf.queryExecution().executedPlan().toString()
    # drugs, visits and periods read orders, conditions, measurements and periods read events: none of them again for a cohort
    assert text.count("events.parquet") == 3 and text.count("customer.parquet") == 1


def test_comparison_of_odd_cohorts(spark):
    cdm = star_cdm(spark, SMALL)
    people = cdm.table("person").select("person_id")
    rows = characterize.characterize(cdm, characterize.members({"all": people, "none": people.where("false"), "same": people}))
    got = characterize.compare(rows, "all", "same").collect()
    assert got and all(r.n_a == r.n_b and r.smd in (0.0, None) for r in got)
    assert all(r.n_b == 0 for r in characterize.compare(rows, "all", "none").collect())
