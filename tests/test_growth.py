"""What a task holds and what is shuffled don't grow with more than the input."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import autocomplete, cohort, details, mapping_batches, quality, stats, vocabulary
from tessera.plans import services
from tessera.sources.cdm import Cdm, star_cdm
from tests.oracle import SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_persons_of_a_domain_meet_the_cohort_once(spark):
    """Of a person's events in a domain one row is joined, not each."""
    visits = spark.range(0, 1000, 1, 1).select((F.col("id") % 10).alias("person_id"), F.lit(None).cast("long").alias("visit_concept_id"), F.lit(None).cast("date").alias("visit_start_date"), F.lit(None).cast("date").alias("visit_end_date"), F.lit("").alias("visit_source_value"))
    cdm = Cdm({"visit_occurrence": visits})
    out = details.domain_coverage(cdm, spark.range(5).withColumnRenamed("id", "person_id"))
    assert [tuple(r) for r in out.collect()] == [("Visit", 5, 100.0)]
    text = plan(out)
    assert "LeftSemi" not in text and "Aggregate" in text[text.index("Join Inner") : text.index("visit") if "visit" in text else None]


def test_long_concept_sets_keep_their_own_concepts(spark, monkeypatch):
    """A set that is no literal list has its concepts and their descendants, and is met by one semi join."""
    monkeypatch.setattr(cohort, "LITERALS", 3)
    cdm, want = star_cdm(spark, SMALL), {"domain": "Drug", "concepts": [500001, 1000003]}
    found = cohort.concept_events(cdm, want)
    assert "LeftSemi" in plan(found) and "LeftOuter" not in plan(found)
    monkeypatch.undo()
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(found) == rows(cohort.concept_events(cdm, want)) != []


@pytest.mark.parametrize("more", [{}, {"demographics": {"gender": [8507]}}])
def test_members_of_a_plain_criterion_are_not_looked_up(spark, more):
    """Its events say who they are; with anything else in the document the members are built."""
    criteria = {"inclusion": {"criteria": [{"domain": "Drug", "concepts": [500001]}]}} | more
    cdm = star_cdm(spark, SMALL)
    found = cohort.dated_cohort(cdm, criteria, "Drug", "matching")
    assert ("LeftSemi" in plan(found)) == bool(more)
    assert found.select("person_id").distinct().count() == cohort.build_cohort(cdm, criteria).distinct().count()


def _people(spark, outcomes, entries=((1, 100), (2, 100), (3, 100), (4, 100))):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    dated = lambda rows: spark.createDataFrame([(p, day(n)) for p, n in rows], "person_id long, cohort_start_date date")
    cdm = Cdm({
        "observation_period": spark.createDataFrame([(p, day(0), day(400)) for p in range(1, 6)], "person_id long, observation_period_start_date date, observation_period_end_date date"),
        "person": spark.createDataFrame([(p, 1980, 8507) for p in range(1, 6)], "person_id long, year_of_birth int, gender_concept_id int"),
        "concept": spark.createDataFrame([(8507, "MALE")], "concept_id int, concept_name string"),
    })
    return cdm, dated(entries), dated(outcomes)


def test_first_dates_take_both_cohorts_in_one_grouping(spark):
    """Repeated entries and outcomes, people without outcome and outcomes without entry; cohorts are read once each."""
    cdm, target, outcome = _people(spark, [(1, 90), (1, 150), (2, 150), (2, 160), (3, 50), (5, 120)], [(1, 100), (1, 120), (2, 100), (3, 100), (4, 100)])
    got = lambda clean: {r.person_id: (r.had_outcome, r.time_days) for r in stats.risk_rows(cdm, target, outcome, 0, 200, clean).collect()}
    assert got(0) == {1: (0, 200.0), 2: (1, 50.0), 3: (0, 200.0), 4: (0, 200.0)}
    assert got(10) == {2: (1, 50.0), 3: (0, 200.0), 4: (0, 200.0)}
    assert got(50) == {2: (1, 50.0), 4: (0, 200.0)}
    for clean in (0, 10):
        text = plan(stats.risk_rows(cdm, target, outcome, 0, 200, clean))
        assert "LeftAnti" not in text and text.count("Join") == 3
    assert plan(stats.survival_rows(cdm, target, outcome)).count("Join") == 3


def test_preview_joins_the_data_once(spark):
    """Decisions and the terms that they decide are worked out before; only impacted rows are counted over the data."""
    cdm = services._parts_cdm(spark, SMALL)
    text = plan(mapping_batches.preview(cdm, "Drug", mapping_batches.agreed(cdm.table("decision"), 3)))
    assert text.count("Relation [l_orderkey") == 1


def test_agreed_decisions_of_shared_ids(spark):
    """Every decision with the id of an agreed one is taken; pairs of too few decisions or users are not."""
    rows = [(1, "a", "approved", 7, 1), (2, "a", "modified", 7, 2), (3, "b", "approved", 7, 1), (4, "b", "approved", 7, 1), (2, "c", "rejected", 9, 5), (5, "a", "approved", 8, 1), (6, "a", "rejected", 8, 2)]
    decisions = spark.createDataFrame([(*r, datetime.date(2020, 1, r[0])) for r in rows], "decision_id long, source_value string, action string, target_concept_id long, user_id int, created_on date")
    found = mapping_batches.agreed(decisions, 2)
    assert sorted((r.decision_id, r.source_value) for r in found.collect()) == [(2, "a"), (2, "c")]
    assert plan(found).count("Relation") == 1 and "Aggregate" not in plan(found)


def test_completion_index_groups_the_data_once(spark):
    """Counting, ranging and writing read the grouped values."""
    met = spark.sparkContext.accumulator(0)

    def counted(k):
        met.add(1)
        return k

    rows = spark.range(0, 40, 1, 2).select((F.col("id") % 7).alias("person_id"), F.lit(1).alias("condition_concept_id"), F.lit(None).cast("date").alias("condition_start_date"), F.udf(counted, "long")("id").alias("k"))
    rows = rows.withColumn("condition_source_value", F.concat(F.lit("v"), F.col("k") % 5)).drop("k")
    cdm = Cdm({"condition_occurrence": rows, "concept": spark.createDataFrame([(1, "c", "v", "S")], "concept_id int, concept_name string, vocabulary_id string, standard_concept string")})
    assert vocabulary.source_values(cdm).count() == 5
    once, met.value = met.value, 0
    assert autocomplete.completion_index(cdm).where("kind = 'value'").count() == 5 and met.value == once


def test_pending_ranks_decisions_of_found_values_only(spark):
    cdm = star_cdm(spark, SMALL)
    text = plan(services._pending(cdm))
    assert text.index("Window") < text.index("LeftSemi")


def test_sections_of_a_batch_share_joined_tables(spark):
    shared, own = services._shared_cdm(spark, SMALL), star_cdm(spark, SMALL)
    rows = lambda df: sorted(map(str, df.collect()))
    for make in (lambda c: quality.monthly(c, "Drug"), lambda c: quality.mapping_rates(c, "Drug"), lambda c: quality.obs_length(c)):
        text = plan(make(shared))
        assert "l_orderkey" not in text and "event_type" not in text and rows(make(shared)) == rows(make(own))
