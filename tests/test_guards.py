"""What users send is checked before it runs."""

import pytest

from tessera.functions import guards


@pytest.mark.parametrize("name", ["person", "_x1", "A" * 63])
def test_identifiers(name):
    assert guards.identifier(name) == name


@pytest.mark.parametrize("name", ["", None, "1a", "a-b", "a;drop", "a b", "A" * 64, "é"])
def test_other_names_are_no_identifiers(name):
    with pytest.raises(ValueError):
        guards.identifier(name)


def _nested(depth):
    group = {"criteria": []}
    for _ in range(depth):
        group = {"criteria": [], "groups": [group]}
    return {"inclusion": group}


@pytest.mark.parametrize(
    "document",
    [[], {"inclusion": []}, {"exclusion": {"criteria": ["x"]}}, {"inclusion": {"criteria": [{"nested_cohort_sql": "select 1"}]}}, {"inclusion": {"criteria": [{"concept_ids": "1"}]}}, {"inclusion": {"criteria": [{"concept_ids": ["1"]}]}}, {"inclusion": {"criteria": [{"concept_ids": [1] * (guards.MAX_CONCEPTS + 1)}]}}, _nested(guards.MAX_DEPTH + 1)],
)
def test_bad_criteria(document):
    with pytest.raises(ValueError):
        guards.checked_criteria(document)


@pytest.mark.parametrize("document", [{}, {"inclusion": {"criteria": [{"concept_ids": [1, 2]}]}}, _nested(guards.MAX_DEPTH)])
def test_good_criteria(document):
    assert guards.checked_criteria(document) is document


@pytest.mark.parametrize("sql", ["", "drop table x", "insert into x values (1)", "select 1; delete from x", "with a as (select 1) update x set y = 1", "create table x as select 1", "explain drop table x", "with a as (select 1) insert into x select * from a", "select reflect('java.lang.System', 'exit', 1)", "set x = 1", "selec 1 from x", "cache table x"])
def test_changing_statements(spark, sql):
    with pytest.raises(ValueError):
        guards.read_only(spark, sql)


def test_reading_statements(spark):
    assert guards.read_only(spark, "select id from range(50)", 7).count() == 7
    assert guards.read_only(spark, "select id, 'update ' as t, 'drop table' as `limit` from range(50)", 7).count() == 7
    assert guards.read_only(spark, "select a.id from (select id from range(50) limit 40) a", 7).count() == 7
    assert guards.read_only(spark, "select id from range(50) where id in (select id from range(30) limit 20)", 7).count() == 7
    assert guards.read_only(spark, "select id from range(50) order by id limit 20", 7).count() == 20
    assert "Range" in guards.read_only(spark, "explain select id from range(50)").first()[0]
    assert guards.read_only(spark, "with a as (select id as created_on from range(50)) select * from a limit 20;", 7).count() == 20


def test_schema_rows(spark):
    tables = {"a": spark.createDataFrame([], "person_id long, x string"), "b": spark.createDataFrame([], "person_id long, b_id int")}
    got = {(r.table, r.column): (r.type, r.shared) for r in guards.schema_rows(spark, tables).collect()}
    assert got == {("a", "person_id"): ("bigint", True), ("a", "x"): ("string", False), ("b", "person_id"): ("bigint", True), ("b", "b_id"): ("int", False)}
