"""Lineage of any length, audit logs, CSV files of unknown form, autocomplete ranges and schema keys."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import autocomplete, lineage, schema_keys
from tessera.plans import catalog, services
from tessera.sources import audit, codebooks
from tessera.sources.cdm import star_cdm
from tests.oracle import SMALL


def plan(df):
    return df._jdf.queryExecution().toString()


EDGES = "source string, target string"


def test_chains_of_any_length(spark):
    edges = [(f"t{k}", f"t{k + 1}") for k in range(40)] + [("t40", "t0"), ("x", "t5"), ("x", "x"), (None, "t1"), ("t1", None)]
    df = spark.createDataFrame(edges, EDGES)
    got = {(r.target, r.source): r.hops for r in lineage.reach(df).collect()}
    want = {(f"t{a}", f"t{b}"): (a - b) % 41 for a in range(41) for b in range(41) if a != b} | {(f"t{a}", "x"): (a - 5) % 41 + 1 for a in range(41)}
    assert got == want
    chains = lineage.upstream(df, spark.createDataFrame([("t3",)], "target string")).collect()
    assert len(chains) == 41 and max(r.hops for r in chains) == 40 and all(len(set(r.path)) == r.hops + 1 for r in chains)


def test_shortest_of_several_chains(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("e", "c")]
    got = {(r.target, r.source): r.hops for r in lineage.reach(spark.createDataFrame(edges, EDGES)).collect()}
    assert got[("e", "a")] == 2 and got[("c", "a")] == 2 and got[("d", "a")] == 1 and got[("c", "d")] == 2
    paths = {(r.target, tuple(r.path)) for r in lineage.upstream(spark.createDataFrame(edges, EDGES)).collect()}
    assert ("e", ("e", "d", "c", "b", "a")) in paths and ("e", ("e", "d", "a")) in paths
    none = spark.createDataFrame([], EDGES)
    assert lineage.reach(none).count() == 0 and lineage.upstream(none).count() == 0


def test_reach_writes_each_pair_once(spark, monkeypatch):
    """Rounds write only what they find, and none follows the one that found the last pair."""
    pairs, plain = [], lineage.written

    def counted(df):
        out = plain(df)
        if "hops" in out.columns:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", counted)
    cycle = [(f"a{k}", f"a{(k + 1) % 8}") for k in range(8)] + [("c", "a0"), ("a0", "a0"), (None, "a0")]
    found = lineage.reach(spark.createDataFrame(cycle, EDGES))
    assert found.count() == 64 and found.agg(F.max("hops")).first()[0] == 8
    assert pairs == [9, 9, 18, 28]


def _walked(edges):
    """(target, source): hops by a plain walk from each target."""
    before, found = collections.defaultdict(set), {}
    for s, t in edges:
        before[t].add(s)
    for target in list(before):
        level, hops = {target}, 0
        while level:
            hops += 1
            level = {s for t in level for s in before.get(t, ()) if s != target and (target, s) not in found}
            found |= {(target, s): hops for s in level}
    return found


@pytest.mark.parametrize("bound", [8192, 12])
def test_reach_in_parts_has_the_rows_of_reach(spark, monkeypatch, bound):
    """Parts that go over several batches, a table of many parts, repeated edges, and parts over the bound."""
    edges = [(f"t{k}", f"t{k + 1}") for k in range(20)] + [("t20", "t0"), ("x", "t5"), ("x", "x"), (None, "t1"), ("t1", None)]
    edges += [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "d"), ("d", "e"), ("e", "c")] + [("hub", f"h{k % 7}") for k in range(14)]
    edges = [edges[k * 7 % len(edges)] for k in range(len(edges))]
    assert len(edges) % 7
    monkeypatch.setattr(lineage, "PART_EDGES", bound)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = lineage.reach_in_parts(spark.createDataFrame(edges, EDGES)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _walked([e for e in edges if None not in e and e[0] != e[1]])
    assert {(r.target, r.source): r.hops for r in rows} == want and len(rows) == len(want)
    assert spark.conf.get(lineage._CLEANUP) == "false"
    assert lineage.reach_in_parts(spark.createDataFrame([], EDGES)).count() == 0


def test_pairs_of_a_task_are_listed_in_blocks(monkeypatch):
    """Whatever the bounds on cells and pairs, each pair comes once with its shortest chain."""
    rng = np.random.default_rng(5)
    parts = np.repeat(np.arange(30), rng.integers(1, 40, 30))
    ends = rng.integers(0, 12, (2, len(parts))) + parts * 12
    ends, parts = ends[:, ends[0] != ends[1]], parts[ends[0] != ends[1]]
    source, target = np.unique(ends, return_inverse=True)[1].reshape(ends.shape)
    parts = np.unique(parts, return_inverse=True)[1]
    want = _walked(zip(source.tolist(), target.tolist()))
    for cells, pairs in ((lineage.CELLS, lineage.PAIRS), (1, 1), (50, 7)):
        monkeypatch.setattr(lineage, "CELLS", cells)
        monkeypatch.setattr(lineage, "PAIRS", pairs)
        got = list(lineage._pairs_within(target, source, parts))
        assert all(len(b[0]) <= pairs for b in got)
        rows = [(t, s, h) for b in got for t, s, h in zip(*(c.tolist() for c in b))]
        assert {(t, s): h for t, s, h in rows} == want and len(rows) == len(want)


def test_what_reach_writes_grows_with_the_edges(spark, monkeypatch):
    """The query gives 24 rows for each order; it writes and shuffles no more rows than there are edges."""
    rows, plain = [], lineage.written

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", counted)
    edges = services._order_edges(spark, SMALL).count()
    found = catalog.queries()["lineage_reach"](spark, SMALL)
    assert max(rows) == edges and found.count() > 20 * edges
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.startswith("MapInArrow") and text.count("Repartition") == 1 and "Aggregate" not in text and "Join" not in text


def test_audit_days_are_pruned(spark):
    rows = services._audit(spark, SMALL, "2024-01-10", "2024-01-12")
    assert "PartitionFilters: [isnotnull(day" in plan(rows)
    assert {str(r.day) for r in rows.select("day").distinct().collect()} == {"2024-01-10", "2024-01-11", "2024-01-12"}
    assert "TakeOrderedAndProject" in plan(audit.audit_page(rows, 1, 5))


def test_audit_files(spark, tmp_path):
    for day, lines in {"2024-01-01": ['{"ts":"a","user":"u","action":"x.y"}', "", "{broken", '{"ts":"b","action":"x.z"}'], "2024-01-02": ['{"ts":"c","user":"u","action":"y"}'], "2024-01-05": ['{"ts":"d","user":"v","action":"x"}'], "notes": ['{"ts":"z"}']}.items():
        (tmp_path / f"{day}.jsonl").write_text("\n".join(lines))
    rows = audit.read_daily_files(spark, str(tmp_path), "2024-01-01", "2024-01-03")
    assert {r.ts for r in rows.collect()} == {"a", "b", "c", None}
    assert [(r.ts, r.total) for r in audit.audit_page(rows, 1, 2).collect()] == [("c", 3), ("b", 3)]
    assert [(r.ts, r.total) for r in audit.audit_page(rows, 2, 2).collect()] == [("a", 3)]
    assert [r.ts for r in audit.audit_page(rows, user="u", action="x").collect()] == ["a"]
    stats = {(r.kind, r.name): r.n for r in audit.audit_stats(rows).collect()}
    assert stats == {("events", None): 3, ("malformed", None): 1, ("user", "u"): 2, ("user", "unknown"): 1, ("action", "x.y"): 1, ("action", "x.z"): 1, ("action", "y"): 1}
    assert audit.read_daily_files(spark, str(tmp_path), "2024-01-03", "2024-01-01").count() == 0


def test_codebooks_of_unknown_form(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Code;Libellé;autre\r\nA1;été, hiver;x\r\n A1 ;zweite;x\r\n;ohne;x\r\nB2;;x\r\n".encode())
    (tmp_path / "b.csv").write_bytes("id,code_cim,nom\n1,K1,\"caf\xe9; \"\"noir\"\"\"\n2,K2,th\xe9\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"x,y\nq,r\n")
    got = {(r.name, r.code): r.description for r in codebooks.read_codebooks(spark, str(tmp_path)).collect()}
    assert got == {("a", "A1"): "été, hiver", ("b", "K1"): 'café; "noir"', ("b", "K2"): "thé", ("c", "q"): "r"}
    forms = {r.file.rpartition("/")[2]: (r.encoding, r.sep) for r in codebooks.file_forms(spark, str(tmp_path)).collect()}
    assert forms == {"a.csv": ("UTF-8", ";"), "b.csv": ("ISO-8859-1", ","), "c.csv": ("UTF-8", ",")}
    (tmp_path / "d.csv").write_text("alone\nx\n")
    with pytest.raises(ValueError):
        codebooks.read_codebooks(spark, str(tmp_path))


def test_mappings_and_rejects(spark, tmp_path):
    (tmp_path / "m.csv").write_text("source_code;rank;target_concept_id;similarity;source_name\nA; 2 ;17;0.5; x \nB;;17;0.5;x\nC;1;;0.5;x\n;1;2;0.5;x\nD;1;7.5;n/a;x\nE;1;8;;x\n")
    (tmp_path / "n.csv").write_text("source_code,target_concept_id\nF,9\n")
    good, bad = codebooks.read_mappings(spark, str(tmp_path), "Drug")
    assert {(r.source_code, r.rank, r.target_concept_id, r.similarity, r.source_name) for r in good.collect()} == {("A", 2, 17, 0.5, "x"), ("F", 1, 9, 0.0, "")}
    reasons = {r.line.partition("|")[0]: r.reason for r in bad.collect()}
    assert reasons == {"B": "no number: rank", "C": "no code or target", "": "no code or target", "D": "no number: target_concept_id, similarity", "E": "no number: similarity"}


def test_autocomplete_reads_a_range(spark):
    index = autocomplete.completion_index(star_cdm(spark, SMALL))
    found = autocomplete.complete(index, "Réd", "Drug", 5)
    assert "StringStartsWith(key,red)" in plan(found) and found.count() == 5
    assert autocomplete.complete_fast(index, "r").count() == 0
    assert autocomplete.complete_fast(index, "re%").count() == 0
    assert {r.domain for r in autocomplete.complete_fast(index, "err").collect()} == {"Condition"}


def test_keys_and_relations(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    two = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "id long, one_id long").withColumn("x", F.lit(0.5))
    columns, relations = schema_keys.schema_keys({"one": one, "two": two, "none": spark.createDataFrame([], "id int")})
    assert {(r.table_name, r.column_name, r.n_rows, r.n_null, r.n_distinct, r.is_key) for r in columns.collect()} == {("one", "id", 3, 0, 3, True), ("one", "name", 3, 1, 2, False), ("two", "id", 3, 0, 3, True), ("two", "one_id", 3, 1, 1, False)}
    assert [tuple(r) for r in relations.collect()] == [("two", "one_id", "one", "id", 1)]
