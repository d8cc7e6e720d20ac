"""Queries take whole tables."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import mapping, similarity
from tessera.sources.cdm import Cdm, star_cdm
from tests.oracle import SMALL


def test_every_line_is_a_decision(spark):
    assert star_cdm(spark, SMALL).table("decision").count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_ingredient_of_terms_with_several_names(spark):
    """Terms that share an ingredient and brand get the same concepts; those with two names the best of both."""
    concepts = [(k, name, "c", "Drug", "S", None) for k, name in enumerate(["red bolt", "red bolt b", "blue bolt", "small bolt", "nut"])]
    cdm = Cdm({"concept": spark.createDataFrame(concepts, "concept_id int, concept_name string, concept_code string, domain_id string, standard_concept string, invalid_reason string")})
    terms = spark.createDataFrame([("t1", "RED BOLT 5 MG (B)"), ("t2", "RED BOLT 5 MG (B)"), ("t3", "BLUE BOLT"), ("t3", "RED BOLT"), ("nut", None)], "source_value string, source_name string")
    got = {(r.source_value, r.concept_id, r.confidence) for r in mapping.suggest_ingredient(cdm, terms, "Drug", 2).collect()}
    red = {(0, 90), (1, 83)}
    assert got == {("t1", *x) for x in red} | {("t2", *x) for x in red} | {("t3", 2, 85), ("t3", 0, 85), ("nut", 4, 85)}


def test_ingredient_meets_few_concepts_of_one_name(spark, monkeypatch):
    """However many concepts have a name, only those of the least ids are compared with ingredients."""
    met = spark.sparkContext.accumulator(0)

    def counted(word):
        met.add(1)
        return word

    concepts = [(k, "red bolt", "c", "Drug", "S", None) for k in range(500, 0, -1)] + [(0, "red bolt b", "c", "Drug", "S", None)]
    cdm = Cdm({"concept": spark.createDataFrame(concepts, "concept_id int, concept_name string, concept_code string, domain_id string, standard_concept string, invalid_reason string")})
    terms = spark.createDataFrame([("t1", "RED BOLT 5 MG (B)"), ("t2", "RED BOLT")], "source_value string, source_name string")
    plain, slow = F.array_distinct, F.udf(counted, "array<string>").asNondeterministic()
    monkeypatch.setattr(mapping.F, "array_distinct", lambda c: slow(plain(c)))
    got = {(r.source_value, r.concept_id, r.confidence) for r in mapping.suggest_ingredient(cdm, terms, "Drug").collect()}
    assert got == {("t1", k, 90) for k in range(1, 6)} | {("t2", k, 85) for k in range(1, 6)} and met.value <= 6


def _near(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(300, None), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    norm = np.sqrt((vectors**2).sum(1))
    unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
    want = {}
    for q in range(0, 300, 50):
        value = np.round(unit @ unit[q], 4)
        want[q] = sorted((-value[t], t) for t in range(300) if t != q)[:7]
    return df, {(q, t, -v, k + 1) for q, found in want.items() for k, (v, t) in enumerate(found)}


def test_nearest_of_each_task_without_joined_pairs(spark, monkeypatch):
    """Ties go to smaller ids across blocks; no row of the plan holds vectors of both sides; the joined way gives the same."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "GROUP_ROWS", 4)
    df, want = _near(spark)
    rows = lambda found: {(r.query_id, r.target_id, r.similarity + 0.0, r["rank"]) for r in found.collect()}
    found = similarity.cosine_topk(df.where("id % 50 = 0"), df, 7)
    assert rows(found) == want and "Join" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    assert rows(similarity.cosine_topk(df.where("id % 50 = 0"), df, 7)) == want


def test_frequent_groups_are_widened_in_place(spark, monkeypatch):
    """What a query is widened to is not shuffled by its group, nor made distinct row by row; many keys give the same."""
    df, _ = _near(spark)
    groups = spark.range(300).selectExpr("id as target_id", "if(id % 3 = 0, null, id % 3) as group_key")
    groups = groups.unionByName(groups.limit(20))
    wide = lambda: similarity.semantic_concept_set(df.where("id % 50 = 0"), df, groups, 7, 0.5, 0.1)
    found = wide()
    text, rows = found._jdf.queryExecution().optimizedPlan().toString(), sorted(map(tuple, found.collect()), key=str)
    assert len(rows) == len(set(rows)) > 1000 and text.count("Aggregate") == 1  # of the few rows without a group
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wide().collect()), key=str) == rows
