import datetime

from pyspark.sql import functions as F

from tessera.operators import drug_names, exports, lineage
from tessera.sources.cdm import Cdm

CONCEPT = "concept_id int, concept_name string, domain_id string, standard_concept string, invalid_reason string"
PAGE = """<h2>About</h2><h1 id="a">1/2) Repertoire 'stage'</h1><h2 data-x="1">1/2) Fichier 'stage.3_pat_to_axi.java'</h2><h4>Patients <b>all</b></h4>
<table><tr><th><em>Source</em><br/>class Parent</th><th><em>Destination</em><br>stage.axi</th></tr>
<tr><td>ID</td><td>person_id (NUMBER, 10)</td><td>key</td></tr><tr><td>A</td><td>b</td><td></td></tr></table>
<h4>SQL</h4><pre>
select <b>1</b></pre><h4>Clause WHERE</h4> <pre>a=1</pre><h5>Clé primaire: 'ID'</h5>
<h2>2/2) Fichier 'stage.x'</h2><table><tr><th><em>Source</em><br>app.pat</th> <th><em>Destination</em><br>class 'bio_axi' extends 'Base'</th></tr></table>
<h1>2/2) Repertoire 'final'</h1><h2>1/1) Fichier 'final.x'</h2><h4>SQL</h4><pre>q</pre><th><em>Source</em><br>final.axi</th><th><em>Destination</em><br>final.person</th>"""


def test_parsed_names(spark):
    names = ["HYDROXYZINE 25 MG CPR (ATARAX)", "paracetamol 1,5g/100ML INJ PERF", "AMOXICILLINE/ 500 mg/ml SACHET", "INSULINE GLARGINE 100 UI/ML stylo (Lantus)", "Comprime GEL", "", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", drug_names.parsed(F.col("n")).alias("p")).select("k", "p.*", drug_names.english(F.col("p.ingredient")).alias("en"))
    assert [tuple(r)[1:] for r in rows.orderBy("k").collect()] == [
        ("HYDROXYZINE", "25 MG", ["Oral Tablet"], "ATARAX", "HYDROXYZIN"),
        ("PARACETAMOL", "1.5 G", ["Injectable", "Injection", "Intravenous"], None, "ACETAMINOPHEN"),
        ("AMOXICILLINE", "500 MG/ML", ["Oral Powder", "Oral Granules"], None, "AMOXICILLIN"),
        ("INSULINE GLARGINE", "100 UI/ML", ["Pen Injector", "Injectable"], "LANTUS", "INSULIN GLARGINE"),
        ("COMPRIME", None, ["Oral Capsule"], None, "COMPRIME"),
        ("", None, [], None, ""),
        (None, None, None, None, None),
    ]


def test_suggestions_by_name(spark):
    concepts = [
        (1, "Acetaminophen 500 MG Oral Tablet [Doliprane]", "Drug", "S", None),
        (2, "acetaminophen", "Drug", "S", None),
        (3, "Paracétamol brut", "Drug", "S", None),
        (4, "acetaminophen 500 MG", "Observation", "S", None),
        (5, "Aspirin", "Drug", "S", None),
        (6, "acetaminophen old", "Drug", "S", "D"),
        (7, None, "Drug", "S", None),
    ]
    cdm = Cdm({"concept": spark.createDataFrame(concepts, CONCEPT), "concept_synonym": spark.createDataFrame([(5, "paracetamol faux 500 MG"), (5, None)], "concept_id int, concept_synonym_name string")})
    terms = spark.createDataFrame([("a", "PARACETAMOL 500 MG CPR (DOLIPRANE)"), ("b", "PARACETAMOL 500 MG INJ"), ("c", "ab"), ("d", None)], "source_value string, source_name string")
    got = {(r.source_value, r.concept_id, r.strategy, r.confidence) for r in drug_names.suggest_by_name(cdm, terms, "Drug").collect()}
    dosed = {("a", 1, "ingredient", 95), ("a", 4, "ingredient", 85), ("a", 2, "ingredient", 78), ("a", 3, "ingredient", 78), ("a", 5, "synonym", 78)}
    assert got == dosed | {("b", k, "ingredient", 78) for k in (1, 2, 3, 4)} | {("b", 5, "synonym", 78)}
    assert drug_names.suggest_by_name(cdm, terms.limit(0), "Drug").count() == 0


def test_no_name_meets_all_concepts_of_its_words(spark):
    """Distinct searches get their best five rows, with a brand or without, before they meet names; they are those of all rows."""
    concepts = [(k, f"acetaminophen {'x' * (k % 40)} [{'Doliprane' if k % 7 == 0 else 'Other'}]", "Drug", "S", None) for k in range(400)]
    cdm = Cdm({"concept": spark.createDataFrame(concepts, CONCEPT), "concept_synonym": spark.createDataFrame([], "concept_id int, concept_synonym_name string")})
    terms = spark.createDataFrame([(str(k), f"PARACETAMOL {k} MG (DOLIPRANE)") for k in range(1, 201)] + [("q", "PARACETAMOL (QQ)"), ("z", "PARACETAMOL")], "source_value string, source_name string")
    found = drug_names.suggest_by_name(cdm, terms, "Drug")
    got = {}
    for r in found.collect():
        got.setdefault(r.source_value, set()).add((r.concept_id, r.confidence))
    best = lambda rows: {k for k, name, *_ in sorted(rows, key=lambda c: (len(c[1]), c[0]))[:5]}
    own, every = best(c for c in concepts if "Doliprane" in c[1]), best(concepts)
    assert got["z"] == got["q"] == {(k, 78) for k in every}
    assert all({k for k, _ in got[str(k)]} == own for k in range(1, 201))
    hits = drug_names._best_by_name(spark.createDataFrame([(f"p{k}", 1, "acetaminophen", None, [], f"B{k}") for k in range(300)], "ingredient string, turn int, first string, second string, forms array<string>, brand string"), cdm.table("concept").select("concept_id", "concept_name", (F.col("domain_id") == "Drug").alias("inside")))
    assert hits.count() == 1500


def test_turns_end_at_five(spark):
    concepts = [(k, f"acetaminophen 500 MG {'x' * k}", "Drug", "S", None) for k in range(7)] + [(9, "acetaminophen", "Drug", "S", None)]
    cdm = Cdm({"concept": spark.createDataFrame(concepts, CONCEPT), "concept_synonym": spark.createDataFrame([], "concept_id int, concept_synonym_name string")})
    terms = spark.createDataFrame([("a", "PARACETAMOL 500 MG")], "source_value string, source_name string")
    assert sorted(r.concept_id for r in drug_names.suggest_by_name(cdm, terms, "Drug").collect()) == [0, 1, 2, 3, 4]


def test_lineage_of_documents(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>"), (4, "")], "id int, html string")
    found = lineage.blocks(pages, "id", "html")
    first, second, third = found.orderBy("section_no", "block_no").collect()
    assert (first.file, first.description, first.source_table, first.dest_table) == ("stage.3_pat_to_axi.java", "Patients all", "stage.pat", "stage.axi")
    assert [tuple(c) for c in first.columns] == [("ID", "person_id", "NUMBER, 10", "key"), ("A", "b", None, None)]
    assert (first.sql, first.transformation_code, first.where_filter, first.source_primary_key) == ("select 1", None, "a=1", "ID")
    assert (second.source_table, second.dest_table, second.description, second.columns) == ("app.pat", "stage.bio_axi", None, [])
    assert (third.repertoire, third.sql, third.description) == ("final", "q", None)
    base = {"stage.bio_axi": "stage.bio", "stage.none": "stage.bio"}
    nodes = lineage.graph_nodes(found, "id", {"app": "source", "stage": "staging", "final": "omop"}, ["app"], base)
    edges = lineage.graph_edges(found, nodes, "id", base)
    nodes, edges = lineage.repaired(nodes, edges, "id", "final", "stage", ("person",))
    assert {(r.table, r.layer, r.system) for r in nodes.collect()} == {
        ("app.pat", "source", "app"), ("stage.pat", "staging", "unknown"), ("stage.axi", "staging", "stage"),
        ("stage.bio_axi", "staging", "stage"), ("stage.bio", "staging", "stage"), ("final.person", "omop", "final"),
    }
    assert {(r.source, r.target, r.n_columns) for r in edges.collect()} == {("stage.pat", "stage.axi", 2), ("app.pat", "stage.bio_axi", 0), ("stage.axi", "final.person", 0), ("stage.bio_axi", "stage.bio", 0)}
    assert lineage.blocks(pages, "id", "html", ("stage",)).count() == 1


def test_documents_of_a_graph_are_read_once(spark):
    """However often nodes and edges name the blocks of documents."""
    read = spark.sparkContext.accumulator(0)

    def counted(html):
        read.add(1)
        return html

    pages = spark.createDataFrame([(k, PAGE) for k in range(20)], "id int, html string").withColumn("html", F.udf(counted, "string").asNondeterministic()("html"))
    nodes, edges = lineage.graph(lineage.blocks(pages, "id", "html"), "id", {"app": "source", "stage": "staging", "final": "omop"}, ["app"], "final", "stage", ("person",))
    assert (nodes.count(), edges.count()) == (100, 60) and read.value == 20


def test_parts_of_odd_elements(spark):
    """Rows of three cells alone are columns; cells without a break, empty texts and what stands in a text make no block."""
    html = """<h1>1/1) Repertoire 'stage'</h1><td>a</td><h2>1/1) Fichier 'stage.x'</h2><H4> SQL </H4><PRE class='q'>
<h2>2/2) Fichier 'in'</h2></PRE><h4>Clause WHERE</h4><pre></pre><tr class='r'><td>a</td><td> b </td><td><i>c</i></td><td>d</td><tr><td>e</td><td></td><td>f</td>
<tr><td>g</td><td>h</td></tr><th>Source</th><th>Destination<BR />stage.t</th>"""
    (only,) = lineage.blocks(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").collect()
    assert (only.sql, only.where_filter, only.description, only.source_table, only.dest_table) == ("2/2) Fichier 'in'", None, None, None, "stage.t")
    assert [tuple(c) for c in only.columns] == [("e", "", None, "f")]


def test_history_and_audit_cells(spark):
    day = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([(1, "=a", "approved", 5, "u1", day, "exact", 0.0), (2, None, None, None, None, None, None, None)], "decision_id int, source_value string, action string, target_concept_id int, user_id string, created_on timestamp, suggestion_source string, confidence double")
    a, b = exports.mapping_history(rows).orderBy(F.desc("user")).collect()
    assert (a.source_value, a.created_at, a.confidence_score, a.target_concept_id) == ("'=a", "2024-01-02T03:04:05", 0.0, 5)
    assert (b.source_value, b.created_at, b.confidence_score, b.user) == ("", "", None, "")
    lines = spark.createDataFrame([("2024-01-02T00:00:00", "+u", ["a", "b"], "data.x", "GET", "/", 200, 1.0, None), ("2024-01-03T00:00:00", "u", None, "login", "GET", "/", 200, 1.0, "::1"), (None,) * 9], "ts string, user string, roles array<string>, action string, method string, path string, status int, duration_ms double, ip string")
    (only,) = exports.audit_export(lines, "2024-01-02", "2024-01-02").collect()
    assert (only.user, only.roles, only.ip) == ("'+u", "a,b", "")
    assert exports.audit_export(lines, "2024-01-01", "2024-01-09", action="log").count() == 1
