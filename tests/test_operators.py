"""Hand-sized cases with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import lineage, pathways, quality, stats
from tessera.sources import files
from tessera.sources.cdm import Cdm


def day(text):
    return dt.date.fromisoformat(text)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_kaplan_meier_all_events(spark):
    rows = spark.createDataFrame([(float(t), 1) for t in (1, 2, 3, 4)], "time double, event int")
    curve = stats.kaplan_meier(rows).orderBy("time").collect()
    assert [r.survival for r in curve] == [1, 0.75, 0.5, 0.25, 0]
    assert stats.median_survival(stats.kaplan_meier(rows)).first().median_time == 2


def test_kaplan_meier_with_censoring(spark):
    rows = spark.createDataFrame([(float(t), e) for t, e in zip((1, 2, 3, 4, 5), (1, 0, 1, 0, 1))], "time double, event int")
    curve = stats.kaplan_meier(rows).where("time > 0").orderBy("time").collect()
    assert [r.at_risk for r in curve] == [5, 3, 1] and curve[-1].survival == 0


def test_log_rank_of_equal_groups(spark):
    rows = spark.createDataFrame([(g, float(t), 1) for g in "ab" for t in (1, 2, 3, 4)], "g string, time double, event int")
    out = stats.log_rank(rows, "g", ["a", "b"]).first()
    assert out.chi_square == 0 and out.p_value == 1


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05)])
def test_chi_square_tail(spark, x, df, p):
    assert math.isclose(one(spark, scalars.chi2_tail(F.col("v"), df), v=x), p, abs_tol=2e-3)


@pytest.mark.parametrize("a, b, months", [("2024-01-31", "2024-02-29", 0), ("2024-01-31", "2024-03-31", 2), ("2024-01-31", "2024-03-30", 1), ("2020-05-05", "2021-05-05", 12)])
def test_age_months(spark, a, b, months):
    assert one(spark, scalars.age_months(F.col("a"), F.col("b")), a=day(a), b=day(b)) == months


@pytest.mark.parametrize("text, out", [("=1+1", "'=1+1"), (" =1+1", "'=1+1"), ("-x", "'-x"), ("x", "x"), ("", ""), ("\tcmd", "cmd"), ("hello  ", "hello"), ("@a", "'@a")])
def test_csv_guard(spark, text, out):
    assert one(spark, scalars.csv_guard(F.col("t")), t=text) == out


def test_csv_guard_of_null_and_numbers(spark):
    assert one(spark, scalars.csv_guard(F.col("t").cast("string")), t=None) == ""
    assert one(spark, scalars.csv_guard(F.col("t")), t=-5) == "'-5"


def test_birth_dates(spark):
    """Months and days that are unknown or that the calendar doesn't have."""
    people = [(1, 2000, 1, 31, 1), (2, 2000, 0, 0, 1), (3, 2000, None, None, 1), (4, 2001, 2, 30, 1), (5, 2000, 2, 29, 1)]
    cdm = Cdm(
        {
            "person": spark.createDataFrame(people, "person_id long, year_of_birth int, month_of_birth int, day_of_birth int, gender_concept_id int"),
            "observation_period": spark.createDataFrame([(k, day("2020-01-01"), day("2021-01-01")) for k in range(1, 6)], "person_id long, observation_period_start_date date, observation_period_end_date date"),
            "concept": spark.createDataFrame([], "concept_id int, concept_name string"),
        }
    )
    got = {r.person_id: str(r.birth) for r in quality.person_periods(cdm).collect()}
    assert got == {1: "2000-01-31", 2: "2000-07-01", 3: "2000-07-01", 4: "2001-02-28", 5: "2000-02-29"}


def test_folding_beyond_the_west(spark):
    assert one(spark, scalars.folded(F.col("t")), t="Škoda źle č ﬁn e\u0301") == "skoda zle c fin e"


def test_folding_and_labels(spark):
    assert one(spark, scalars.folded(F.col("t")), t="Méta ÇÀ") == "meta ca"
    assert one(spark, scalars.clean_drug_label(F.col("t")), t="METFORMINE 500 MG CPR (GLUCOPHAGE)") == "metformine glucophage"
    assert one(spark, scalars.clean_drug_label(F.col("t")), t="500 MG") == "500 mg"


@pytest.mark.parametrize("args, out", [((50.0, 10.0, 60.0, 10.0), -1.0), ((1.0, 0.0, 1.0, 0.0), 0.0), ((1.0, 0.0, 2.0, 0.0), None)])
def test_smd_continuous(spark, args, out):
    assert one(spark, stats.smd_continuous(*map(F.col, "abcd")), **dict(zip("abcd", args))) == out


def test_smd_binary_degenerate(spark):
    assert one(spark, stats.smd_binary(F.col("a"), F.col("b")), a=0.0, b=0.0) == 0 and one(spark, stats.smd_binary(F.col("a"), F.col("b")), a=0.0, b=1.0) is None


def test_eras(spark):
    spans = [("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-04"), ("2024-01-08", "2024-01-09"), ("2024-01-12", "2024-01-13")]
    rows = spark.createDataFrame([(1, "x", day(a), day(b)) for a, b in spans], "person_id long, event_name string, event_start date, event_end date")
    assert pathways.eras(rows, 3).count() == 2  # the end of the row before counts, so the short one inside cuts
    assert pathways.eras(rows, 3, running_max=True).count() == 1


def test_sunburst_prunes_from_the_root(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([["a", "b"], ["a", "b"], ["a", "c"], ["d"]])], "person_id long, path array<string>")
    out = {r.prefix: (r.n_persons, r.pct) for r in pathways.sunburst(rows, 4, 2).collect()}
    assert out == {"a": (3, 75.0), "a > b": (2, 50.0)}


def test_upstream_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    out = {(r.target, r.source, r.hops) for r in lineage.upstream(edges).collect()}
    assert out == {("b", "a", 1), ("c", "b", 1), ("a", "c", 1), ("c", "a", 2), ("a", "b", 2), ("b", "c", 2)}


def test_html_table_rows(spark):
    html = "<h2>One &amp; two</h2><table><tr><th>A</th></tr><tr><td>x <b>y</b></td><td></td></tr></table><h2>Three</h2><tr><td>z</td></tr>"
    rows = lineage.table_rows(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").collect()
    assert [(r.section, r.cells) for r in rows] == [("One & two", ["A"]), ("One & two", ["x y", ""]), ("Three", ["z"])]


def test_codebook_and_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code;label\nA;first\nA;second\n;none\nB;b\n", encoding="utf-8")
    assert {(r.code, r.description) for r in files.read_codebook(spark, str(tmp_path / "c.csv"), "n").collect()} == {("A", "first"), ("B", "b")}
    files.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().a == "'=1"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    for version in (1, 2):
        files.write_snapshot(spark.createDataFrame([(version,)], "n int"), path, "c", "Drug", version)
    assert files.read_snapshot(spark, path, "c", "Drug").first().n == 2 and files.read_snapshot(spark, path, "c", "Drug", 1).first().n == 1
