"""Data quality and characterization of a data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import age_bracket, age_months, age_years
from tessera.sources.cdm import Cdm

#: inclusive brackets of the population table
AGE_GROUPS = [(0, 17, "0-17"), (18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"), (50, 59, "50-59"), (60, 69, "60-69"), (70, 79, "70-79"), (80, 200, "80+")]
PERCENTS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _names(cdm: Cdm) -> DataFrame:
    return cdm.table("concept").select("concept_id", "concept_name")


def dashboard(cdm: Cdm) -> DataFrame:
    """Records, persons, source terms and mapped terms of each domain."""
    parts = [cdm.events(d).select(F.lit(d).alias("domain"), "person_id", "source_value", "concept_id") for d in cdm.domains()]
    rows = _union(parts)
    # terms and persons are counted from groups of their own: distinct counts side by side would expand every event
    terms = rows.groupBy("domain", "source_value").agg(F.count("*").alias("n"), F.max(F.col("concept_id") > 0).alias("mapped"))
    terms = terms.groupBy("domain").agg(F.sum("n").alias("n_records"), F.count("source_value").alias("n_terms"), F.count(F.when(F.col("mapped"), F.col("source_value"))).alias("n_mapped_terms"))
    persons = rows.select("domain", "person_id").distinct().groupBy("domain").agg(F.count("person_id").alias("n_persons"))
    out = terms.join(persons, "domain").select("domain", "n_records", "n_persons", "n_terms", "n_mapped_terms")
    return out.withColumn("pct_mapped", F.when(F.col("n_terms") > 0, F.round(100.0 * F.col("n_mapped_terms") / F.col("n_terms"), 2)).otherwise(F.lit(0.0)))


def person_counts(cdm: Cdm, column: str) -> DataFrame:
    """(label, n_persons) of a concept column of person."""
    names = _names(cdm).withColumnRenamed("concept_id", column)
    return cdm.table("person").join(names, column, "left").groupBy(F.coalesce("concept_name", F.lit("UNKNOWN")).alias("label")).agg(F.count("*").alias("n_persons"))


def birth_years(cdm: Cdm) -> DataFrame:
    return cdm.table("person").where(F.col("year_of_birth").between(1850, int(cdm.as_of[:4]))).groupBy("year_of_birth").agg(F.count("*").alias("n_persons"))


def person_periods(cdm: Cdm) -> DataFrame:
    """Each person's first start and last end of observation, with birth date and sex."""
    span = cdm.table("observation_period").groupBy("person_id").agg(F.min("observation_period_start_date").alias("start"), F.max("observation_period_end_date").alias("end"))
    # unknown (null or 0) is July and the 1st; a day that the month doesn't have is its last
    month = F.make_date("year_of_birth", F.coalesce(F.nullif("month_of_birth", F.lit(0)), F.lit(7)), F.lit(1))
    birth = F.date_add(month, F.least(F.coalesce(F.nullif("day_of_birth", F.lit(0)), F.lit(1)), F.dayofmonth(F.last_day(month))) - 1)
    names = _names(cdm).select(F.col("concept_id").alias("gender_concept_id"), F.col("concept_name").alias("gender"))
    people = cdm.table("person").join(names, "gender_concept_id", "left").select("person_id", birth.alias("birth"), F.coalesce("gender", F.lit("UNKNOWN")).alias("gender"))
    return span.join(people, "person_id")


def obs_age_first(cdm: Cdm) -> DataFrame:
    age = age_years(F.col("birth"), F.col("start"))
    return person_periods(cdm).select(age.alias("age")).where("age between 0 and 120").groupBy("age").agg(F.count("*").alias("n_persons"))


def quantiles(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Count, mean and five exact quantiles of a value for each group."""
    ps = [F.round(F.percentile("x", p), 4).alias(f"p{int(p * 100)}") for p in PERCENTS]
    return df.select(F.col(by), value.cast("double").alias("x")).groupBy(by).agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), *ps)


def obs_age_gender(cdm: Cdm) -> DataFrame:
    return quantiles(person_periods(cdm), "gender", F.datediff("start", "birth") / 365.25)


def _months() -> Column:
    return F.greatest(F.lit(0), age_months(F.col("start"), F.col("end")))


def obs_length(cdm: Cdm, cap: int = 120) -> DataFrame:
    return person_periods(cdm).groupBy(F.least(_months(), F.lit(cap)).alias("months")).agg(F.count("*").alias("n_persons"))


def obs_duration_gender(cdm: Cdm) -> DataFrame:
    return quantiles(person_periods(cdm), "gender", _months())


def obs_cumulative(cdm: Cdm, cap: int = 120) -> DataFrame:
    """Share of persons observed for at least so many months; the windows run over the distinct months only."""
    w = Window.partitionBy(F.lit(0))
    n = F.sum("n_persons").over(w.orderBy(F.desc("months")))
    return obs_length(cdm, cap).select("months", F.round(100.0 * n / F.sum("n_persons").over(w), 2).alias("pct"))


def obs_continuous(cdm: Cdm) -> DataFrame:
    """Persons observed from the first to the last day of a year."""
    first = F.year("observation_period_start_date") + F.when((F.month("observation_period_start_date") == 1) & (F.dayofmonth("observation_period_start_date") == 1), 0).otherwise(1)
    last = F.year("observation_period_end_date") - F.when((F.month("observation_period_end_date") == 12) & (F.dayofmonth("observation_period_end_date") == 31), 0).otherwise(1)
    years = cdm.table("observation_period").select("person_id", first.alias("a"), last.alias("b")).where("a <= b").select("person_id", F.explode(F.sequence("a", "b")).alias("year"))
    return years.groupBy("year").agg(F.countDistinct("person_id").alias("n_persons"))


def domain_totals(cdm: Cdm, domain: str) -> DataFrame:
    return cdm.events(domain).agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons"))


def monthly(cdm: Cdm, domain: str) -> DataFrame:
    return cdm.events(domain).where("event_date is not null").groupBy(F.trunc("event_date", "month").alias("month")).agg(F.count("*").alias("n_records"))


def records_per_person(cdm: Cdm, domain: str, most: int = 100) -> DataFrame:
    each = cdm.events(domain).groupBy("person_id").agg(F.count("*").alias("n"))
    return each.groupBy(F.least("n", F.lit(most)).alias("n_records")).agg(F.count("*").alias("n_persons"))


def top_concepts(cdm: Cdm, domain: str, n: int = 50, values: int = 10) -> DataFrame:
    """The n most frequent mapped concepts with at most `values` of their source values."""
    rows = cdm.events(domain).where("concept_id > 0").select("concept_id", "person_id", "source_value")
    top = rows.groupBy("concept_id").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons")).join(_names(cdm), "concept_id")
    top = top.select("concept_id", "concept_name", "n_records", "n_persons").orderBy(F.desc("n_records"), "concept_id").limit(n)
    # values only of these n concepts
    pairs = rows.where("source_value is not null").join(F.broadcast(top.select("concept_id")), "concept_id", "left_semi").select("concept_id", "source_value").distinct()
    few = pairs.withColumn("k", F.row_number().over(Window.partitionBy("concept_id").orderBy("source_value"))).where(F.col("k") <= values)
    return top.join(few.groupBy("concept_id").agg(F.array_join(F.sort_array(F.collect_list("source_value")), ", ").alias("source_values")), "concept_id", "left")


def mapping_rates(cdm: Cdm, domain: str) -> DataFrame:
    rows, c = cdm.events(domain), F.col("concept_id")
    mapped = F.when(c > 0, F.col("source_value"))
    out = rows.agg(F.countDistinct("source_value").alias("n_terms"), F.countDistinct(mapped).alias("n_mapped_terms"), F.count("*").alias("n_rows"), F.count(F.when(c > 0, 1)).alias("n_mapped_rows"), F.count(F.when(c.isNull() | (c == 0), 1)).alias("n_unmapped_rows"))
    return out.withColumn("pct_rows", F.round(100.0 * F.col("n_mapped_rows") / F.col("n_rows"), 2))


def top_unmapped(cdm: Cdm, domain: str, n: int = 50) -> DataFrame:
    """The most frequent source values of concept 0; rows without concept are not listed."""
    rows = cdm.events(domain).where("concept_id = 0 and source_value is not null")
    return rows.groupBy("source_value").agg(F.count("*").alias("n_records"), F.countDistinct("person_id").alias("n_persons")).orderBy(F.desc("n_records"), "source_value").limit(n)


def conformity(cdm: Cdm) -> DataFrame:
    """(check_name, n_violations, pct, status) of the rule checks."""
    today = F.to_date(F.lit(cdm.as_of))
    people = cdm.table("person")
    observed = cdm.table("observation_period").select("person_id", F.lit(1).alias("seen")).distinct()
    joined = people.join(observed, "person_id", "left")
    grade = lambda pct, ok, warn: F.when(pct < ok, "pass").when(pct < warn, "warning").otherwise("fail")
    count = lambda n: F.when(n == 0, "pass").when(n < 100, "warning").otherwise("fail")

    def rated(df: DataFrame, name: str, bad: Column, ok: int, warn: int) -> DataFrame:
        out = df.agg(F.count(F.when(bad, 1)).alias("n_violations"), F.count("*").alias("n"))
        pct = F.when(F.col("n") > 0, 100.0 * F.col("n_violations") / F.col("n")).otherwise(F.lit(0.0))
        return out.select(F.lit(name).alias("check_name"), "n_violations", F.round(pct, 4).alias("pct"), grade(pct, ok, warn).alias("status"))

    def counted(df: DataFrame, name: str, bad: Column, status) -> DataFrame:
        out = df.agg(F.count(F.when(bad, 1)).alias("n_violations"))
        return out.select(F.lit(name).alias("check_name"), "n_violations", F.lit(None).cast("double").alias("pct"), status(F.col("n_violations")).alias("status"))

    several = cdm.table("observation_period").groupBy("person_id").agg(F.count("*").alias("k"))
    warn = lambda n: F.when(n == 0, "pass").otherwise("warning")
    fail = lambda n: F.when(n == 0, "pass").otherwise("fail")
    parts = [
        rated(joined, "persons_without_observation", F.col("seen").isNull(), 1, 10),
        rated(people, "unmapped_gender", F.col("gender_concept_id").isNull() | (F.col("gender_concept_id") == 0), 1, 5),
        counted(people, "future_births", F.col("year_of_birth") > F.year(today), fail),
        counted(several, "several_observation_periods", F.col("k") > 1, warn),
        counted(cdm.table("observation_period"), "future_observation", F.col("observation_period_end_date") > today, warn),
    ]
    for d in cdm.domains():  # one pass over a domain gives both of its checks
        unmapped, future = F.col("concept_id").isNull() | (F.col("concept_id") == 0), F.col("event_date") > today
        sums = cdm.events(d).agg(F.count(F.when(unmapped, 1)).alias("u"), F.count(F.when(future, 1)).alias("f"), F.count("*").alias("n"))
        pct = F.when(F.col("n") > 0, 100.0 * F.col("u") / F.col("n")).otherwise(F.lit(0.0))
        row = lambda name, n, pct, status: F.struct(F.lit(name).alias("check_name"), F.col(n).alias("n_violations"), pct.alias("pct"), status.alias("status"))
        both = F.array(row(f"{d}_unmapped", "u", F.round(pct, 4), grade(pct, 5, 20)), row(f"{d}_future", "f", F.lit(None).cast("double"), count(F.col("f"))))
        parts.append(sums.select(F.explode(both).alias("__row")).select("__row.*"))
    visits = cdm.table("visit_occurrence").select("visit_occurrence_id", F.lit(1).alias("seen")).distinct()
    drugs = cdm.events("Drug").join(visits, "visit_occurrence_id", "left")
    parts.append(counted(drugs, "Drug_orphan_visits", F.col("visit_occurrence_id").isNotNull() & F.col("seen").isNull(), count))
    return _union(parts)


def conformity_score(checks: DataFrame) -> DataFrame:
    """(score, total_checks, passed, warnings, failures) of conformity(): the score is the share of passed checks in percent."""
    n = lambda status: F.count(F.when(F.col("status") == status, 1))
    sums = checks.agg(F.count("*").alias("total_checks"), n("pass").alias("passed"), n("warning").alias("warnings"), n("fail").alias("failures"))
    score = F.when(F.col("total_checks") > 0, F.bround(100.0 * F.col("passed") / F.col("total_checks"), 1)).otherwise(F.lit(0.0))
    return sums.select(score.alias("score"), "*")


def compare_snapshots(a: DataFrame, b: DataFrame, key: str, threshold: float = 5.0) -> DataFrame:
    """(key, metric, value_a, value_b, pct_change, alert) between two snapshots of the same metrics."""
    metrics = [c for c in a.columns if c != key]
    long = lambda df, v: df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(key, "x.metric", F.col("x.v").alias(v))
    both = long(a, "value_a").join(long(b, "value_b"), [key, "metric"], "full_outer")
    change = F.when(F.col("value_a") != 0, (F.col("value_b") - F.col("value_a")) / F.abs("value_a") * 100)
    both = both.withColumn("pct_change", F.round(change, 4))
    size = F.abs("pct_change")
    return both.withColumn("alert", F.when(size > 2 * threshold, "critical").when(size > threshold, "warning"))


def t1_age(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    age = F.lit(int(cdm.as_of[:4])) - F.col("year_of_birth")
    rows = cdm.table("person").join(cohort, "person_id", "left_semi").select(age.alias("a"))
    return rows.agg(F.count("a").alias("n"), F.round(F.avg("a"), 4).alias("mean"), F.round(F.stddev_samp("a"), 4).alias("sd"), F.min("a").alias("min"), F.max("a").alias("max"), *(F.percentile("a", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)))


def t1_age_groups(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    age = F.lit(int(cdm.as_of[:4])) - F.col("year_of_birth")
    rows = cdm.table("person").join(cohort, "person_id", "left_semi").select(age_bracket(age, AGE_GROUPS).alias("age_group"))
    return rows.groupBy("age_group").agg(F.count("*").alias("n_persons"))


def t1_categoricals(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """The margins of sex, race and ethnicity from one pass by grouping sets."""
    people = cdm.table("person").join(cohort, "person_id", "left_semi")
    sets = people.groupingSets([["gender_concept_id"], ["race_concept_id"], ["ethnicity_concept_id"]], "gender_concept_id", "race_concept_id", "ethnicity_concept_id").agg(F.count("*").alias("n_persons"), F.grouping_id().alias("g"))
    field = F.when(F.col("g") == 3, "gender").when(F.col("g") == 5, "race").otherwise("ethnicity")
    rows = sets.select(field.alias("field"), F.coalesce("gender_concept_id", "race_concept_id", "ethnicity_concept_id").alias("concept_id"), "n_persons")
    return rows.join(_names(cdm), "concept_id", "left").groupBy("field", F.coalesce("concept_name", F.lit("Unknown")).alias("label")).agg(F.sum("n_persons").alias("n_persons"))


def t1_prevalence(cdm: Cdm, cohort: DataFrame, n: int = 25) -> DataFrame:
    """The most frequent concepts of each domain in a cohort, with the share of its persons."""
    size = cohort.agg(F.countDistinct("person_id").alias("size"))
    parts = [cdm.events(d).select(F.lit(d).alias("domain"), "person_id", "concept_id") for d in cdm.domains()]
    rows = _union(parts).where("concept_id > 0").join(cohort, "person_id", "left_semi").join(_names(cdm), "concept_id")
    counts = rows.groupBy("domain", "concept_id", "concept_name").agg(F.countDistinct("person_id").alias("n_persons"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n_persons"), "concept_id"))).where(F.col("k") <= n).drop("k")
    return top.select("domain", "concept_id", "concept_name", "n_persons", F.round(100.0 * F.col("n_persons") / size.scalar(), 2).alias("pct"))


def t1_measurements(cdm: Cdm, cohort: DataFrame, n: int = 15) -> DataFrame:
    rows = cdm.events("Measurement").where("value_as_number is not null and concept_id > 0").join(cohort, "person_id", "left_semi").join(_names(cdm), "concept_id")
    v = F.col("value_as_number")
    out = rows.groupBy("concept_id", "concept_name").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("n_persons"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(F.percentile(v, 0.5), 4).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))
    units = rows.groupBy("concept_id", "unit_concept_id").agg(F.count("*").alias("k")).groupBy("concept_id").agg(F.min(F.struct(-F.col("k"), "unit_concept_id")).alias("x")).select("concept_id", F.col("x.unit_concept_id").alias("unit"))
    return out.orderBy(F.desc("n_persons"), "concept_id").limit(n).join(units, "concept_id", "left")


def t1_visits(cdm: Cdm, cohort: DataFrame, n: int = 15) -> DataFrame:
    rows = cdm.events("Visit").join(cohort, "person_id", "left_semi").join(_names(cdm), "concept_id", "left")
    days = F.greatest(F.datediff("event_end_date", "event_date"), F.lit(0)).cast("double")
    return rows.groupBy("concept_id", F.coalesce("concept_name", F.lit("Unknown")).alias("label")).agg(F.count("*").alias("n_visits"), F.countDistinct("person_id").alias("n_persons"), F.round(F.avg(days), 4).alias("mean_days"), F.percentile(days, 0.5).alias("median_days"), F.max(days).alias("max_days")).orderBy(F.desc("n_visits"), "concept_id").limit(n)


def t1_obs_period(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    rows = cdm.table("observation_period").join(cohort, "person_id", "left_semi")
    days = F.datediff("observation_period_end_date", "observation_period_start_date").cast("double")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(days), 4).alias("mean"), F.round(F.stddev_samp(days), 4).alias("sd"), F.min(days).alias("min"), F.max(days).alias("max"), F.percentile(days, 0.5).alias("median"), F.min("observation_period_start_date").alias("earliest"), F.max("observation_period_end_date").alias("latest"))
