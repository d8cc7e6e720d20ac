"""Standardised differences, incidence and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import age_bracket, chi2_tail
from tessera.sources.cdm import Cdm


def smd_continuous(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    spread = F.sqrt((sd_a * sd_a + sd_b * sd_b) / 2)
    return F.when(spread > 0, (mean_a - mean_b) / spread).otherwise(F.when(mean_a == mean_b, F.lit(0.0)))


def smd_binary(p_a: Column, p_b: Column) -> Column:
    spread = (p_a * (1 - p_a) + p_b * (1 - p_b)) / 2
    return F.when(spread > 0, (p_a - p_b) / F.sqrt(spread)).otherwise(F.when(p_a == p_b, F.lit(0.0)))


def _first_dates(target: DataFrame, outcome: DataFrame, prior: Column | None = None) -> DataFrame:
    """(person_id, entry, outcome_date, cleared) of the people of target: their first dates, in one grouping of both cohorts.

    prior is a condition on entry and a date of the outcome; whoever has one that meets it is not cleared.
    """
    date, none = F.col("cohort_start_date"), F.lit(None)
    rows = target.select("person_id", date.alias("entry"), none.alias("outcome_date")).unionByName(outcome.select("person_id", none.alias("entry"), date.alias("outcome_date")))
    first = F.min("outcome_date").alias("outcome_date")
    if prior is None:
        return rows.groupBy("person_id").agg(F.min("entry").alias("entry"), first, F.lit(True).alias("cleared")).where("entry is not null")
    rows = rows.withColumn("entry", F.min("entry").over(Window.partitionBy("person_id"))).where("entry is not null")
    return rows.groupBy("person_id", "entry").agg(first, (~F.coalesce(F.max(prior), F.lit(False))).alias("cleared"))


def risk_rows(cdm: Cdm, target: DataFrame, outcome: DataFrame, tar_start: int = 0, tar_end: int | None = None, clean_window: int = 0) -> DataFrame:
    """(person_id, had_outcome, time_days, age, gender_name, calendar_year) of the first target entry of each person.

    target and outcome are dated cohorts.  Only the first outcome counts.  With a clean window, people with any outcome
    from so many days before entry until the time at risk begins are left out.
    """
    period, last = cdm.table("observation_period"), F.col("observation_period_end_date")
    begin, date = F.date_add("entry", tar_start), F.col("outcome_date")
    prior = (date < begin) & (date >= F.date_sub("entry", clean_window)) if clean_window else None
    entry = _first_dates(target, outcome, prior).where("cleared")
    end = last if tar_end is None else F.least(last, F.date_add("entry", tar_end))
    rows = entry.join(period, "person_id").where(F.col("entry").between(F.col("observation_period_start_date"), last)).withColumn("begin", begin).withColumn("end", end).where("begin < end")
    gender = cdm.table("concept").select(F.col("concept_id").alias("gender_concept_id"), F.col("concept_name").alias("gender_name"))
    rows = rows.join(cdm.table("person"), "person_id").join(gender, "gender_concept_id", "left")
    hit = F.coalesce(F.col("outcome_date").between(F.col("begin"), F.col("end")), F.lit(False))
    days = F.datediff(F.when(hit, F.col("outcome_date")).otherwise(F.col("end")), F.col("begin")).cast("double")
    rows = rows.select("person_id", hit.cast("int").alias("had_outcome"), days.alias("time_days"), (F.year("begin") - F.col("year_of_birth")).alias("age"), F.coalesce("gender_name", F.lit("Unknown")).alias("gender_name"), F.year("begin").alias("calendar_year"))
    return rows.where("time_days > 0")


def incidence(rows: DataFrame, strata: list[str] | None = None, age_groups: list[tuple[int, int, str]] | None = None, z: float = 1.96) -> DataFrame:
    """Counts, person-years, rate per person-year, proportion and interval, overall and for each value of each stratum."""
    if age_groups:
        rows = rows.withColumn("age_group", age_bracket(F.col("age"), age_groups))
    # the rows are computed once; each counts overall and in one group of each stratum
    place = lambda stratum, value: F.struct(F.lit(stratum).alias("stratum"), value.cast("string").alias("value"))
    places = F.array(place("overall", F.lit("all")), *(place(s, F.col(s)) for s in strata or []))
    every = rows.select(F.explode(places).alias("__row"), "had_outcome", "time_days").select("__row.*", "had_outcome", "time_days")
    n, d, years = F.count("*"), F.sum("had_outcome"), F.sum("time_days") / 365.25
    out = every.groupBy("stratum", "value").agg(n.alias("target_count"), d.alias("outcome_count"), years.alias("person_years"))
    rate, half = F.col("outcome_count") / F.col("person_years"), z * F.sqrt(F.col("outcome_count").cast("double")) / F.col("person_years")
    some = F.col("outcome_count") > 0
    return out.select("stratum", "value", "target_count", "outcome_count", F.round("person_years", 4).alias("person_years"), F.round(rate, 6).alias("rate"), F.round(F.col("outcome_count") / F.col("target_count"), 6).alias("proportion"), F.round(F.when(some, F.greatest(F.lit(0.0), rate - half)).otherwise(F.lit(0.0)), 6).alias("ci_lower"), F.round(F.when(some, rate + half).otherwise(F.lit(0.0)), 6).alias("ci_upper"))


def risk_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """At each time: events, censored and at risk; one row for each distinct time, so windows run over few rows."""
    times = rows.groupBy(*by, "time").agg(F.sum("event").alias("events"), F.sum(1 - F.col("event")).alias("censored"), F.count("*").alias("n"))
    later = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("time"))
    return times.withColumn("at_risk", F.sum("n").over(later)).drop("n")


def kaplan_meier(rows: DataFrame, by: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """Product-limit curve over (time, event[, by]) with plain Greenwood bounds in [0, 1], at event times and at 0."""
    by = by or []
    table = risk_table(rows, by)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("time")
    d, n = F.col("events"), F.col("at_risk")
    curve = table.withColumn("turn", F.row_number().over(w)).withColumn("empty", F.max(((d == n) & (d > 0)).cast("int")).over(w)).withColumn("logs", F.sum(F.when(d < n, F.log(1 - d / n)).otherwise(F.lit(0.0))).over(w)).withColumn("green", F.sum(F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))).over(w))
    s = F.when(F.col("empty") == 1, F.lit(0.0)).otherwise(F.exp("logs"))
    half = z * s * F.sqrt("green")
    own = F.struct(F.col("time").cast("double").alias("time"), F.round(s, 6).alias("survival"), F.round(F.greatest(F.lit(0.0), s - half), 6).alias("ci_lower"), F.round(F.least(F.lit(1.0), s + half), 6).alias("ci_upper"), "at_risk", "events", "censored")
    one, none = F.lit(1.0), F.lit(0).cast("long")
    zero = F.struct(F.lit(0.0).alias("time"), one.alias("survival"), one.alias("ci_lower"), one.alias("ci_upper"), F.col("at_risk"), none.alias("events"), none.alias("censored"))
    # the row at time 0 stands beside the first time, at which all are at risk; only times with events are on the curve
    rows = F.array_compact(F.array(F.when(F.col("turn") == 1, zero), F.when(F.col("events") > 0, own)))
    return curve.select(*by, F.explode(rows).alias("__row")).select(*by, "__row.*")


def median_survival(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(by or [])).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"))


def log_rank(rows: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """(chi_square, p_value, df): the sum of (O - E)^2 / V over all of groups but the last one, as listed."""
    count = lambda g, what: F.count(F.when(F.col(group).eqNullSafe(F.lit(g)) & what, 1))
    hit, any_ = F.col("event") == 1, F.lit(True)
    each = F.array(*(F.struct(F.lit(g).alias(group), count(g, hit).alias("d"), count(g, any_).alias("n")) for g in groups))
    every = rows.where(F.col(group).isin(groups)).groupBy("time").agg(each.alias("x"))
    # one row for each distinct time, so the windows run over few rows
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("time"))
    risk = F.array(*(F.sum(F.col("x")[k]["n"]).over(down) for k in range(len(groups))))
    every = every.withColumn("risks", risk).withColumn("all_d", F.aggregate("x", F.lit(0).cast("long"), lambda acc, y: acc + y["d"])).withColumn("all_n", F.aggregate("risks", F.lit(0).cast("long"), lambda acc, y: acc + y))
    at = every.where("all_d > 0").select("all_d", "all_n", F.explode(F.arrays_zip("x", "risks")).alias("y")).select("all_d", "all_n", f"y.x.{group}", "y.x.d", F.col("y.risks").alias("risk"))
    n, all_n, all_d = F.col("risk"), F.col("all_n").cast("double"), F.col("all_d")
    e = n * all_d / all_n
    v = F.when(all_n > 1, n * (all_n - n) * all_d * (all_n - all_d) / (all_n * all_n * (all_n - 1))).otherwise(F.lit(0.0))
    sums = at.where("all_n > 0").groupBy(group).agg(F.sum("d").alias("o"), F.sum(e).alias("e"), F.sum(v).alias("v"))
    terms = sums.where(F.col(group) != groups[-1]).agg(F.coalesce(F.sum(F.when(F.col("v") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("v"))), F.lit(0.0)).alias("x"))
    df = len(groups) - 1
    return terms.select(F.round("x", 4).alias("chi_square"), F.round(chi2_tail(F.col("x"), df), 6).alias("p_value"), F.lit(df).alias("df"))


#: Days of a time unit.
UNIT_DAYS = {"days": 1.0, "months": 30.44, "years": 365.25}


def survival_rows(cdm: Cdm, target: DataFrame, outcome: DataFrame, tar_end: int | None = None, unit: str = "days") -> DataFrame:
    """(person_id, time, event, gender, age_group) from the first target entry on; time is in the unit.

    Only the first outcome counts: one before entry, or after the time at risk, leaves the person censored with all of
    the time.  People without time are left out.
    """
    entry, last = _first_dates(target, outcome), F.col("observation_period_end_date")
    end = last if tar_end is None else F.least(last, F.date_add("entry", tar_end))
    rows = entry.join(cdm.table("observation_period"), "person_id").where(F.col("entry").between(F.col("observation_period_start_date"), last)).withColumn("end", end)
    gender = cdm.table("concept").select(F.col("concept_id").alias("gender_concept_id"), F.col("concept_name").alias("gender"))
    rows = rows.join(cdm.table("person"), "person_id").join(gender, "gender_concept_id", "left")
    hit = F.coalesce(F.col("outcome_date").between(F.col("entry"), F.col("end")), F.lit(False))
    days = F.datediff(F.when(hit, F.col("outcome_date")).otherwise(F.col("end")), F.col("entry"))
    groups = age_bracket(F.year("entry") - F.col("year_of_birth"), [(-200, 17, "0-17"), (18, 39, "18-39"), (40, 64, "40-64"), (65, 400, "65+")])
    return rows.where(days > 0).select("person_id", (days / F.lit(UNIT_DAYS[unit])).alias("time"), hit.cast("int").alias("event"), F.coalesce("gender", F.lit("Unknown")).alias("gender"), groups.alias("age_group"))
