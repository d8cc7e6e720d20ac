"""Cohorts described and compared in one pass over each table.

Members (cohort, person_id) of all cohorts are written once.  Every section of every cohort comes from one scan of the people,
one of each domain and one of the observation periods, as rows of one form, so two cohorts meet in one outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import age_bracket
from tessera.operators.quality import AGE_GROUPS
from tessera.operators.stats import smd_binary, smd_continuous
from tessera.sources.cdm import Cdm
from tessera.sources.scratch import written

FIELDS = ("gender", "race", "ethnicity")


def members(cohorts: dict[str, DataFrame]) -> DataFrame:
    """(cohort, person_id) of named cohorts, written."""
    return written(reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("cohort"), "person_id").distinct() for name, df in cohorts.items()]))


def _people(cdm: Cdm, who: DataFrame) -> DataFrame:
    """Sections size, age, age_group, gender, race and ethnicity, by grouping sets."""
    age = F.lit(int(cdm.as_of[:4])) - F.col("year_of_birth")
    rows = cdm.table("person").join(who, "person_id").select("cohort", age.alias("age"), age_bracket(age, AGE_GROUPS).alias("age_group"), *[F.col(f"{f}_concept_id").cast("string").alias(f) for f in FIELDS])
    keys = ("age_group", *FIELDS)
    sets = rows.groupingSets([["cohort"], *[["cohort", k] for k in keys]], "cohort", *keys).agg(F.count("*").alias("n"), F.avg("age").alias("mean"), F.stddev_samp("age").alias("sd"), F.count("age").alias("n_age"), F.grouping_id().alias("g"))
    section = reduce(lambda c, k: c.when(F.col("g") == 15 - (8 >> k[0]), F.lit(k[1])), enumerate(keys), F.when(F.lit(False), F.lit("")))
    none = F.lit(None).cast("double")
    row = lambda section, variable, n, mean, sd: F.struct(section.alias("section"), variable.alias("variable"), F.col(n).alias("n"), mean.alias("mean"), sd.alias("sd"))
    whole = F.array(row(F.lit("size"), F.lit(""), "n", none, none), row(F.lit("age"), F.lit(""), "n_age", F.col("mean"), F.col("sd")))
    margin = F.array(row(section, F.coalesce(*keys, F.lit("Unknown")), "n", none, none))
    return sets.select("cohort", F.explode(F.when(F.col("g") == 15, whole).otherwise(margin)).alias("x")).select("cohort", "x.*")


def _events(cdm: Cdm, who: DataFrame) -> DataFrame:
    """Sections prevalence_<domain> (persons), measurement (values) and visit_type (visits), a scan for each domain."""
    parts = [cdm.events(d).select(F.lit(d).alias("domain"), "person_id", "concept_id", "value_as_number") for d in cdm.domains()]
    rows = reduce(DataFrame.unionByName, parts).join(F.broadcast(who) if who.count() * 40 <= 32 << 20 else who, "person_id")
    # one row a person first, so that persons are counted without a distinct
    v = F.col("value_as_number")
    each = rows.groupBy("cohort", "domain", "concept_id", "person_id").agg(F.count("*").alias("k"), F.count(v).alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    sums = each.groupBy("cohort", "domain", "concept_id").agg(F.count("*").alias("n_persons"), F.sum("k").alias("n_records"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("c")
    spread = F.when(F.col("c") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("c") * mean * mean) / (F.col("c") - 1))))
    none = F.lit(None).cast("double")
    row = lambda section, n, m, s: F.struct(F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"), F.col(n).alias("n"), m.alias("mean"), s.alias("sd"))
    wanted = F.array_compact(F.array(
        F.when(F.col("concept_id") > 0, row(F.concat(F.lit("prevalence_"), "domain"), "n_persons", none, none)),
        F.when((F.col("c") > 0) & (F.col("concept_id") > 0), row("measurement", "c", mean, spread)),
        F.when(F.col("domain") == "Visit", row("visit_type", "n_records", none, none)),
    ))
    return sums.select("cohort", F.coalesce(F.col("concept_id").cast("string"), F.lit("Unknown")).alias("variable"), F.explode(wanted).alias("x")).select("cohort", "x.section", "variable", "x.n", "x.mean", "x.sd")


def _observed(cdm: Cdm, who: DataFrame) -> DataFrame:
    """Section observation: days of the observation periods."""
    days = F.datediff("observation_period_end_date", "observation_period_start_date")
    rows = cdm.table("observation_period").join(who, "person_id").groupBy("cohort").agg(F.count("*").alias("n"), F.avg(days).alias("mean"), F.stddev_samp(days).alias("sd"))
    return rows.select("cohort", F.lit("observation").alias("section"), F.lit("").alias("variable"), "n", "mean", "sd")


def characterize(cdm: Cdm, who: DataFrame) -> DataFrame:
    """(cohort, section, variable, n, pct, mean, sd) of every cohort of members().

    variable is the bracket or concept id of the section; pct the share of the cohort's persons, null where n counts no persons.
    """
    people = _people(cdm, who)
    rows = reduce(DataFrame.unionByName, [people, _events(cdm, who), _observed(cdm, who)])
    size = who.groupBy("cohort").agg(F.count("*").alias("size"))
    persons = F.col("section").isin("age_group", *FIELDS) | F.col("section").startswith("prevalence_")
    rows = rows.join(F.broadcast(size), "cohort").withColumn("pct", F.when(persons, F.round(100.0 * F.col("n") / F.col("size"), 4)))
    return rows.select("cohort", "section", "variable", "n", "pct", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def compare(described: DataFrame, one: str, two: str) -> DataFrame:
    """Every variable of two cohorts beside each other, with its standardized mean difference: of means where there are means, of
    shares where there are shares.  What only one cohort has counts 0 in the other."""
    a, b = (described.where(F.col("cohort") == c).select("section", "variable", *[F.col(x).alias(f"{x}_{s}") for x in ("n", "pct", "mean", "sd")]) for c, s in ((one, "a"), (two, "b")))
    both = a.join(b, ["section", "variable"], "full_outer")
    share = lambda s: F.coalesce(F.col(f"pct_{s}"), F.lit(0.0)) / 100
    has = lambda x: F.col(f"{x}_a").isNotNull() | F.col(f"{x}_b").isNotNull()

    def size(s: str) -> Column:
        return F.coalesce(F.col(f"n_{s}"), F.lit(0)).cast("long").alias(f"n_{s}")

    smd = F.when(has("pct"), smd_binary(share("a"), share("b"))).when(F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull(), smd_continuous(F.col("mean_a"), F.col("sd_a"), F.col("mean_b"), F.col("sd_b")))
    return both.select("section", "variable", size("a"), size("b"), F.when(has("pct"), 100 * share("a")).alias("pct_a"), F.when(has("pct"), 100 * share("b")).alias("pct_b"), "mean_a", "mean_b", (F.round(smd, 4) + 0.0).alias("smd"))
