"""Cohorts from criteria documents.

A criterion is a relation (person_id[, visit_occurrence_id], event_date, event_end_date); criteria are combined by
intersection and union, exclusions are taken away.  Every plan stays lazy; a criterion that others refer to keeps its
dates, so references may be chained.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.cdm import DOMAINS, Cdm
from tessera.sources.scratch import written

LITERALS = 2000
BROADCAST_BYTES = 32 << 20

OCCURRENCE = {"at_least": lambda c, n: c >= n, "exactly": lambda c, n: c == n, "at_most": lambda c, n: c <= n}
COMPARE = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v}


def relation(name: str) -> Column:
    """An interval relation between event a and its reference r."""
    a, b, s, e = F.col("a.event_date"), F.col("a.event_end_date"), F.col("r.event_date"), F.col("r.event_end_date")
    b, e = F.coalesce(b, a), F.coalesce(e, s)
    return {
        "before": a < s, "after": a > s, "starts_before": a < s, "starts_after": a > s, "ends_before": b < e, "ends_after": b > e,
        "overlaps": (a < e) & (b > s), "contains": (a <= s) & (b >= e), "during": (a >= s) & (b <= e),
    }[name]


def _ids(concepts) -> list[int]:
    return [int(c["concept_id"] if isinstance(c, dict) else c) for c in concepts]


def descendants(cdm: Cdm, ids: list[int]) -> tuple[list[int], DataFrame | None]:
    """Concepts with all their descendants: as a list while there are LITERALS at most, else as a table (concept_id).

    A list becomes a filter of the scan.  A longer set is written, with the concepts themselves, and counted; it is broadcast only
    where its size allows.
    """
    below = cdm.table("concept_ancestor").where(F.col("ancestor_concept_id").isin(ids)).select(F.col("descendant_concept_id").cast("long").alias("concept_id"))
    found = [r["concept_id"] for r in below.limit(LITERALS + 1).collect()]
    if len(found) <= LITERALS:
        return sorted({*ids, *found}), None
    own = below.sparkSession.createDataFrame([(k,) for k in ids], "concept_id long")
    table = written(below.unionByName(own).distinct())
    return ids, F.broadcast(table) if table.count() * 16 <= BROADCAST_BYTES else table


def concept_events(cdm: Cdm, criterion: dict) -> DataFrame:
    """The events of a criterion: concepts with their descendants, or source codes, within absolute dates and values."""
    events = cdm.events(criterion["domain"])
    ids, codes = _ids(criterion.get("concepts", [])), [str(c) for c in criterion.get("source_codes", [])]
    if criterion["domain"] in DOMAINS and not DOMAINS[criterion["domain"]].source_value:
        codes = []
    flag = None
    if ids:
        below = None
        if criterion.get("include_descendants", True):
            ids, below = descendants(cdm, ids)
        if below is not None and not codes:
            events = events.join(below, "concept_id", "left_semi")
        else:
            # as text: a literal each through the gateway takes longer than the query
            flag = F.expr(f"concept_id IN ({', '.join(map(str, ids))})")
        if below is not None and codes:
            events = events.join(below.withColumn("below", F.lit(True)), "concept_id", "left")
            flag = flag | F.coalesce("below", F.lit(False))
    if codes:
        coded = F.coalesce(F.col("source_value").isin(codes), F.lit(False)) | F.coalesce(F.col("source_name").isin(codes), F.lit(False)) | F.coalesce(F.col("source_atc").isin(codes), F.lit(False))
        flag = coded if flag is None else flag | coded
    if flag is not None:
        events = events.where(flag)
    when = criterion.get("temporal") or {}
    if when.get("type") == "absolute_window":
        if when.get("date_from"):
            events = events.where(F.col("event_date") >= F.to_date(F.lit(when["date_from"])))
        if when.get("date_to"):
            events = events.where(F.col("event_date") <= F.to_date(F.lit(when["date_to"])))
    value = criterion.get("value") or {}
    if value.get("operator") and value.get("value") is not None:
        number = F.col("value_as_number")
        between = value["operator"] == "between" and value.get("value_high") is not None
        events = events.where(number.between(float(value["value"]), float(value["value_high"])) if between else COMPARE[value["operator"]](number, float(value["value"])))
    for key in ("value_as_concept_id", "unit_concept_id"):
        if value.get(key) is not None:
            events = events.where(F.col(key) == int(value[key]))
    return events.drop("below")


class CohortBuilder:
    """Builds the relations of one criteria document over a data model."""

    def __init__(self, cdm: Cdm, criteria: dict):
        self.cdm, self.criteria = cdm, criteria
        self.known: dict[str, DataFrame] = {}
        self.initial = criteria.get("initial_event_criterion_id")

    def criterion(self, criterion: dict, visits: bool = False) -> DataFrame:
        """person_id[, visit_occurrence_id], event_date, event_end_date of those who meet a criterion."""
        keys = ["person_id"] + ["visit_occurrence_id"] * visits
        events = concept_events(self.cdm, criterion)
        occurrence = criterion.get("occurrence") or {}
        kind, count, within = occurrence.get("type"), int(occurrence.get("count", 1)), occurrence.get("within_days")
        if kind and kind != "any" and within:
            day = F.datediff("event_date", F.lit("1970-01-01").cast("date"))
            ahead = Window.partitionBy("person_id").orderBy(day).rangeBetween(0, int(within))
            found = events.withColumn("n", F.count("*").over(ahead)).where(OCCURRENCE.get(kind, OCCURRENCE["at_least"])(F.col("n"), count)).select(*keys, "event_date", "event_end_date").distinct()
        else:
            found = events.groupBy(*keys).agg(F.min("event_date").alias("event_date"), F.max("event_end_date").alias("event_end_date"), F.count("*").alias("n"))
            if kind and kind != "any":
                found = found.where(OCCURRENCE.get(kind, OCCURRENCE["at_least"])(F.col("n"), count))
            found = found.drop("n")
        name, when = criterion.get("id"), criterion.get("temporal") or {}
        if name:
            self.known[name] = found
        before, after = when.get("days_before"), when.get("days_after")
        near = lambda start, ref: reduce(lambda x, y: x & y, [c for c in (start >= F.date_sub(ref, int(before)) if before is not None else None, start <= F.date_add(ref, int(after)) if after is not None else None) if c is not None], F.lit(True))
        if when.get("type") == "within_days" and when.get("relative_to") == "index" and (before is not None or after is not None):
            index = self.known.get(self.initial) if self.initial and self.initial != name else None
            if index is None:
                first = events.groupBy("person_id").agg(F.min("event_date").alias("index_date"))
                return events.join(first, "person_id").where(near(F.col("event_date"), F.col("index_date"))).select(*keys, "event_date", "event_end_date").distinct()
            index = index.groupBy("person_id").agg(F.min("event_date").alias("index_date"))
            return found.join(index, "person_id").where(near(F.col("event_date"), F.col("index_date"))).select(*keys, "event_date", "event_end_date").distinct()
        reference = self.known.get(when.get("reference_criterion_id")) if when.get("type") == "relative_to_criterion" else None
        if reference is not None:
            a, r = found.alias("a"), reference.alias("r")
            hit = relation(when.get("relation", "before")) & near(F.col("a.event_date"), F.col("r.event_date"))
            found = a.join(r, (F.col("a.person_id") == F.col("r.person_id")) & hit, "left_semi")
            if name:
                self.known[name] = found
        return found

    def group(self, group: dict, visits: bool = False) -> DataFrame | None:
        """The keys that meet a group: neighbours linked by OR first, then the group's operator, then sub-groups."""
        keys = ["person_id"] + ["visit_occurrence_id"] * visits
        default = group.get("operator", "AND")
        items = sorted(group.get("criteria", []), key=lambda c: c.get("id") != self.initial) if self.initial else group.get("criteria", [])
        built = {id(c): self.criterion(c, visits).select(*keys).distinct() for c in items}
        runs: list[list[DataFrame]] = []
        linked = False
        for c in group.get("criteria", []):
            if linked:
                runs[-1].append(built[id(c)])
            else:
                runs.append([built[id(c)]])
            linked = (c.get("operatorWithNext") or default) == "OR"
        parts = [reduce(lambda x, y: x.union(y).distinct(), run) for run in runs]
        out = reduce(lambda x, y: x.join(y, keys, "left_semi"), parts) if parts else None
        below = [x for x in (self.group(g, visits) for g in group.get("groups", [])) if x is not None]
        every = ([out] if out is not None else []) + below
        if not every:
            return None
        return reduce(lambda x, y: x.union(y).distinct() if default == "OR" else x.join(y, keys, "left_semi"), every)

    def index_dates(self) -> DataFrame | None:
        """(person_id, index_date): the initial event's first date, else the first date of any inclusion criterion."""
        if self.initial and self.initial in self.known:
            return self.known[self.initial].groupBy("person_id").agg(F.min("event_date").alias("index_date"))

        def names(group):
            return [c["id"] for c in group.get("criteria", []) if c.get("id")] + [n for g in group.get("groups", []) for n in names(g)]

        found = [self.known[n].select("person_id", "event_date") for n in names(self.criteria.get("inclusion") or {}) if n in self.known]
        return reduce(DataFrame.unionByName, found).groupBy("person_id").agg(F.min("event_date").alias("index_date")) if found else None

    def demographics(self, rules: dict) -> DataFrame:
        """person_id of those with the wanted sex, race, ethnicity and age (difference of years at index or as_of)."""
        people = self.cdm.table("person")
        for key, column in (("gender", "gender_concept_id"), ("race", "race_concept_id"), ("ethnicity", "ethnicity_concept_id")):
            if rules.get(key):
                people = people.where(F.col(column).isin(_ids(rules[key])))
        if age := rules.get("age"):
            at = F.year(F.to_date(F.lit(self.cdm.as_of)))
            if age.get("at") == "index" and (index := self.index_dates()) is not None:
                people = people.join(index, "person_id")
                at = F.year("index_date")
            years = at - F.col("year_of_birth")
            if age.get("min") is not None:
                people = people.where(years >= int(age["min"]))
            if age.get("max") is not None:
                people = people.where(years <= int(age["max"]))
        return people.select("person_id")

    def build(self) -> DataFrame:
        """The cohort: person_id, with visit_occurrence_id where inclusion asks for the same visit."""
        inclusion, exclusion = self.criteria.get("inclusion") or {}, self.criteria.get("exclusion") or {}
        visits = bool(inclusion.get("sameVisit")) and inclusion.get("operator", "AND") == "AND"
        base = self.group(inclusion, visits)
        if base is None:
            base, visits = self.cdm.table("person").select("person_id"), False
        if self.criteria.get("demographics"):
            base = base.join(self.demographics(self.criteria["demographics"]), "person_id", "left_semi")
        out = self.group(exclusion, visits and bool(exclusion.get("sameVisit")))
        if out is not None:
            base = base.join(out, out.columns, "left_anti")
        return base.distinct()


def build_cohort(cdm: Cdm, criteria: dict) -> DataFrame:
    return CohortBuilder(cdm, criteria).build()


def cohort_count(cdm: Cdm, criteria: dict) -> DataFrame:
    return build_cohort(cdm, criteria).agg(F.countDistinct("person_id").alias("n_persons"))


def cohort_count_approx(cdm: Cdm, criteria: dict, error: float = 0.02) -> DataFrame:
    """A sketch in place of the exact distinct count."""
    return build_cohort(cdm, criteria).agg(F.approx_count_distinct("person_id", error).alias("n_persons"))


def attrition(cdm: Cdm, criteria: dict) -> DataFrame:
    """(step, label, n_persons): everyone, then inclusion and exclusion criteria one after another."""
    inclusion, exclusion = criteria.get("inclusion") or {}, criteria.get("exclusion") or {}
    demographics = criteria.get("demographics")
    label = lambda c: str(c.get("id") or c.get("domain"))
    keep, drop = inclusion.get("criteria", []), exclusion.get("criteria", [])
    if inclusion.get("groups") or exclusion.get("groups") or inclusion.get("sameVisit") or ((demographics or {}).get("age") or {}).get("at") == "index":
        steps = [("all persons", {})]
        for k, c in enumerate(keep):
            steps.append((f"+ {label(c)}", {"inclusion": inclusion | {"criteria": keep[: k + 1], "groups": []}, "demographics": demographics}))
        for k, c in enumerate(drop):
            steps.append((f"- {label(c)}", {"inclusion": inclusion, "demographics": demographics, "exclusion": exclusion | {"criteria": drop[: k + 1]}}))
        rows = [cohort_count(cdm, c).select(F.lit(n).alias("step"), F.lit(text).alias("label"), "n_persons") for n, (text, c) in enumerate(steps)]
        return reduce(DataFrame.unionByName, rows)

    # a person meets each criterion or not: every criterion is looked up once, and the steps are counts over the flags
    builder = CohortBuilder(cdm, criteria)
    order = sorted(range(len(keep)), key=lambda k: keep[k].get("id") != builder.initial) if builder.initial else range(len(keep))
    found = [("all", cdm.table("person").select("person_id"))]
    found += [(f"in{k}", builder.criterion(keep[k], False).select("person_id")) for k in order]
    found += [("who", builder.demographics(demographics))] if demographics else []
    found += [(f"out{k}", builder.criterion(c, False).select("person_id")) for k, c in enumerate(drop)]
    flagged = reduce(DataFrame.unionByName, [df.select("person_id", F.lit(name).alias("flag")) for name, df in found])
    people = flagged.groupBy("person_id").agg(*(F.max((F.col("flag") == name).cast("int")).cast("boolean").alias(name) for name, _ in found))

    def met(group: dict, some: list[dict], kind: str):
        """Neighbours linked by OR, all runs of them together; None without criteria."""
        default, runs, linked = group.get("operator", "AND"), [], False
        for k, c in enumerate(some):
            flag = F.col(f"{kind}{k}")
            runs = [*runs[:-1], runs[-1] | flag] if linked else [*runs, flag]
            linked = (c.get("operatorWithNext") or default) == "OR"
        return reduce(lambda x, y: x & y, runs) if runs else None

    who = F.col("who") if demographics else F.lit(True)
    steps = [("all persons", F.col("all"))]
    steps += [(f"+ {label(c)}", met(inclusion, keep[: k + 1], "in") & who) for k, c in enumerate(keep)]
    base = met(inclusion, keep, "in")
    base = (F.col("all") if base is None else base) & who
    steps += [(f"- {label(c)}", base & ~met(exclusion, drop[: k + 1], "out")) for k, c in enumerate(drop)]
    counts = people.agg(*(F.count(F.when(rule, 1)).alias(f"n{n}") for n, (_, rule) in enumerate(steps)))
    table = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(text).alias("label"), F.col(f"n{n}").alias("n_persons")) for n, (text, _) in enumerate(steps)))
    return counts.select(F.explode(table).alias("__row")).select("__row.*")


def _plain(criteria: dict) -> bool:
    """One inclusion criterion is all there is, and each of its events makes its person a member."""
    inclusion = criteria.get("inclusion") or {}
    some = inclusion.get("criteria", [])
    if len(some) != 1 or inclusion.get("groups") or (criteria.get("exclusion") or {}).get("criteria") or (criteria.get("exclusion") or {}).get("groups") or criteria.get("demographics"):
        return False
    kind, when = (some[0].get("occurrence") or {}).get("type"), (some[0].get("temporal") or {}).get("type")
    return kind in (None, "any") and when in (None, "absolute_window")


def dated_cohort(cdm: Cdm, criteria: dict, domain: str, start_from: str = "any_domain_event") -> DataFrame:
    """(person_id, cohort_start_date, cohort_end_date) under the document's exit rule.

    The start is the person's first event of the domain; with start_from="matching", of the first criterion alone.
    """
    events = cdm.events(domain) if start_from == "any_domain_event" else concept_events(cdm, criteria["inclusion"]["criteria"][0])
    if start_from == "any_domain_event" or not _plain(criteria):
        events = events.join(build_cohort(cdm, criteria).select("person_id").distinct(), "person_id", "left_semi")
    start = events.groupBy("person_id").agg(F.min("event_date").alias("cohort_start_date"))
    period = cdm.table("observation_period")
    rule = criteria.get("exit_criteria") or {}
    last = F.col("observation_period_end_date")
    rows = start.join(period, "person_id")
    if rule.get("type") == "fixed_duration":
        last = F.least(last, F.date_add("cohort_start_date", int(rule.get("duration_days", 365))))
    elif rule.get("type") == "event_based" and rule.get("exit_event"):
        leaving = build_cohort(cdm, {"inclusion": rule["exit_event"]}).select("person_id").distinct()
        exits = cdm.events(rule["exit_event"]["criteria"][0]["domain"]).join(leaving, "person_id", "left_semi").groupBy("person_id").agg(F.min("event_date").alias("exit_date"))
        rows = rows.where(F.col("cohort_start_date").between(F.col("observation_period_start_date"), F.col("observation_period_end_date"))).join(exits, "person_id", "left")
        last = F.coalesce(F.when(F.col("exit_date") > F.col("cohort_start_date"), F.col("exit_date")), last)
    return rows.select("person_id", "cohort_start_date", last.alias("cohort_end_date"))


def latest_period(cdm: Cdm) -> DataFrame:
    """The last observation period of each person."""
    last = Window.partitionBy("person_id").orderBy(F.desc("observation_period_start_date"), F.desc("observation_period_end_date"))
    return cdm.table("observation_period").withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def cohort_export(cdm: Cdm, criteria: dict) -> DataFrame:
    """Cohort members with labels and their last observation period."""
    label = lambda kind, key: cdm.table("concept").where(F.col("domain_id") == kind).select(F.col("concept_id").alias(key), F.col("concept_name").alias(kind.lower()))
    people = build_cohort(cdm, criteria).select("person_id").distinct().join(cdm.table("person"), "person_id")
    people = people.join(label("Gender", "gender_concept_id"), "gender_concept_id", "left").join(label("Race", "race_concept_id"), "race_concept_id", "left").join(latest_period(cdm), "person_id", "left")
    return people.select("person_id", "year_of_birth", F.coalesce("gender", F.lit("Unknown")).alias("gender"), F.coalesce("race", F.lit("Unknown")).alias("race"), "observation_period_start_date", "observation_period_end_date")


def cohort_sample(cdm: Cdm, criteria: dict, n: int = 10, seed: int = 7) -> DataFrame:
    return cohort_export(cdm, criteria).orderBy(F.rand(seed)).limit(n)


def patient_journey(cdm: Cdm, person_id: int, each: int = 500) -> DataFrame:
    """A person's events of all domains, at most `each` of a domain, in time; undated ones last."""
    names = cdm.table("concept").select("concept_id", "concept_name")
    parts = []
    for domain in cdm.domains():
        rows = cdm.events(domain).where(F.col("person_id") == person_id)
        order = Window.partitionBy("person_id").orderBy(F.asc_nulls_last("event_date"), "concept_id", "event_end_date", "value_as_number")
        parts.append(rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select(F.lit(domain).alias("domain"), "concept_id", "event_date", "event_end_date", "source_value", "value_as_number"))
    rows = reduce(DataFrame.unionByName, parts).join(names, "concept_id", "left")
    return rows.select("domain", "concept_id", F.coalesce("concept_name", F.lit("Unknown")).alias("concept_name"), "event_date", "event_end_date", "source_value", "value_as_number").orderBy(F.asc_nulls_last("event_date"), "domain", "concept_id")


def extract_table(cdm: Cdm, cohort: DataFrame, table: str, columns: list[str], same_visit: bool = False) -> DataFrame:
    """The wanted columns of a table's rows that belong to a cohort, by person or by person and visit."""
    keys = ["person_id", "visit_occurrence_id"] if same_visit and "visit_occurrence_id" in cohort.columns else ["person_id"]
    return cdm.table(table).join(cohort.select(*keys).distinct(), keys, "left_semi").select(*columns)


def criteria_diff(spark, a: dict, b: dict) -> DataFrame:
    """(section, criterion, change) between two criteria documents."""
    rows = []
    for section in ("inclusion", "exclusion"):
        one, two = ({c.get("id"): c for c in (x.get(section) or {}).get("criteria", [])} for x in (a, b))
        rows += [(section, k, "added") for k in two if k not in one] + [(section, k, "removed") for k in one if k not in two] + [(section, k, "modified") for k in one if k in two and one[k] != two[k]]
        if bool((a.get(section) or {}).get("sameVisit")) != bool((b.get(section) or {}).get("sameVisit")):
            rows.append((section, "sameVisit", "modified"))
    if (a.get("demographics") or {}) != (b.get("demographics") or {}):
        rows.append(("demographics", "demographics", "modified"))
    return spark.createDataFrame(rows, "section string, criterion string, change string")
