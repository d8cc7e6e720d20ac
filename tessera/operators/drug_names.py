"""Drug names as hospitals write them, "MOLECULE DOSE FORM (BRAND)", and the concepts that they may mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import folded
from tessera.sources.cdm import Cdm
from tessera.sources.scratch import written

# fixed values: galenic forms in names, and what concept names call them
FORMS = (
    "CPR|COMP|GEL|GELULE|CAPS|INJ|AMP|SACHET|SOL|SUSP|SIROP|SIR|POM|CREME|CR|SUPPO|PATCH|COLLYRE|SPRAY|PDR|POUDRE|GRAN|"
    "FL|FLACON|BUV|BUVABL|IV|IM|SC|PO|LP|LM|EFF|SEC|ORAL|ENROB|PERF|SERINGUE|STYLO|SAF|VERSABLE|IRRIGATION"
)
FORM_WORDS = {
    "CPR": ["Oral Tablet"], "COMP": ["Oral Tablet"], "ENROB": ["Oral Tablet"], "EFF": ["Effervescent Tablet"],
    "GEL": ["Oral Capsule"], "GELULE": ["Oral Capsule"], "CAPS": ["Oral Capsule"], "LP": ["Extended Release"],
    "SIROP": ["Oral Solution"], "SIR": ["Oral Solution"], "BUV": ["Oral Solution"], "BUVABL": ["Oral Solution"],
    "SACHET": ["Oral Powder", "Oral Granules"], "INJ": ["Injectable", "Injection"], "AMP": ["Injectable", "Injection"],
    "PERF": ["Injection", "Intravenous"], "SERINGUE": ["Prefilled Syringe", "Injectable"], "STYLO": ["Pen Injector", "Injectable"],
    "IV": ["Intravenous", "Injection"], "IM": ["Injection", "Injectable"], "SC": ["Injection", "Injectable"], "SAF": ["Injection", "Injectable"],
    "POM": ["Topical", "Ointment"], "CREME": ["Topical", "Cream"], "CR": ["Topical", "Cream"], "PATCH": ["Transdermal"],
    "COLLYRE": ["Ophthalmic"], "SPRAY": ["Nasal Spray", "Metered Dose Inhaler"], "SUPPO": ["Rectal Suppository"],
    "PDR": ["Powder"], "POUDRE": ["Powder"],
}
INJECTED = ["Injectable", "Injection", "Intravenous", "Prefilled Syringe", "Pen Injector"]
UNITS = "MG/ML|MG|G/L|G|ML|MCG|µG|UI/ML|UI|U/ML|%"
# fixed values: English names of French ones that don't follow the rule "-INE loses its E"
ENGLISH = {
    "IBUPROFENE": "IBUPROFEN", "PARACETAMOL": "ACETAMINOPHEN", "DOXYCYCLINE": "DOXYCYCLINE", "RIFAMPICINE": "RIFAMPIN",
    "AMLODIPINE": "AMLODIPINE", "FLUOXETINE": "FLUOXETINE", "PAROXETINE": "PAROXETINE", "SERTRALINE": "SERTRALINE",
    "MORPHINE": "MORPHINE", "CODEINE": "CODEINE", "DOPAMINE": "DOPAMINE", "DOBUTAMINE": "DOBUTAMINE",
    "NORADRENALINE": "NOREPINEPHRINE", "ADRENALINE": "EPINEPHRINE", "ATROPINE": "ATROPINE", "KETAMINE": "KETAMINE",
    "LIDOCAINE": "LIDOCAINE", "BUPIVACAINE": "BUPIVACAINE", "SALBUTAMOL": "ALBUTEROL", "CETIRIZINE": "CETIRIZINE",
    "DESLORATADINE": "DESLORATADINE", "LORATADINE": "LORATADINE", "ACIDE ACETYLSALICYLIQUE": "ASPIRIN",
    "INSULINE ASPARTE": "INSULIN ASPART", "INSULINE GLARGINE": "INSULIN GLARGINE", "INSULINE LISPRO": "INSULIN LISPRO",
    "INSULINE DETEMIR": "INSULIN DETEMIR", "INSULINE DEGLUDEC": "INSULIN DEGLUDEC", "INSULINE HUMAINE": "INSULIN HUMAN",
    "COLCHICINE": "COLCHICINE", "LAMOTRIGINE": "LAMOTRIGINE", "CARBAMAZEPINE": "CARBAMAZEPINE", "CLOZAPINE": "CLOZAPINE",
    "OLANZAPINE": "OLANZAPINE", "QUETIAPINE": "QUETIAPINE", "CICLOSPORINE": "CYCLOSPORINE", "AZATHIOPRINE": "AZATHIOPRINE",
    "NICARDIPINE": "NICARDIPINE",
}
EACH = 5
NAME = ("ingredient", "dosage", "forms", "brand")
SEARCH = ("first", "second", "forms", "brand")


def parsed(name: Column) -> Column:
    """struct(ingredient, dosage, forms, brand) of a name, in upper case; forms are the words that concept names have for them.

    The ingredient is what stands before the dose, without forms and brand.  Dosage and brand are null where there is none;
    a null name has a null ingredient.
    """
    upper = F.upper(F.trim(name))
    bare = F.trim(F.regexp_replace(upper, r"\([^)]*\)", ""))
    brand = F.when(upper.rlike(r"\([^)]+\)"), F.trim(F.regexp_extract(upper, r"\(([^)]+)\)", 1)))
    words = F.create_map(*[F.lit(x) for code, say in FORM_WORDS.items() for x in (code, "|".join(say))])
    said = F.transform(F.regexp_extract_all(bare, F.lit(rf"(?U)\b({FORMS})\b"), F.lit(1)), lambda code: F.split(F.try_element_at(words, code), r"\|"))
    forms = F.array_distinct(F.flatten(F.filter(said, lambda x: x.isNotNull())))
    dose = rf"(?iuU)(\d+[.,]?\d*)\s*({UNITS})\b"
    dosage = F.when(bare.rlike(dose), F.concat(F.replace(F.regexp_extract(bare, dose, 1), F.lit(","), F.lit(".")), F.lit(" "), F.upper(F.regexp_extract(bare, dose, 2))))
    before = F.regexp_replace(F.split(bare, dose, 2)[0], rf"(?U)\b({FORMS})\b", "")
    ingredient = F.regexp_replace(F.trim(F.regexp_replace(before, r"\s+", " ")), "/+$", "")
    return F.struct(ingredient.alias("ingredient"), dosage.alias("dosage"), forms.alias("forms"), brand.alias("brand"))


def english(ingredient: Column) -> Column:
    """The English name of an ingredient: a known one, or without the E of -INE."""
    known = F.create_map(*[F.lit(x) for pair in ENGLISH.items() for x in pair])
    shorter = F.when(ingredient.endswith("INE") & (F.length(ingredient) > 5), F.substring(ingredient, F.lit(1), F.length(ingredient) - 1))
    return F.coalesce(F.try_element_at(known, ingredient), shorter, ingredient)


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text; none if it is shorter."""
    at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda k: F.substring(text, k, F.lit(3))))


def _holding(searches: DataFrame, texts: DataFrame) -> DataFrame:
    """searches (first, second or null) with the texts (text, ...) that have `first` in them and, behind it, `second`.

    A text that holds a word holds all its trigrams, so each word meets only the texts of its rarest one.
    """
    held = texts.withColumn("gram", F.explode(_grams(F.col("text"))))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    words = searches.select("first").distinct()
    rarest = words.withColumn("gram", F.explode(_grams(F.col("first")))).join(counts, "gram").groupBy("first").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = rarest.join(held, "gram").where(F.col("text").contains(F.col("first"))).drop("gram")
    at = F.expr("locate(first, text) + length(first)")
    return searches.join(found, "first").where(F.col("second").isNull() | (F.position(F.col("second"), F.col("text"), at) > 0))


def _same(columns: tuple[str, ...]) -> Column:
    """Rows meet where these columns and those with __ before the name are equal, nulls too."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])


def _first(rows: DataFrame, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """The best five rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= EACH)


def _best_by_name(tried: DataFrame, usable: DataFrame) -> DataFrame:
    """(first, second, forms, brand, concept_id, concept_name, place): the best five concepts of each distinct search.

    Concepts of one name and domain differ by their id alone, so the five smallest stand for all.  What a search finds depends on
    its words only, and names that share them differ by forms and brand: the five best with the brand and the five best
    whatever the brand are found apart, which hold the five best of both.  So no name meets all concepts that hold its words.
    """
    few = _first(usable, ("concept_name", "inside"), "concept_id").drop("place")
    texts = few.select("concept_name").distinct().withColumn("text", folded(F.col("concept_name")))
    searches = tried.select(*SEARCH).distinct()
    hits = _holding(searches.select("first", "second").distinct(), texts)
    hits = written(hits.join(few, "concept_name").select("first", "second", "text", "inside", "concept_id", "concept_name"))
    formed = F.exists("forms", lambda w: F.upper("concept_name").contains(F.upper(w))).alias("formed")
    order = (F.desc("formed"), F.length("concept_name"), "concept_id")

    def met(asked: DataFrame) -> DataFrame:
        return asked.join(hits.select(F.col("first").alias("__first"), F.col("second").alias("__second"), "text", "inside", "concept_id", "concept_name"), _same(SEARCH[:2])).drop("__first", "__second")

    any_brand = _first(met(searches.select("first", "second", "forms").distinct()).select("*", formed), ("first", "second", "forms", "inside"), *order)
    any_brand = any_brand.select(*[F.col(c).alias(f"__{c}") for c in SEARCH[:3]], "text", "inside", "concept_id", "concept_name", "formed")
    any_brand = searches.join(any_brand, _same(SEARCH[:3])).drop(*[f"__{c}" for c in SEARCH[:3]])
    brands = searches.where("brand is not null").select("brand").distinct()
    holds = folded(F.col("concept_name")).contains(folded(F.col("brand")))
    bought = _holding(brands.select("brand", folded(F.col("brand")).alias("first"), F.lit(None).cast("string").alias("second")).where("length(first) >= 3"), texts)
    # brands too short for a trigram are looked for in every text
    short = brands.where(F.length(folded(F.col("brand"))) < 3).join(texts, holds)
    bought = bought.select("brand", "concept_name").unionByName(short.select("brand", "concept_name"))
    own = hits.join(bought, "concept_name").select(F.col("first").alias("__first"), F.col("second").alias("__second"), F.col("brand").alias("__brand"), "text", "inside", "concept_id", "concept_name")
    own = searches.join(own, _same(("first", "second", "brand"))).drop("__first", "__second", "__brand").select("*", formed)
    own = _first(own, (*SEARCH, "inside"), *order)
    both = any_brand.unionByName(own.select(any_brand.columns)).withColumn("branded", F.coalesce(holds, F.lit(False))).dropDuplicates([*SEARCH, "concept_id", "concept_name", "inside"])
    return _first(both, SEARCH, F.desc("inside"), F.desc("branded"), *order).select(*SEARCH, "concept_id", "concept_name", "place")


def _best_by_synonym(tried: DataFrame, usable: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The same by synonyms, with null forms and brand, as neither counts; of concepts that share a synonym the best five stand for all."""
    order = (F.desc("inside"), F.length("concept_name"), "concept_id")
    named = synonyms.select("concept_id", folded(F.col("concept_synonym_name")).alias("text")).distinct().join(usable, "concept_id").dropDuplicates(["text", "concept_id"])
    few = written(_first(named, ("text",), *order).drop("place"))
    hits = _holding(tried.select("first", "second").distinct(), few.select("text").distinct()).join(few, "text")
    best = _first(hits.dropDuplicates(["first", "second", "concept_id"]), ("first", "second"), *order)
    return best.select("first", "second", F.lit(None).cast("array<string>").alias("forms"), F.lit(None).cast("string").alias("brand"), "concept_id", "concept_name", "place")


def suggest_by_name(cdm: Cdm, terms: DataFrame, domain: str) -> DataFrame:
    """(source_value, source_name, concept_id, concept_name, strategy, confidence): concepts for drug names.

    Searched in turn: English name and dose (not for injected forms), English name, the name as written and dose, the name as
    written, each giving its best five until five concepts are found; then synonyms, with the dose if there is one.  The best
    are of the domain, have the brand, have the form, are short; then by concept_id.  85 with the dose, else 78; 5 more for
    the brand and 5 for the form, 95 at most; synonyms 78.  Ingredients under three characters find nothing.  Letter case and
    accents don't count.  Each distinct name is searched once.  Repeated terms give repeated rows.
    """
    t = terms.select("source_value", "source_name", parsed(F.col("source_name")).alias("p")).select("source_value", "source_name", *[f"p.{c}" for c in NAME]).where("length(ingredient) >= 3")
    names = written(t.select(*NAME).distinct()).withColumn("en", english(F.col("ingredient")))
    injected = F.arrays_overlap("forms", F.array(*map(F.lit, INJECTED)))
    dosed = F.when(~F.coalesce(injected, F.lit(False)), F.col("dosage"))
    tries = F.array(
        F.struct(F.lit(0).alias("turn"), F.when(dosed.isNotNull(), F.col("en")).alias("first"), dosed.alias("second")),
        F.struct(F.lit(1).alias("turn"), F.col("en").alias("first"), F.lit(None).cast("string").alias("second")),
        F.struct(F.lit(2).alias("turn"), F.when((F.col("en") != F.col("ingredient")) & dosed.isNotNull(), F.col("ingredient")).alias("first"), dosed.alias("second")),
        F.struct(F.lit(3).alias("turn"), F.when(F.col("en") != F.col("ingredient"), F.col("ingredient")).alias("first"), F.lit(None).cast("string").alias("second")),
        F.struct(F.lit(4).alias("turn"), F.col("ingredient").alias("first"), F.col("dosage").alias("second")),
    )
    tried = names.withColumn("try", F.explode(tries)).select(*NAME, "try.turn", folded(F.col("try.first")).alias("first"), folded(F.col("try.second")).alias("second")).where("first is not null")
    tried = written(tried)
    usable = cdm.table("concept").where("standard_concept = 'S' and invalid_reason is null").select("concept_id", "concept_name", F.coalesce(F.col("domain_id") == domain, F.lit(False)).alias("inside"))
    rank = _best_by_name(tried.where("turn < 4"), usable).unionByName(_best_by_synonym(tried.where("turn = 4"), usable, cdm.table("concept_synonym")))
    rank = rank.select(*[F.col(c).alias(f"__{c}") for c in SEARCH], "concept_id", "concept_name", "place")
    by_name = tried.where("turn < 4").join(rank.where("__forms is not null"), _same(SEARCH))
    by_synonym = tried.where("turn = 4").join(rank.where("__forms is null"), _same(SEARCH[:2]))
    rows = by_name.unionByName(by_synonym).select(*NAME, "turn", "second", "concept_id", "concept_name")
    searched = F.col("turn") < 4
    upper = F.upper("concept_name")
    formed = searched & F.exists("forms", lambda w: upper.contains(F.upper(w)))
    bonus = F.when(searched & F.coalesce(upper.contains(F.col("brand")), F.lit(False)), 5).otherwise(0) + F.when(formed, 5).otherwise(0)
    base = F.when(searched & F.col("second").isNotNull(), 85).otherwise(78)
    rows = rows.withColumn("confidence", F.least(F.lit(95), base + bonus))
    # a turn is taken while those before it gave fewer than five concepts
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy(*NAME, "concept_id").orderBy("turn"))).where("again = 1")
    had = F.count("*").over(Window.partitionBy(*NAME).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("had", had).where(F.col("had") < EACH)
    found = rows.select(*[F.col(c).alias(f"__{c}") for c in NAME], F.col("concept_id").cast("long").alias("concept_id"), "concept_name", F.when(searched, "ingredient").otherwise("synonym").alias("strategy"), "confidence")
    return t.join(found, _same(NAME)).select("source_value", "source_name", "concept_id", "concept_name", "strategy", "confidence")
