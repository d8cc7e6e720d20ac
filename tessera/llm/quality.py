"""Quality rules: surface counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed to BUCKETS buckets.  One pass counts the buckets over all documents (the raw
corpus) and over the documents whose label marks them as trusted (the target); both are multinomials, smoothed by
SMOOTHING raw n-grams in each bucket and the target's share of as many, so that a bucket seen seldom says little.  A
document's score is the mean over its n-grams of log(target / raw), so it doesn't depend on length.  Every document
with a score under THRESHOLD is rejected; there is no randomness.

Only DataFrame functions are used.  The table of weights always has BUCKETS entries, whatever the corpus, so it is
bound to be small and is broadcast.

Rows: null and empty texts have no words and fail the base rules.  A document without n-grams has a null score.  Labels
with null ids or values mark nothing; a document is trusted if any of its labels says so.  If nothing is trusted, all
weights are zero and only the base rules reject.  Repeated rows are judged each.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, materialize, small, without

BUCKETS = 1 << 18
SMOOTHING = 32.0
THRESHOLD = -0.15
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(x) with value evaluated once, also where x stands inside a lambda."""
    return F.transform(F.array(value), body)[0]


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words and the hash of each word to (doc_id, text)."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def ngram_buckets() -> Column:
    """The buckets of all words and pairs of neighbours, from the column hashes."""
    h, n = F.col("hashes"), F.size("hashes")
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.when(n > 1, F.concat(one, pairs)).otherwise(one)


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows whose hash occurs more than once; windows holds the hash at each start."""

    def count(ordered: Column) -> Column:
        same = lambda x, k: (k > 0) & (F.get(ordered, k - 1)["h"] == x["h"]) | (k + 1 < F.size(ordered)) & (F.get(ordered, k + 1)["h"] == x["h"])
        places = F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["k"]))
        step = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
        return let(places, lambda p: F.when(F.size(p) > 1, step(p) + WINDOW).otherwise(F.lit(0)))

    tagged = F.array_sort(F.transform(windows, lambda h, k: F.named_struct(F.lit("h"), h, F.lit("k"), k)))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(tagged, count)).otherwise(F.lit(0))


def corpus_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight) for every bucket, from the counts over all of docs and over its trusted part."""
    trusted = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("trusted")).distinct())
    words = with_words(keyed(docs, id_col, text_col).join(small(trusted, 24), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(0)).alias("trusted")))
    counts = words.select("trusted", F.explode(ngram_buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    counts = materialize(counts)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    rho = total["target"] / total["raw"] if total["raw"] else 0.0
    weight = F.log((F.col("target") + smoothing * rho) / ((F.col("raw") + smoothing) * rho)) if rho else F.lit(0.0)
    return materialize(every.select("bucket", weight.alias("weight")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    word_chars counts code points in words, n_symbols the characters #*$%&|<>, n_dup_lines the lines with a word that
    equal an earlier line, n_repeat_words the words in 8-word windows that occur twice or more (the first included;
    windows are compared by a 64-bit hash).
    """
    weights = corpus_weights(docs, labels, id_col, text_col)
    words = with_words(keyed(docs, id_col, text_col))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda k: F.xxhash64(*(F.get(F.col("hashes"), k + i) for i in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        ngram_buckets().alias("grams"),
    )
    rows = grams.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("row"),
        "grams",
    )
    # the n-grams of a row are in one task, so all but one partial sum for each document is made before the shuffle
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "row"]
    rows = rows.select(*own, F.explode_outer("grams").alias("bucket"))
    rows = rows.join(F.broadcast(weights), "bucket", "left").groupBy(*own).agg((F.sum("weight") / F.count("weight")).alias("score")).drop("row")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that the rules keep; a rejected row takes rows that repeat its doc_id along.

    A row without doc_id can't be named and stays.
    """
    return without(docs, quality_scores(docs, labels, id_col, text_col).where(~F.col("kept")).select("doc_id"), id_col)
