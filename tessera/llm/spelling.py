"""Spelling variants: words one edit apart, found by letter-parity bitmask bands.

1. A word's mask has a bit for each letter (BANDS x WIDTH bits, letters dealt over the bands in turn), set if the word has the
   letter an odd number of times.  An edit flips two bits at most, so of three bands one stays equal.
2. An edit also leaves one half of a word as it is: with l the length of the shorter of two words, either their first l // 2
   code points are equal or their last l - l // 2 are.  Rows of both joins are therefore keyed by l, a half and a band; a
   word is in the join as the shorter one (l = its length) and as the longer one (l = its length less 1), which is the
   length filter.  A key holds few words, as they share half their letters and a third of the mask.
3. A pair is taken at its first common key only, and verified: at most two bits differ, and the edit distance is 1.
4. The form of a word is its near word of largest count, if that is at least twice the word's own.  Counts double at each
   step, so chains are short; roots are found by pointer jumping over written tables, 1 + log2(chain) joins.

All is DataFrame code; what is grouped or joined is words, never documents, so a frequent word is one row.

Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, with only A-Z lower-cased; of least_length code points at least
after thinning, and least_count occurrences in all.  Ties of forms go to the smallest word in code-point order.

Rows: null and empty texts have no words.  Rows that repeat a doc_id count each.  The runs of a row without doc_id are
counted, never thinned.  An empty table gives an empty result.  Columns other than the two named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, materialize

BANDS, WIDTH = 3, 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, thin: int = 0) -> DataFrame:
    """(word, n) of the words of docs.

    thin > 0 deletes one code point of some runs: with h the crc32 of "<doc_id>:<run>", where thin divides h, that at h % length.
    """
    docs = keyed(docs, id_col, text_col)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    runs = runs.where(F.char_length("word") >= least_length)
    if thin:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % thin == 0, shorter).otherwise(F.col("word"))).where(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A long with the parity of each letter's count."""

    def bit(c: Column) -> Column:
        code = F.ascii(c)
        letter = F.when(code < 128, code - ord("a")).otherwise(code - 0xC0 + 26)
        place = letter % BANDS * WIDTH + F.floor(letter / BANDS).cast("int") % WIDTH
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(bit(c)))


def _band(mask: Column, number) -> Column:
    return F.call_function("shiftright", mask, F.lit(WIDTH) * number).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(words: DataFrame, roles: tuple[int, ...]) -> DataFrame:
    """A row for each role (0 the shorter word, 1 the longer), half and band of words (word, n, mask)."""
    numbers = [(role, half, band) for role in roles for half in (0, 1) for band in range(BANDS)]
    rows = words.select("word", "n", "mask", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(h).alias("half"), F.lit(b).alias("band")) for r, h, b in numbers])).alias("k"))
    size = F.char_length("word") - F.col("k.role")
    first = F.floor(size / 2).cast("int")
    part = F.when(F.col("k.half") == 0, F.left("word", first)).otherwise(F.right("word", size - first))
    return rows.select("word", "n", "mask", F.xxhash64(size, part, _band(F.col("mask"), F.col("k.band"))).alias("key"), (F.col("k.half") * BANDS + F.col("k.band")).alias("number"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of the words (word, n) that are one edit apart, each pair once, a not the longer one."""
    words = words.withColumn("mask", parity_mask(F.col("word")))
    a = _keys(words, (0,)).toDF("a", "a_n", "a_mask", "key", "number")
    b = _keys(words, (0, 1)).toDF("b", "b_n", "b_mask", "key", "number")
    la, lb = F.char_length("a"), F.char_length("b")
    differ = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    once = ((lb == la) & (F.col("a") < F.col("b"))) | (lb == la + 1)
    pairs = a.join(b, ["key", "number"]).where(once & (F.bit_count(differ) <= 2))
    half = F.floor(la / 2).cast("int")
    heads, tails = F.left("a", half) == F.left("b", half), F.right("a", la - half) == F.right("b", la - half)
    band, second = F.col("number") % BANDS, F.col("number") >= BANDS
    # met at this key, and at none before it
    here = (_band(differ, band) == 0) & F.when(second, tails & ~heads).otherwise(heads)
    before = reduce(lambda x, y: x & y, [(band <= i) | (_band(differ, F.lit(i)) != 0) for i in range(BANDS - 1)])
    return pairs.where(here & before & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): what following the forms ends at.  Links have one row a word and no cycle."""
    links = materialize(links.toDF("word", "up"))
    while True:
        above = links.toDF("up", "next")
        jumped = materialize(links.join(above, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        links = jumped.select("word", "up")
        if not jumped.where("moved").limit(1).count():
            return links.toDF("word", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of words (word, n), which has a row a word."""
    words = materialize(words.select("word", "n"))
    pair = near_pairs(words)
    sides = pair.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")).select("x.*")
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    near = materialize(best.select("word", "n_near", chosen.alias("x")).select("word", "n_near", "x.form", "x.form_n"))
    root = roots(near.where("form is not null").select("word", "form"))
    found = words.join(near, "word", "left").join(root, "word", "left")
    return found.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, thin: int = 0) -> DataFrame:
    """spelling_groups() of the words of docs."""
    return spelling_groups(word_counts(docs, id_col, text_col, least_length, least_count, thin))
