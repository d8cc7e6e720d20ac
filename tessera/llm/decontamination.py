"""Benchmark decontamination with SimHash windows.

Every benchmark item is compared with the item-sized windows of every document.

1. A join on shingle hashes marks the shingles of a document that items have.  A window that is similar enough to an item of n words holds at least 2 s / (1 + s) of its shingles from items of that
   size (s the similarity), so only the starts of such windows go on; no window that could pass is left out.
2. Each such window gets a 64-bit SimHash of its words.  Fingerprints are cut into BLOCKS blocks, so two within RADIUS
   bits are within RADIUS // BLOCKS bits in one block at least.  An item is indexed under all blocks so near to its own;
   a join on (size, block number, block) finds every window within RADIUS of it.
3. Candidates are verified by the exact similarity of their weighted shingle sets, a shingle's weight being how often it
   occurs: the sum of the least weights over the sum of the largest.

Words are lower-cased (A-Z).  An item with fewer words than a shingle has its whole word sequence as the one shingle.

Only DataFrame functions are used.  Rows: null and empty texts have no windows; null and empty items match nothing.
Rows that repeat a doc_id are searched each, and the pairs of both are merged; rows without doc_id are never reported.
Items that repeat an id or a text are all reported.  Empty tables give an empty result.  Of several windows with one
item the most similar is reported, then the first.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, keyed, materialize, small, without
from tessera.llm.quality import let

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 16, 6
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """The hash of each lower-cased word."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.translate(w, _UPPER, _LOWER)))


def shingle_hashes(words: Column, size: int) -> Column:
    """The hash of every run of `size` word hashes."""
    n = F.size(words)
    some = F.transform(F.sequence(F.lit(0), n - size), lambda k: F.xxhash64(*(F.get(words, k + i) for i in range(size))))
    return F.when(n >= size, some).otherwise(F.array().cast("array<bigint>"))


def counted(shingles: Column) -> Column:
    """Each shingle with the number of equal ones before it, as one hash: a set whose overlaps are those of the weights."""
    return let(F.sort_array(shingles), lambda s: F.transform(s, lambda x, k: F.xxhash64(x, k - F.array_position(s, x))))


def simhash(words: Column) -> Column:
    """Bit b is set if more words have it set in their hash than not."""
    bit = lambda b: F.aggregate(words, F.lit(0), lambda acc, h: acc + F.when(h.bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0, 1).otherwise(-1)) > 0
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(bit(b), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _edges() -> list[tuple[int, int]]:
    return [(64 * k // BLOCKS, 64 * (k + 1) // BLOCKS) for k in range(BLOCKS)]


def blocks(fingerprint: Column) -> Column:
    """The BLOCKS pieces of a fingerprint, with their numbers."""
    piece = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(F.struct(F.lit(k).alias("number"), piece(a, b).alias("bits")) for k, (a, b) in enumerate(_edges())))


def near_blocks(fingerprint: Column) -> Column:
    """Every block within RADIUS // BLOCKS bits of a piece of a fingerprint, with the number of the piece."""
    flips = lambda width: [sum(1 << x for x in some) for n in range(RADIUS // BLOCKS + 1) for some in combinations(range(width), n)]
    near = lambda k, masks: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.lit(k).alias("number"), F.get(blocks(fingerprint), F.lit(k))["bits"].bitwiseXOR(m.cast("long")).alias("bits")))
    return F.concat(*(near(k, flips(b - a)) for k, (a, b) in enumerate(_edges())))


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, n, size, shingles, weighted, fingerprint) of each item with words; materialized."""
    items = keyed(benchmark, "item_id", "text").select(F.col("doc_id").alias("item_id"), word_hashes(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("size", F.least(F.lit(shingle), F.col("n")))
    own = F.when(F.col("n") >= shingle, shingle_hashes(F.col("words"), shingle))
    for k in range(1, shingle):
        own = own.when(F.col("n") == k, shingle_hashes(F.col("words"), k))
    items = materialize(items.withColumn("shingles", own))
    return materialize(items.select("item_id", "n", "size", "shingles", counted(F.col("shingles")).alias("weighted"), simhash(F.col("words")).alias("fingerprint")))


def _needed(n: Column, total: Column, size: int) -> Column:
    """How many shingles of a window, the whole of a document of fewer than n words, must be from items."""
    both = (n - size + 1) + (F.least(n, total) - size + 1)
    return F.greatest(F.lit(1), F.ceil(both * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int"))


def _starts(places: Column, n: Column, needed: Column, total: Column, size: int) -> Column:
    """Starts of the n-word windows that hold enough of the sorted places (all windows of a document of `total` words)."""
    last = F.greatest(F.lit(0), total - n)

    def around(k: Column) -> Column:
        first, final = F.get(places, k), F.get(places, k + needed - 1)
        lo = F.greatest(F.lit(0), final - (n - size))
        return F.when(lo <= first, F.sequence(F.least(lo, last), F.least(first, last))).otherwise(F.array().cast("array<int>"))

    some = F.transform(F.sequence(F.lit(0), F.size(places) - needed), around)
    return F.when(F.size(places) >= needed, F.array_distinct(F.flatten(some))).otherwise(F.array().cast("array<int>"))


def marked_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n, size, total, places): where a document of `total` words has shingles of items of n words.

    The items' shingles are broadcast while their counted size allows it; else both sides are shuffled by shingle.
    """
    keys = materialize(items.select(F.explode("shingles").alias("h"), "n", "size").distinct())
    words = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("words"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most SHINGLE values
    found = None
    for size in sizes:
        own = words.select("doc_id", F.size("words").alias("total"), F.posexplode(shingle_hashes(F.col("words"), size)).alias("place", "h"))
        own = own.join(small(keys.where(F.col("size") == size).select("h", "n"), 32), "h").select("doc_id", "n", F.lit(size).alias("size"), "total", "place")
        found = own if found is None else found.unionByName(own)
    # a group holds at most the places of one document
    return found.groupBy("doc_id", "n", "size").agg(F.max("total").alias("total"), F.sort_array(F.collect_set("place")).alias("places"))


def _measured(at: DataFrame) -> DataFrame:
    """at, a materialized (doc_id, at), with a broadcast hint if the starts that it holds, all counted, allow it."""
    held = F.aggregate("at", F.lit(0).cast("long"), lambda acc, x: acc + 64 + 4 * F.size(x["starts"]).cast("long"))
    rows, total = at.agg(F.count("*"), F.sum(held)).first()
    return F.broadcast(at) if 64 * rows + (total or 0) <= BROADCAST_BYTES else at


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) for each document and item that it contains; materialized.

    start is the first word of the most similar window, n_words the number of words of the item.
    """
    docs = keyed(docs, id_col, text_col)
    items = benchmark_items(benchmark)
    if not items.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, similarity double")
    places = materialize(marked_places(docs, items))
    starts = F.array().cast("array<int>")
    for size in range(1, SHINGLE + 1):
        n = F.col("n")
        starts = F.when(F.col("size") == size, _starts(F.col("places"), n, _needed(n, F.col("total"), size), F.col("total"), size)).otherwise(starts)
    at = places.select("doc_id", F.struct("n", "size", starts.alias("starts")).alias("x")).where(F.size("x.starts") > 0).groupBy("doc_id").agg(F.collect_list("x").alias("at"))
    at = materialize(at)
    here = docs.join(_measured(at), "doc_id").select("doc_id", word_hashes(F.col("text")).alias("words"), F.explode("at").alias("x"))
    here = here.select("doc_id", "words", "x.n", "x.size", F.explode("x.starts").alias("start")).select("doc_id", "n", "size", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("words"))
    shingles = F.array().cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        shingles = F.when(F.col("size") == size, shingle_hashes(F.col("words"), size)).otherwise(shingles)
    here = here.withColumn("shingles", shingles)
    windows = materialize(here.select("doc_id", "n", "start", counted(F.col("shingles")).alias("weighted"), simhash(F.col("words")).alias("fingerprint")))

    split = lambda df, own, how: df.select(*own, "n", "fingerprint", F.explode(how(F.col("fingerprint"))).alias("b")).select(*own, "n", "fingerprint", "b.number", "b.bits")
    w, i = split(windows, ["doc_id", "start"], blocks).alias("w"), split(items, ["item_id"], near_blocks).alias("i")
    near = F.bit_count(F.col("w.fingerprint").bitwiseXOR(F.col("i.fingerprint"))) <= RADIUS
    pairs = w.join(i, (F.col("w.n") == F.col("i.n")) & (F.col("w.number") == F.col("i.number")) & (F.col("w.bits") == F.col("i.bits")) & near).select("doc_id", "start", F.col("w.n").alias("n"), "item_id").distinct()
    pairs = materialize(pairs)
    both = pairs.join(windows.select("doc_id", "n", "start", "weighted"), ["doc_id", "n", "start"]).join(items.select("item_id", "n", F.col("weighted").alias("own")), ["item_id", "n"])
    shared = F.size(F.array_intersect("weighted", "own"))
    both = both.select("doc_id", "item_id", "start", "n", shared.alias("shared"), (F.size("weighted") + F.size("own") - shared).alias("total"))
    passed = both.where(F.col("shared") >= SIMILARITY * F.col("total") - 1e-9).withColumn("similarity", F.col("shared") / F.col("total"))
    best = F.max_by(F.struct("start", "n"), F.struct("similarity", -F.col("start")))
    return materialize(passed.groupBy("doc_id", "item_id").agg(best.alias("x"), F.max("similarity").alias("similarity")).select("doc_id", "item_id", "x.start", F.col("x.n").alias("n_words"), "similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that contain no benchmark item."""
    return without(docs, contaminated(docs, benchmark, id_col, text_col).select("doc_id"), id_col)
