"""MinHash near-dedup with odd sketches.

1. Each document's set of word shingles gives SAMPLES MinHash values.  BANDS bands of four values each name the
   buckets in which candidates meet; the same samples, folded into a parity bitmap (an odd sketch), estimate a pair's
   similarity from the population count of the XOR of two bitmaps.
2. Documents with equal sets form a class at once; only its smallest id goes on.
3. Links are sought without listing all pairs of a bucket: in each round every bucket names one pivot for the members
   that are not yet in its component, the sketch discards hopeless pairs, and the full sets decide.
4. What is left then, pairs of one bucket in different components, is joined without any cap, under the sketch and
   two exact bounds, on set sizes and on the shingles that a document shares with other components at all, and under
   sketches of more samples; then full sets decide.  So a pair of linked documents is missed only if all bands
   miss it (under 1e-7 at similarity 0.8) or the sketch is off by more than five standard deviations.

Rows: null or empty texts have no shingles and link with nothing.  A text of fewer words than a shingle has its whole
word sequence as the one shingle.  Rows that repeat a doc_id count as copies of one document.  A row without doc_id is
kept and has no component.  Ties go to the smallest doc_id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import COEF, LOWER, chunks, keyed, materialize, mix, ragged, range_hashes, small, without, words
from tessera.llm.components import connected_components

SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SKETCH_BITS = 512
SKETCH_FLOOR = 0.56
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 512, 2048, 0.7
ROUNDS = 2

_rng = np.random.default_rng(77)
_MUL = (_rng.integers(1, 1 << 32, FINE_SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(1, 1 << 63, FINE_SAMPLES, dtype=np.uint64)


def popcount_bound(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """The XOR population count that two sketches of this similarity have on average."""
    differing = 2 * samples * (1 - similarity)
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** differing))


def minhashes(sets: np.ndarray, at: np.ndarray, samples: int):
    """Each sample's least value of every set, and the sketch bit it toggles; at are the sets' first places."""
    low = (mix(sets) >> np.uint64(32)).astype(np.uint32)
    values = np.empty_like(low)
    for i in range(samples):
        np.multiply(low, _MUL[i], out=values)
        values += _ADD[i]
        sample = np.minimum.reduceat(values, at).astype(np.uint64)
        yield i, sample, mix(sample ^ _SALT[i])


def fine_sketches(size: int):
    """A mapInArrow function from (rep, component, text) to (rep, fine): an odd sketch of more samples."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                sets, doc = shingles(data, offsets, size)
                rows, at = np.unique(doc, return_index=True)
                bits = np.zeros((len(rows), FINE_BITS), bool)
                if len(rows):
                    for _, _, place in minhashes(sets, at, FINE_SAMPLES):
                        bits[np.arange(len(rows)), (place % np.uint64(FINE_BITS)).astype(np.int64)] ^= True
                flat = np.packbits(bits, axis=1).view(np.int64).ravel() if len(rows) else np.zeros(0, np.int64)
                edges = np.arange(len(rows) + 1, dtype=np.int32) * (FINE_BITS // 64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + lo)), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["rep", "fine"])

    return run


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (64 bits) of lower-cased documents, in document order, and each one's document."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = range_hashes(data, starts, ends)
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    at, n = ragged(first[:-1], full), len(hashes)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += hashes[at + k] * COEF[k]
    doc = np.repeat(np.arange(len(counts)), full)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra += np.where(has, hashes[np.minimum(first[short] + k, n - 1)], np.uint64(0)) * COEF[k]
        total = np.concatenate([total, extra + counts[short].astype(np.uint64) * COEF[60]])
        doc = np.concatenate([doc, short])
    total = mix(total)
    order = np.argsort(total)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # a chunk has under 65536 documents
    total, doc = total[order], doc[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[fresh], doc[fresh].astype(np.int64)


def signatures(size: int):
    """A mapInArrow function from (doc_id, text) to set size, set fingerprint, band keys and sketch."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                n = hi - lo
                sets, doc = shingles(data, offsets, size)
                count = np.bincount(doc, minlength=n)
                some = np.flatnonzero(count)
                bands = np.zeros((len(some), BANDS), np.uint64)
                bits = np.zeros((len(some), SKETCH_BITS), bool)
                prints = np.zeros((2, n), np.uint64)
                if len(some):
                    at = np.r_[0, np.cumsum(count[some])[:-1]]
                    for k in range(2):
                        prints[k, some] = np.add.reduceat(mix(sets ^ _SALT[k]), at)
                    row = np.arange(len(some))
                    for i, sample, place in minhashes(sets, at, SAMPLES):
                        bands[:, i // ROWS] += mix(sample + _SALT[i])
                        bits[row, (place % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= True
                    bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                sketch = np.packbits(bits, axis=1).view(np.int64) if len(some) else np.zeros((0, SKETCH_BITS // 64), np.int64)
                here = np.zeros(n, np.int64)
                here[some] = 1
                rows = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(here * width)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(count.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), rows(bands.ravel().view(np.int64), BANDS), rows(sketch.ravel(), SKETCH_BITS // 64)],
                    ["doc_id", "n_shingles", "p", "q", "bands", "sketch"],
                )

    return run


def shingle_sets(size: int):
    """A mapInArrow function from (rep, text) to (rep, shingles): the full set of each document, in order."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets, doc = shingles(data, offsets, size)
                edges = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=hi - lo), out=edges[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edges), pa.array(sets.astype(np.int64)))], ["rep", "shingles"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) that are linked by their full sets; pairs must be materialized.

    A document's set is made once, however many pairs it is in; the joins hold a row's two sets at a time.
    """
    ids = materialize(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    texts = docs.join(small(ids, 24), docs.doc_id == ids.rep, "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(texts.select("doc_id", "text").mapInArrow(shingle_sets(size), "rep long, shingles array<long>"))
    one, two = sets.toDF("a", "own"), sets.toDF("b", "other")
    shared = F.size(F.array_intersect("own", "other"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", shared.alias("n"), (F.size("own") + F.size("other")).alias("total"))
    return materialize(joined.where((den + num) * F.col("n") >= num * F.col("total")).select("a", "b"))


def shingle_rows(size: int):
    """A mapInArrow function from (rep, component, text) to a row for each distinct shingle."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                sets, doc = shingles(data, offsets, size)
                at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sets.astype(np.int64))], ["rep", "component", "h"])

    return run


def foreign_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(rep, foreign): how many shingles of a document some document of another component has; texts is (rep, component, text)."""
    rows = texts.mapInArrow(shingle_rows(size), "rep long, component long, h long")
    spread = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    return rows.join(spread, "h", "left_semi").groupBy("rep").agg(F.count("*").alias("foreign"))


def _differing(column: str, bits: int):
    """The XOR population count of the sketches of rows x and y."""
    return reduce(add, (F.bit_count(F.col(f"x.{column}")[i].bitwiseXOR(F.col(f"y.{column}")[i])) for i in range(bits // 64)))


def _close(one: str, two: str, num: int, den: int):
    """Whether two rows with set sizes and sketches may be linked: exact bound on the sizes, then the sketches."""
    apart = _differing("sketch", SKETCH_BITS)
    sizes = F.least(f"{one}.n_shingles", f"{two}.n_shingles") * den >= F.greatest(f"{one}.n_shingles", f"{two}.n_shingles") * num
    return apart, sizes & (apart <= popcount_bound(SKETCH_FLOOR))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) for every row of docs.

    Documents are linked if den * |intersection| >= num * |union| of their sets of `size`-word shingles, lower-cased
    (A-Z).  component_id is the smallest doc_id reachable by links, kept marks the document of that id.  n_links
    counts the links that were verified between different sets; links within a component that other links make
    needless are not all sought.
    """
    docs = keyed(docs, id_col, text_col)
    signed = materialize(docs.mapInArrow(signatures(size), "doc_id long, n_shingles long, p long, q long, bands array<long>, sketch array<long>"))
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("p", "q", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = materialize(known.select("doc_id", "p", "q", "n_shingles").join(classes, ["p", "q", "n_shingles"]).select("doc_id", "rep").distinct())
    reps = materialize(known.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"))

    places = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").select("key", "pivot")
    members = materialize(places.join(shared, "key").select("key", "band", "rep", "pivot"))
    sketches = materialize(reps.select("rep", "n_shingles", "sketch").join(members.select("rep").distinct(), "rep", "left_semi"))

    def closest(candidates: DataFrame) -> DataFrame:
        """Of (rep, pivot) the pair with the nearest sketch for each rep."""
        apart, near = _close("x", "y", num, den)
        x, y = sketches.alias("x"), sketches.withColumnRenamed("rep", "pivot").alias("y")
        close = candidates.join(x, "rep").join(y, "pivot").where(near)
        best = close.groupBy(F.col("rep").alias("a")).agg(F.min(F.struct(apart.alias("d"), F.col("pivot").alias("b"))).alias("best"))
        return materialize(best.select("a", "best.b"))

    links = verified(closest(members.where("rep <> pivot").select("rep", "pivot").distinct()), docs, size, num, den)
    labels = connected_components(links)
    for turn in range(1, ROUNDS):
        placed = members.select("key", "rep").join(labels, members.rep == labels.id, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        pivots = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("pivot"), F.col("component").alias("home"))).alias("x"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "x.pivot", "x.home")
        tries = placed.join(pivots, "key").where("component <> home").select("rep", "pivot").distinct()
        new = verified(closest(tries), docs, size, num, den)
        if not new.limit(1).count():
            break
        links = materialize(links.unionByName(new))
        labels = connected_components(links)

    # the rest, exactly: pairs of one bucket in different components
    placed = members.join(labels, members.rep == labels.id, "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    most = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("x.component").alias("main"))
    mixed = materialize(placed.join(most, "key").join(sketches, "rep").select("key", "band", "rep", "component", "main", "n_shingles", "sketch"))
    _, near = _close("x", "y", num, den)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & near
    # a bucket's main component is only compared with the others, not with itself; first who has a partner at all
    others = mixed.where("component <> main").alias("x").join(mixed.alias("y"), apart, "left_semi")
    others = materialize(others)
    rest = materialize(mixed.where("component = main").alias("x").join(others.alias("y"), apart, "left_semi"))
    alive = materialize(others.unionByName(rest).select("rep", "component").distinct())
    texts = materialize(docs.join(small(alive, 32), docs.doc_id == alive.rep).dropDuplicates(["doc_id"]).select("rep", "component", "text"))
    more = foreign_shingles(texts, size).join(texts.mapInArrow(fine_sketches(size), "rep long, fine array<long>"), "rep").join(reps.select("rep", "bands"), "rep")
    more = materialize(more)
    one, two = (df.drop("sketch").join(more, "rep") for df in (others, others.unionByName(rest)))
    # |intersection| <= least(foreign): too few shingles that other components have rule a link out
    sizes = F.least("x.n_shingles", "y.n_shingles") * den >= F.greatest("x.n_shingles", "y.n_shingles") * num
    enough = (num + den) * F.least("x.foreign", "y.foreign") >= num * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    close = _differing("fine", FINE_BITS) <= popcount_bound(FINE_FLOOR, FINE_SAMPLES, FINE_BITS)
    met = reduce(or_, ((F.col("x.band") > i) & (F.col("x.bands")[i] == F.col("y.bands")[i]) for i in range(BANDS)))  # in an earlier bucket
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    left = one.alias("x").join(two.alias("y"), same & sizes & enough & once & close & ~met).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    new = verified(materialize(left), docs, size, num, den)
    if new.limit(1).count():
        links = materialize(links.unionByName(new))
        labels = connected_components(links)

    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    placed = member.join(labels, member.rep == labels.id, "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component_id"))
    placed = placed.join(ends, "rep", "left").select("doc_id", "component_id", "n_links")
    return (
        signed.select("doc_id", "n_shingles")
        .join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows of docs, all their columns, but for all documents of a group except that of the smallest doc_id."""
    return without(docs, near_duplicates(docs, id_col, text_col, size).where(~F.col("kept")).select("doc_id"), id_col)
