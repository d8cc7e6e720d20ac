"""Best-fit packing with exact-complement hashing.

Only how many pieces there are of each length matters for a plan, and lengths are bounded by the capacity.  So the
pieces are counted by length, the plan is made from these at most `capacity` counts on the driver, and the pieces are
then given places by their number within their length.

The plan takes lengths from the longest down.  The gap that a piece leaves is looked up in a hash of the single lengths,
the sums of two and the sums of three lengths that are still available; a combination that fills it exactly is used as
often as its counts allow.  Only when no gap can be filled exactly do the pieces left go best-fit: into the open gap
they leave least of.

Rows: null texts count as empty; every document has at least its end mark.  Rows that repeat a doc_id and rows
without one are packed like any other.  An empty table gives an empty result.  Columns other than the two named are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, keyed, materialize, ragged
from tessera.llm.tokens import encoder, slices

SALTS, SALT_ROWS = 64, 100_000


def pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    """mapInArrow over (doc_id, text): the pieces of at most capacity ids that each document is cut into."""

    def cut(coder, docs, texts):
        ids, counts = coder.encode(texts)
        marked = np.full(len(ids) + len(counts), end_id, "<u4")
        own = np.ones(len(marked), bool)
        own[np.cumsum(counts + 1) - 1] = False
        marked[own] = ids
        cuts = counts // capacity + 1
        row = np.repeat(np.arange(len(counts)), cuts)
        number = ragged(np.zeros(len(counts), np.int64), cuts)
        start = number * capacity
        length = np.minimum(counts[row] + 1 - start, capacity)
        edges = np.zeros(len(row) + 1, np.int64)
        np.cumsum(4 * length, out=edges[1:])  # the pieces stand in marked one after another
        raw, at = memoryview(marked).cast("B"), edges.tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
        columns = [docs.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(marked)]))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                yield cut(coder, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
                give_back()

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; only longer ones than capacity are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return keyed(docs, id_col, text_col).mapInArrow(pieces(tokenizer_path, end_id, capacity, with_ids), schema)


class Sums:
    """Hash index: sum -> the single lengths, pairs and triples of available lengths that make it, longest first.

    An entry is made when its sum is first asked for.  Counts only fall, so what has run out is dropped from an entry
    for good; what is short only because the asking piece uses it too is passed over.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _enough(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _pair(self, total: int, most: int, *used: int) -> tuple[int, int] | None:
        if total not in self.pairs:
            longer = np.arange(-(-total // 2), min(total, len(self.left)))
            self.pairs[total] = longer[(self.left[longer] > 0) & (self.left[total - longer] > 0)].tolist()
        entry = self.pairs[total]
        for k in range(len(entry) - 1, -1, -1):
            a = entry[k]
            if not self._enough(a, total - a):
                del entry[k]
            elif a <= most and self._enough(*used, a, total - a):
                return a, total - a
        return None

    def find(self, gap: int, used: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to gap, available beside one piece of length used."""
        if gap < 1:
            return None
        if self._enough(used, gap):
            return (gap,)
        if two := self._pair(gap, gap, used):
            return two
        if gap not in self.triples:
            longest = np.arange(-(-gap // 3), min(gap - 1, len(self.left)))
            self.triples[gap] = longest[self.left[longest] > 0].tolist()
        entry = self.triples[gap]
        for k in range(len(entry) - 1, -1, -1):
            a = entry[k]
            if not self.left[a]:
                del entry[k]
            elif two := self._pair(gap - a, a, used, a):
                return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; uses exactly the counted pieces.

    The number of patterns follows the number of distinct lengths, not that of pieces: each step uses up the pieces
    of a length or the gaps of a size.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left)
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            if length == capacity:
                out.append(((length,), int(left[length])))
                left[length] = 0
                break
            fill = sums.find(capacity - length, length)
            if fill is None:
                break
            whole = (length, *fill)
            times = min(int(left[x]) // whole.count(x) for x in set(whole))
            for x in whole:
                left[x] -= times
            out.append((whole, times))
    # the rest, best-fit decreasing: open[g] are the patterns that have a gap of g
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            gap = min((g for g, bins in open_.items() if g >= length and bins), default=None)
            if gap is None:
                each, times = capacity // length, int(left[length]) // (capacity // length)
                whole = (length,) * (each if times else int(left[length]))
                times, used = max(times, 1), len(whole)
            else:
                pattern, times = next(iter(open_[gap].items()))
                times = min(times, int(left[length]))
                used = max(1, min(gap // length, int(left[length]) // times))
                open_[gap][pattern] -= times
                if not open_[gap][pattern]:
                    del open_[gap][pattern]
                whole = (*pattern, *(length,) * used)
            left[length] -= times * used
            rest = capacity - sum(whole)
            bins = open_.setdefault(rest, {})
            bins[whole] = bins.get(whole, 0) + times
    return out + [(p, n) for bins in open_.values() for p, n in bins.items()]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: number of its first piece in a run, first sequence of the run, offset, pieces in the run."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((times, sequence, offset))
            offset += length
        sequence += times
    out = {}
    for length, runs in found.items():
        times, first, offset = (np.array(x, np.int64) for x in zip(*runs))
        out[length] = (np.cumsum(times) - times, first, offset, times)
    return out


def placed(slots: dict):
    """mapInArrow over pieces with their number within their length (last column): sequence_id and offset in its place."""

    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                begin, first, at, _ = slots[int(x)]
                k = np.searchsorted(begin, number[mine], "right") - 1
                sequence[mine] = first[k] + number[mine] - begin[k]
                offset[mine] = at[k]
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def best_fit_pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces of cut_documents() with sequence_id and offset; a sequence is gapless from offset 0.

    cut should be materialized.  Pieces are numbered within (length, salt), the salts of a length one after another,
    so that a length which many pieces have is not numbered in one task; salts follow the number of pieces.
    """
    salts = max(SALTS, cut.count() // SALT_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counted = materialize(counted)
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(totals, capacity))
    before = counted.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("own") + F.col("before"))
    numbered = numbered.select(*cut.columns, "number")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return numbered.mapInArrow(placed(slots), schema)
