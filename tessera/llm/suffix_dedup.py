"""Suffix-array dedup with a column-wise multi-document construction.

The column-wise construction inserts one symbol of every document in each round and so takes as many rounds as the
longest document has bytes, each over the whole order built so far.  Whole documents of 100 kB make that quadratic, so
the construction runs on aligned pieces instead, and only where text can repeat:

1. Every window of `window` bytes names an anchor: the `window // 2`-byte string in it with the least hash.  Equal
   windows name equal anchors at equal offsets.  Anchors, one or two in fifty bytes, meet by hash in a packed exchange;
   those that occur once are dropped.  What a chunk of text repeats itself is known there; it sends one place of each
   anchor, however many it has.
2. Each anchor left gives a context: the bytes of the windows that name it.  Contexts of one anchor are
   aligned at it, so equal windows start in the same column.  They reach a task sorted by anchor and as a stream.
3. The contexts are the documents of the construction.  Round by round, from the last column to the first, one symbol
   goes before every context's suffix.  The Burrows-Wheeler transform of the order so far (the symbol before each
   suffix) is read, a stable partition by it is the next order, range minima give the next common prefixes of
   neighbours; the transform and the common prefixes are appended to sequential files and read back in the next round.
   A suffix whose common prefix with a neighbour is `window` or more starts a repeated window.
4. The bytes under repeated windows are removed; all occurrences, the first too.

Suffixes of one round are equally long, as equal windows start in one column; no order over all lengths is needed.
Equal contexts of an anchor are inserted once, so copies cost no rounds.  Files stay in memory up to SPOOL_BYTES, then
go to the shared folder, or, where that is none that Python can open, to where Spark itself spills; they are a task's own and
end with it.  Only about fifty bytes for each distinct context of an anchor are held besides.

Two different anchors or contexts count as equal only if two 64-bit hashes of them are: for a billion of them a chance
of 1e-20.  Windows are told apart by their bytes.

Rows: null and empty texts have no bytes.  Rows that repeat a doc_id are taken as the same document, so what stands at
the same place in both is one occurrence.  A row without doc_id is returned whole.  An empty table gives an empty
result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import COEF, PACKED, bucket_count, by_document, byte_prefix, chunks, covered, joined_spans, keyed, materialize, merged, mix, pack, powers, ragged, read_spans, shared_path, string_buffers, unpack

CONTEXTS = "anchor long, key long, before int, text binary, docs binary, at binary"
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
OUTSIDE = 256
BLOCK = 4096
#: Contexts of whole anchors that go through the rounds together; more only if one anchor has more.
TOGETHER = 32_768
SPOOL_BYTES = 32 << 20
#: Contexts that a task remembers as sent; beyond it, it forgets them and sends texts again.
SENT = 1_000_000


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over values[i : i + size] for each i with so many left."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, values[-1])
    padded[: len(values)] = values
    grid = padded.reshape(blocks, size)
    ahead = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = best.accumulate(grid, axis=1).ravel()
    return best(ahead[:n], behind[size - 1 : size - 1 + n])


def _crossing(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the `size` bytes from each of n places on reach into another document."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, np.maximum(offsets[1:-1] - size + 1, 0), 1)
    np.add.at(edges, offsets[1:-1], -1)
    return np.cumsum(edges)[:n] > 0


def _least(data: np.ndarray, offsets: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `grain` bytes from each place on, and the least one in each window; 0 for windows over an edge."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix, (_, down) = byte_prefix(data), powers(n)
    hashes = mix((prefix[grain:] - prefix[:-grain]) * down[: n - grain + 1])
    hashes >>= np.uint64(1)
    hashes[_crossing(offsets, n, grain)[: len(hashes)]] = NEVER
    least = _sliding(hashes, window - grain + 1, np.minimum)
    least[_crossing(offsets, n, window)[: len(least)]] = 0
    return hashes, least


def _named(hashes: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Places of the anchors: those that some window names."""
    if not len(least):
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    named = _sliding(padded, span, np.maximum)[: len(hashes)]
    return np.flatnonzero((named == hashes) & (hashes != NEVER))


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors that the windows of each document name."""
    hashes, least = _least(data, offsets, window, grain)
    at = _named(hashes, least, window - grain + 1)
    return hashes[at], at


def anchored(data: np.ndarray, offsets: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, ...]:
    """Hashes and places of the anchors with the first and last start of the windows that name each."""
    span = window - grain + 1
    hashes, least = _least(data, offsets, window, grain)
    at = _named(hashes, least, span)
    own = hashes[at]
    lo, hi = np.full(len(at), len(data)), np.full(len(at), -1)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(least)]])[: len(begin)] - 1
    some = np.flatnonzero(least[begin] > 0)
    begin, end, value = begin[some], end[some], least[begin[some]]
    k = np.searchsorted(at, begin)
    while len(k):  # the anchors that windows begin..end can name, one after another
        near = np.flatnonzero((k < len(at)) & (at[np.minimum(k, len(at) - 1)] < end + span))
        begin, end, value, k = begin[near], end[near], value[near], k[near]
        hit = own[k] == value
        one = k[hit]
        np.minimum.at(lo, one, np.maximum(begin[hit], at[one] - span + 1))
        np.maximum.at(hi, one, np.minimum(end[hit], at[one]))
        k = k + 1
    return own, at, lo, hi


def anchor_points(window: int, grain: int, buckets: int):
    """mapInArrow over (doc_id, text): the anchors, packed by hash.

    Of an anchor with several places in a chunk only the first goes to its bucket; its places go by document, in
    buckets of their own (numbered from `buckets` on), as they are known to repeat.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                hashes, at = anchors(data, offsets, window, grain)
                row = np.searchsorted(offsets, at, "right") - 1
                use = known[row]
                hashes, docs, at = hashes[use], ids[row[use]], (at - offsets[row])[use]
                _, one, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                first = np.zeros(len(hashes), bool)
                first[one] = True
                yield pack(buckets, hashes[first], docs[first], at[first])
                several = times[which] > 1
                if several.any():
                    yield from by_document(buckets, docs[several], at[several], buckets).to_batches()

    return run


def repeated(buckets: int):
    """applyInArrow over a bucket: the anchors that occur more than once."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() >= buckets:
            return table
        hashes, docs, at = unpack(table)
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        same = h[1:] == h[:-1]
        keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else order
        return by_document(buckets, docs[keep], at[keep], buckets)

    return run


def contexts(window: int, grain: int):
    """mapInArrow over (doc_id, text, spans): the bytes of the windows that name each anchor in spans.

    Equal contexts of a chunk share a row, with all their places, so periodic text and copies stay small.  A task sends
    the text of a context once; further rows of it have places only.
    """

    def run(batches):
        sent, sent_anchor = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            spans = batch.column(2)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                prefix, (_, down) = byte_prefix(data), powers(len(data))
                hashes, at, first, last = anchored(data, offsets, window, grain)
                near = np.zeros(len(data) + 1, np.int32)
                for k in range(hi - lo):
                    pairs = read_spans(spans[lo + k]) + offsets[k]
                    near[pairs[:, 0]] += 1
                    near[pairs[:, 1]] -= 1
                use = np.cumsum(near)[at] > 0
                hashes, at, first, last = hashes[use], at[use], first[use], last[use] + window
                row = np.searchsorted(offsets, at, "right") - 1
                look = (prefix[last] - prefix[first]) * down[first] + (at - first).astype(np.uint64) * COEF[0] + (last - first).astype(np.uint64) * COEF[1]
                key = mix(look + hashes)
                order = np.lexsort((at, key))
                fresh = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else order
                one = order[fresh]
                held = last[one] - first[one]
                if len(sent):
                    place = np.minimum(np.searchsorted(sent, key[one]), len(sent) - 1)
                    held = np.where((sent[place] == key[one]) & (sent_anchor[place] == hashes[one]), 0, held)
                new = one[held > 0]
                if len(sent) + len(new) > SENT:
                    sent, sent_anchor = sent[:0], sent_anchor[:0]
                sent, sent_anchor = np.concatenate([sent, key[new]]), np.concatenate([sent_anchor, hashes[new]])
                by_key = np.argsort(sent, kind="stable")
                sent, sent_anchor = sent[by_key], sent_anchor[by_key]
                edges = np.concatenate([fresh, [len(order)]]).astype(np.int64)
                out = [hashes[one].astype(np.int64), key[one].astype(np.int64), (at - first)[one].astype(np.int32)]
                parts = [data[ragged(first[one], held)], ids[row[order]].astype(np.int64), (at - offsets[row])[order].astype(np.int32)]
                columns = [pa.array(x) for x in out]
                for part, size in zip(parts, (None, 8, 4)):
                    cuts = np.concatenate([[0], np.cumsum(held)]) if size is None else edges * size
                    columns.append(pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part))]))
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "before", "text", "docs", "at"])

    return run


def spill_dir() -> str | None:
    """Where Spark itself spills on this executor: for a task's own files if the shared folder is none that Python can open."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class Collection:
    """The documents of a construction: contexts of whole anchors, added in the order of anchor and key."""

    def __init__(self, window: int, grain: int, folder: str | None):
        self.window, self.reach, self.width = window, window - grain, 2 * window - grain
        spool = lambda: tempfile.SpooledTemporaryFile(SPOOL_BYTES, dir=folder or spill_dir())
        self.columns, self.places, self.transform, self.prefixes = spool(), spool(), spool(), spool()
        self.blocks: list[int] = []
        self.last: tuple[int, int] | None = None
        self.anchor, self.before, self.length = (np.zeros(0, kind) for kind in (np.int64, np.int16, np.int16))
        self.first_place = np.zeros((0, 2), np.int64)
        self.several = np.zeros(0, bool)

    def add(self, anchor, key, before, text, docs, at) -> None:
        """Rows of contexts(): a column each, text, docs and at as Arrow columns; of equal ones the first has the text."""
        fresh = np.concatenate([[(int(anchor[0]), int(key[0])) != self.last], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])])
        self.last = int(anchor[-1]), int(key[-1])
        which = np.cumsum(fresh) - 1 + len(self.anchor)
        owners, (raw_docs, edges), (raw_at, _) = which, string_buffers(docs), string_buffers(at)
        times = np.diff(edges) // 8
        doc = np.frombuffer(raw_docs.tobytes(), np.int64)[edges[0] // 8 : edges[-1] // 8]
        place = np.frombuffer(raw_at.tobytes(), np.int32)[edges[0] // 8 : edges[-1] // 8]
        owner = np.repeat(owners, times)
        new = np.flatnonzero(fresh)
        first = (np.cumsum(times) - times)[new]
        self.first_place = np.concatenate([self.first_place, np.stack([doc[first], place[first].astype(np.int64)], 1)])
        self.several = np.concatenate([self.several, np.zeros(len(new), bool)])
        self.several[owner[(self.first_place[owner, 0] != doc) | (self.first_place[owner, 1] != place)]] = True
        self.places.write(np.stack([owner.astype(np.int64), doc, place.astype(np.int64)], 1).tobytes())
        data, cuts = string_buffers(text)
        self.anchor = np.concatenate([self.anchor, anchor[new]])
        self.before = np.concatenate([self.before, before[new].astype(np.int16)])
        self.length = np.concatenate([self.length, np.diff(cuts)[new].astype(np.int16)])
        for a in range(0, len(new), BLOCK):
            some = new[a : a + BLOCK]
            block = np.full((len(some), self.width), OUTSIDE, np.uint16)
            size = cuts[some + 1] - cuts[some]
            block.reshape(-1)[ragged(np.arange(len(some)) * self.width + self.reach - before[some], size)] = data[ragged(cuts[some], size)]
            self.columns.write(np.ascontiguousarray(block.T))
            self.blocks.append(len(some))

    def _column(self, column: int) -> np.ndarray:
        """The symbols of a column, by context."""
        out, begin = [], 0
        for size in self.blocks:
            self.columns.seek(2 * (begin * self.width + column * size))
            out.append(np.frombuffer(self.columns.read(2 * size), np.uint16))
            begin += size
        return np.concatenate(out)

    def rounds(self) -> Iterator[tuple[int, np.ndarray]]:
        """Insert column after column; yields (start of windows from the anchor, contexts whose window there repeats)."""
        n = len(self.anchor)
        group = np.zeros(n, np.int64)
        group[1:] = 512 * np.cumsum(self.anchor[1:] != self.anchor[:-1])  # of a rank: a partition keeps to its anchor
        order = np.arange(n)
        self.transform.write(self._column(self.width - 1))
        self.prefixes.write(np.zeros(n, np.uint16))
        for column in range(self.width - 1, -1, -1):
            done = self.width - 1 - column
            self.transform.seek(2 * n * done)
            key = group + np.frombuffer(self.transform.read(2 * n), np.uint16)
            self.prefixes.seek(2 * n * done)
            common = np.frombuffer(self.prefixes.read(2 * n), np.uint16)
            if (key[1:] < key[:-1]).any():
                step = np.argsort(key, kind="stable")
                key, order = key[step], order[step]
                p, q = step[:-1] + 1, step[1:]
            else:
                p = q = np.arange(1, n)
            joined = np.flatnonzero(key[1:] == key[:-1])
            fresh = np.zeros(n, np.uint16)
            if len(joined):
                lo, hi = p[joined], q[joined]
                low = common[hi]
                far = np.flatnonzero(hi > lo)
                if len(far):
                    bounds = np.empty(2 * len(far), np.int64)
                    bounds[0::2], bounds[1::2] = lo[far], hi[far] + 1
                    low = low.copy()
                    low[far] = np.minimum.reduceat(np.append(common, np.uint16(0)), bounds)[0::2]
                fresh[joined + 1] = low + 1
            if column:
                self.transform.seek(0, 2)
                self.transform.write(self._column(column - 1)[order])
            self.prefixes.seek(0, 2)
            self.prefixes.write(fresh)
            if column <= self.reach:
                either = fresh >= self.window
                either[:-1] |= either[1:]
                mask = self.several.copy()
                mask[order[either]] = True
                yield column - self.reach, mask & (self.before >= self.reach - column) & (self.length - self.before >= self.window - self.reach + column)

    def found(self) -> Iterator[pa.RecordBatch]:
        """(doc_id, spans): the starts of repeated windows as runs, for each place of each context."""
        n = len(self.anchor)
        hits, shifts = [], []
        for shift, mask in self.rounds():
            shifts.append(shift)
            hits.append(np.packbits(mask))
        hits = np.stack(hits[::-1])  # by rising shift
        least = shifts[-1]
        self.places.seek(0)
        while raw := self.places.read(24 * BLOCK * 8):
            owner, doc, place = np.frombuffer(raw, np.int64).reshape(-1, 3).T
            some, owner = np.unique(owner, return_inverse=True)
            bits = (hits[:, some >> 3] >> (7 - (some & 7)).astype(np.uint8)) & 1
            edge = np.diff(np.pad(bits.astype(np.int8), ((1, 1), (0, 0))), axis=0).T
            (one, begin), (_, end) = np.nonzero(edge > 0), np.nonzero(edge < 0)
            count = np.bincount(one, minlength=len(some))
            runs = ragged((np.cumsum(count) - count)[owner], count[owner])
            base, docs = np.repeat(place, count[owner]) + least, np.repeat(doc, count[owner])
            spans = np.stack([base + begin[runs], base + end[runs]], 1).astype(np.uint32)
            order = np.lexsort((spans[:, 0], docs))
            docs, spans = docs[order], spans[order]
            cut = np.flatnonzero(np.diff(docs)) + 1
            if len(docs):
                edges = np.concatenate([[0], cut, [len(docs)]])
                binary = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(spans))])
                yield pa.RecordBatch.from_arrays([pa.array(docs[edges[:-1]]), binary], ["doc_id", "spans"])
        for file in (self.columns, self.places, self.transform, self.prefixes):
            file.close()


def column_wise(window: int, grain: int, folder: str | None):
    """mapInArrow over contexts sorted by anchor and key: (doc_id, spans) of the windows that occur again."""

    def run(batches):
        held = None
        for batch in batches:
            anchor, key, before = (batch.column(k).to_numpy() for k in range(3))
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            a = 0
            while a < len(anchor):
                if held and len(held.anchor) >= TOGETHER and held.anchor[-1] != anchor[a]:
                    yield from held.found()
                    held = None
                held = held or Collection(window, grain, folder)
                # up to the anchor with which the collection is full, or all that is left
                k = int(np.searchsorted(ends, a + max(1, TOGETHER - len(held.anchor))))
                b = int(ends[k]) if k < len(ends) else len(anchor)
                held.add(anchor[a:b], key[a:b], before[a:b], *(batch.column(c).slice(a, b - a) for c in (3, 4, 5)))
                a = b
        if held:
            yield from held.found()

    return run


def remaining(window: int):
    """mapInArrow over (doc_id, text, spans): what is left of each document."""

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            out: list[list] = [[], [], [], []]
            for lo, hi, data, offsets in chunks(batch.column(1)):
                for k in range(hi - lo):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    lost = covered(read_spans(spans[lo + k]), window, len(text))
                    kept, at = [], 0
                    for a, b in [*lost, (len(text), len(text))]:
                        kept.append(text[at:a])
                        at = b
                    for column, value in zip(out, (len(text), sum(b - a for a, b in lost), [{"start": a, "end": b} for a, b in lost], b"".join(kept))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) for every row of docs; kept is binary, as cuts may fall inside a character.

    Removes each byte that lies in a `window`-byte string that also starts anywhere else, in the same document too.
    """
    docs = keyed(docs, id_col, text_col)
    grain = window // 2
    if grain < 1:
        raise ValueError("window must be 2 bytes at least")
    buckets = bucket_count(docs)
    twice = docs.mapInArrow(anchor_points(window, grain, buckets), PACKED).groupBy("bucket").applyInArrow(repeated(buckets), PACKED)
    twice = materialize(merged(twice, grain))
    # spans grow with the text, so they are never broadcast: the plan is the same at every size
    around = docs.join(twice.hint("merge"), "doc_id").select("doc_id", "text", "spans").mapInArrow(contexts(window, grain), CONTEXTS)
    again = around.repartition("anchor").sortWithinPartitions("anchor", "key", F.octet_length("text").desc()).mapInArrow(column_wise(window, grain, shared_path(docs.sparkSession)), "doc_id long, spans binary")
    again = materialize(again.groupBy("doc_id").agg(F.collect_list("spans").alias("parts")).mapInArrow(joined_spans(), "doc_id long, spans binary"))
    return docs.join(again.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(remaining(window), "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")
