"""Substring dedup with fixed-block anchors.

Documents are word sequences.  A window of `window` words always holds a whole block of window // 2 words whose start
is a multiple of its length.  So:

1. Index the non-overlapping blocks of every document and probe them with every rolling window of a block's length.
   Probes and blocks meet by hash in a packed exchange (a few bytes for each).
2. A hit at another place extends to every `window`-word window around it; these candidates, a small share of the
   text, meet again by two 64-bit hashes of the whole window, and every one but the first (smallest doc_id, then
   earliest start) is marked.  Adjacent marked windows together are the maximal repeats.
3. The words under marked windows are removed.

No pair of documents is ever listed.  What a chunk of text repeats itself is settled there: it sends one place of each
window that it has more than once, and the others go by document at once.  So groups of copies cost less than other
text, and no bucket gets all places of one.

Windows count as equal if both hashes are.  Each is made from its own, independent hashes of the words: 128 bits, for 1e12
windows a chance of 1e-15.

Rows: null and empty texts have no words and lose none.  Rows that repeat a doc_id are taken as the same document: what
one loses at a place the others lose there too, and they do not count as earlier for one another.  A row without doc_id
is returned whole.  An empty table gives an empty result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import PACKED, attach, bucket_count, by_document, chunks, covered, keyed, materialize, merged, pack, ragged, range_hashes, read_spans, unpack, window_hashes, words


def _documents(batch):
    """Chunks of a batch without the rows that have no doc_id: doc_ids, bytes, offsets, rows in the batch."""
    for lo, hi, data, offsets in chunks(batch.column(1)):
        ids = batch.column(0).slice(lo, hi - lo)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        yield lo, hi, ids.fill_null(0).to_numpy(), known, data, offsets


def _windows(data, offsets, size, turns=1):
    """Hashes, document row and word position of every `size`-word window of a chunk."""
    starts, ends, first = words(data, offsets)
    full = np.maximum(np.diff(first) - size + 1, 0)
    at = ragged(first[:-1], full)
    row = np.repeat(np.arange(len(full)), full)
    return *(window_hashes(range_hashes(data, starts, ends, turn), size, turn)[at] for turn in range(turns)), row, at - first[:-1][row]


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, and the number of its run of equal ones for each place of that order."""
    order = np.argsort(hashes, kind="stable")
    return order, np.cumsum(np.concatenate([[0], hashes[order][1:] != hashes[order][:-1]]).astype(np.int64))[: len(order)]


def probes(block: int, buckets: int):
    """mapInArrow: every rolling window of block words, packed by hash; hits within the chunk by document.

    Of a window that has an indexed block in the chunk only that block goes to the bucket: the others are hits.
    """

    def run(batches):
        for batch in batches:
            for _, _, ids, known, data, offsets in _documents(batch):
                hashes, row, at = _windows(data, offsets, block)
                use = known[row]
                hashes, docs, at = hashes[use], ids[row[use]], at[use]
                order, run_of = _runs(hashes)
                anchor = (at % block == 0)[order]
                indexed = np.bincount(run_of[anchor], minlength=run_of[-1] + 1 if len(run_of) else 0)
                place = np.flatnonzero(anchor)
                first = np.zeros(len(order), bool)
                if len(place):
                    first[place[np.concatenate([[True], run_of[place][1:] != run_of[place][:-1]])]] = True
                hit = np.zeros(len(order), bool)
                hit[order] = indexed[run_of] > anchor
                sent = np.zeros(len(order), bool)
                sent[order] = first | (indexed[run_of] == 0)
                yield pack(buckets, hashes[sent], docs[sent], at[sent], np.uint32)
                if hit.any():
                    yield from by_document(buckets, docs[hit], at[hit], buckets).to_batches()

    return run


def hits(block: int, buckets: int):
    """applyInArrow over a bucket: the places whose window equals an indexed block of another place."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() >= buckets:
            return table
        hashes, docs, at = unpack(table, np.uint32)
        anchor = at % block == 0
        index = np.sort(hashes[anchor])
        found = np.searchsorted(index, hashes, "right") - np.searchsorted(index, hashes, "left") > anchor
        return by_document(buckets, docs[found], at[found], buckets)

    return run


def _later(one, two, docs, at) -> np.ndarray:
    """Which windows have an equal one (by both hashes) at an earlier place; the earliest place may be there twice."""
    order = np.lexsort((at, docs, two, one))
    h, g, d, p = one[order], two[order], docs[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else order
    out = np.zeros(len(h), bool)
    out[order] = (d != d[first]) | (p != p[first])
    return out


def candidates(window: int, block: int, buckets: int):
    """mapInArrow over (doc_id, text, spans): the windows that contain a hit, packed by the hash of the whole window.

    A window with an earlier equal one in the chunk goes by document: it is known to be later.
    """

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            for lo, _, ids, known, data, offsets in _documents(batch):
                one, two, row, at = _windows(data, offsets, window, 2)
                total = np.bincount(row, minlength=len(ids))
                base = np.cumsum(total) - total
                use = np.zeros(len(one), bool)
                for k in np.flatnonzero(known & (total > 0)).tolist():
                    for a, b in read_spans(spans[lo + k]).tolist():
                        use[base[k] + max(0, a - (window - block)) : base[k] + min(b, total[k])] = True
                one, two, docs, at = one[use], two[use], ids[row[use]], at[use]
                later = _later(one, two, docs, at)
                sent = ~later
                yield pack(buckets, one[sent], docs[sent], at[sent], np.uint64, two[sent])
                if later.any():
                    yield from by_document(buckets, docs[later], at[later], buckets).to_batches()

    return run


def marked(buckets: int):
    """applyInArrow over a bucket: the windows that have an equal one at an earlier place."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() >= buckets:
            return table
        both, docs, at = unpack(table)
        again = _later(both[0::2], both[1::2], docs, at)
        return by_document(buckets, docs[again], at[again], buckets)

    return run


def remaining(window: int):
    """mapInArrow over (doc_id, text, spans): what is left of each document."""

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            out: list[list] = [[], [], [], []]
            for lo, _, _, _, data, offsets in _documents(batch):
                starts, ends, first = words(data, offsets)
                joined = _joined(data, starts, ends)
                for k in range(len(offsets) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    lost = covered(read_spans(spans[lo + k]), window, b - a)
                    text = _kept(joined, a, b, lost)
                    for column, value in zip(out, (b - a, sum(y - x for x, y in lost), [{"start": x, "end": y} for x, y in lost], text)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[3], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
            )

    return run


def _joined(data, starts, ends):
    """The words of a chunk, each followed by one space, as bytes, and where each word begins in them."""
    lengths = ends - starts
    begin = np.r_[0, np.cumsum(lengths + 1)]
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    out[ragged(begin[:-1], lengths)] = data[ragged(starts, lengths)]
    return out, begin


def _kept(joined, a, b, lost):
    """The words a..b but for the lost ones (numbered from a), joined by one space."""
    out, begin = joined
    pieces, at = [], a
    for x, y in [*lost, (b - a, b - a)]:
        if a + x > at:
            pieces.append(out[begin[at] : begin[a + x] - 1].tobytes())
        at = a + y
    return b" ".join(pieces)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text) for every row of docs.

    Removes each word that lies in a window of `window` consecutive words whose sequence also starts earlier, in a
    smaller doc_id or before in the same document.  removed lists the maximal runs of removed words.
    """
    docs = keyed(docs, id_col, text_col)
    block = window // 2
    if block < 1:
        raise ValueError("window must be 2 words at least")
    buckets = bucket_count(docs)
    hit = docs.mapInArrow(probes(block, buckets), PACKED).groupBy("bucket").applyInArrow(hits(block, buckets), PACKED)
    hit = materialize(merged(hit, window - block + 1))
    around = attach(docs, hit).where("spans is not null").select("doc_id", "text", "spans")
    again = around.mapInArrow(candidates(window, block, buckets), PACKED).groupBy("bucket").applyInArrow(marked(buckets), PACKED)
    again = materialize(merged(again, window))
    return attach(docs, again).select("doc_id", "text", "spans").mapInArrow(remaining(window), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
