"""Line dedup by pairwise alignment.

1. Lines of at least MIN_WORDS words are anchors, and so are two lines of text that follow one another, if one of them is.  An
   anchor is shared if several documents have it, and rare if RARE documents at most have it.  A document is paired with the
   document before it (next smaller doc_id) that has the same rare anchor; and, so that no shared anchor is left out, with
   the first document of each of its shared anchors, however many have it.  Either is one pair for each document and anchor,
   never all pairs of those that share it.
2. Each pair is aligned by patience diff: lines that occur once in both are matched along the longest increasing
   subsequence (of equally long ones, that which ends first in the earlier document), the stretches between are aligned likewise, and matches are extended over equal neighbours.
3. From the later document of the pair every aligned block with an anchor line is deleted.

Lines are split at \\n and compared without the white space around them.  Only hashes travel: 64 bits find pairs, 128 bits, two
independent hashes, tell lines apart where something is deleted.

Rows: null and empty texts have no lines and stay as they are.  Rows that repeat a doc_id are taken as one document:
the lines of both count, and what is deleted in one is deleted in the other.  A row without doc_id is returned as it
is.  An empty table gives an empty result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import COEF, attach, chunks, covered, joined_spans, keyed, materialize, mix, range_hashes, read_spans, spread_join, words

MIN_WORDS = 5
#: Documents of a rare anchor.
RARE = 64
LINES = "doc_id long, n_lines int, hashes binary, anchors binary"


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Of each line of a chunk: two hashes (0 for white space only), number of words; and each document's first line."""
    breaks = np.flatnonzero(data == 10)
    docs = np.flatnonzero(np.diff(offsets) > 0)
    begin = np.sort(np.concatenate([offsets[docs], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[docs + 1]]))
    first = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + (np.diff(offsets) > 0))])
    starts, ends, _ = words(data, offsets)
    lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    count = hi - lo
    hashes = np.zeros((len(begin), 2), np.uint64)
    some = np.flatnonzero(count > 0)
    for turn in range(2):
        hashes[some, turn] = range_hashes(data, starts[lo[some]], ends[hi[some] - 1], turn) | np.uint64(1)
    return hashes, count, first


def line_hashes():
    """mapInArrow over (doc_id, text): the hashes of a document's lines, and which lines are anchors."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                hashes, count, first = _lines(data, offsets)
                cut = first.tolist()
                anchor = (count >= MIN_WORDS).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int32)), pa.array([hashes[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([anchor[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    ["doc_id", "n_lines", "hashes", "anchors"],
                )

    return run


def anchor_lines():
    """mapInArrow over line_hashes(): (line, doc_id) of the distinct anchors of each document."""

    def run(batches):
        for batch in batches:
            lines, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, hashes, anchors in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = np.flatnonzero(np.frombuffer(hashes, np.uint64)[::2])
                line, anchor = np.frombuffer(hashes, np.uint64)[::2][text], np.frombuffer(anchors, np.uint8)[text] > 0
                two = mix(line[:-1] * COEF[0] + line[1:] * COEF[1])[anchor[:-1] | anchor[1:]]
                own = np.unique(np.concatenate([line[anchor], two])).view(np.int64)
                lines.append(own)
                docs.append(np.full(len(own), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lines)), pa.array(np.concatenate(docs))], ["line", "doc_id"])

    return run


def line_keys(hashes: bytes) -> list:
    """What two lines must have in common: both hashes; 0 for a line of white space."""
    both = np.frombuffer(hashes, np.int64).reshape(-1, 2).tolist()
    return [(x, y) if x else 0 for x, y in both]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two lists of line keys, increasing in both; 0 never matches."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] != 0:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] != 0:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int | None] = {}
        for j in range(b0, b1):
            once[b[j]] = None if b[j] in once else j
        seen: dict[int, int | None] = {}
        for i in range(a0, a1):
            seen[a[i]] = None if a[i] in seen else i
        points = sorted((i, once[x]) for x, i in seen.items() if x and i is not None and once.get(x) is not None)
        ends: list[int] = []
        best: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(points):
            at = bisect.bisect_left(ends, j)
            back.append(best[at - 1] if at else -1)
            if at == len(ends):
                ends.append(j)
                best.append(k)
            else:
                ends[at], best[at] = j, k
        chain, k = [], best[-1] if best else -1
        while k >= 0:
            chain.append(points[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def deletions():
    """mapInArrow over pairs (doc_id, hashes, anchors, earlier hashes): spans of the later document's lines to delete."""

    def run(batches):
        for batch in batches:
            docs, spans = [], []
            for doc, own, anchors, other in zip(*(batch.column(k).to_pylist() for k in range(4))):
                matched = patience(line_keys(own), line_keys(other))
                flags = np.frombuffer(anchors, np.uint8)
                found, k = [], 0
                while k < len(matched):
                    m = k
                    while m + 1 < len(matched) and matched[m + 1] == (matched[m][0] + 1, matched[m][1] + 1):
                        m += 1
                    a, b = matched[k][0], matched[m][0] + 1
                    if flags[a:b].any():
                        found.append((a, b))
                    k = m + 1
                if found:
                    docs.append(doc)
                    spans.append(np.array(found, np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "spans"])

    return run


def remaining():
    """mapInArrow over (doc_id, text, spans): each text without the lines of its spans."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text, cell in zip(batch.column(1).to_pylist(), batch.column(2)):
                lines = text.split("\n") if text else []
                lost = covered(read_spans(cell), 1, len(lines))
                for a, b in reversed(lost):
                    del lines[a:b]
                n = sum(b - a for a, b in lost)
                for column, value in zip(rows, (len(lines) + n, n, "\n".join(lines) if n else text)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])

    return run


def line_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the lines to delete from each document that loses any; docs are (doc_id, text); materialized."""
    hashed = materialize(docs.where("doc_id is not null").mapInArrow(line_hashes(), LINES))
    places = materialize(hashed.select("doc_id", "n_lines", "hashes", "anchors").mapInArrow(anchor_lines(), "line long, doc_id long"))
    owners = materialize(places.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").select("line", "first", "n"))
    # every document's own anchor with the first document that has it; one of very many documents is dealt over tasks
    shared = materialize(spread_join(places, owners, "line").where("doc_id <> first or n <= " + str(RARE)))
    before = F.lag("doc_id").over(Window.partitionBy("line").orderBy("doc_id"))
    rare = shared.where(F.col("n") <= RARE).select("doc_id", before.alias("first")).where("first is not null and first <> doc_id")
    pairs = materialize(shared.where("doc_id <> first").select("doc_id", "first").unionByName(rare).distinct())
    own = hashed.select("doc_id", "hashes", "anchors")
    earlier = hashed.select(F.col("doc_id").alias("first"), F.col("hashes").alias("other")).dropDuplicates(["first"])
    aligned = spread_join(pairs, earlier, "first").join(own, "doc_id").select("doc_id", "hashes", "anchors", "other")
    found = aligned.mapInArrow(deletions(), "doc_id long, spans binary")
    return materialize(found.groupBy("doc_id").agg(F.collect_list("spans").alias("parts")).mapInArrow(joined_spans(), "doc_id long, spans binary"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for every row of docs; kept_text is null where the text is and nothing goes."""
    docs = keyed(docs, id_col, text_col)
    return attach(docs, line_spans(docs)).select("doc_id", "text", "spans").mapInArrow(remaining(), "doc_id long, n_lines long, n_removed long, kept_text string")


def _rewritten(text_at: int, spans_at: int, count_at: int | None):
    """mapInArrow over whole rows: the text without the lines of its spans; rows left without a word by that go."""

    def run(batches):
        for batch in batches:
            texts, keep, counts = [], [], []
            old = batch.column(count_at).to_pylist() if count_at is not None else [None] * batch.num_rows
            for text, cell, count in zip(batch.column(text_at).to_pylist(), batch.column(spans_at), old):
                lost = read_spans(cell)
                if text and len(lost):
                    lines = text.split("\n")
                    for a, b in reversed(covered(lost, 1, len(lines))):
                        del lines[a:b]
                    text = "\n".join(lines)
                    keep.append(bool(text.strip(" \t\n\x0b\x0c\r")))
                    count = len(text)
                else:
                    keep.append(True)
                texts.append(text)
                counts.append(count)
            columns = [pa.array(texts, batch.schema.types[k]) if k == text_at else pa.array(counts, batch.schema.types[k]) if k == count_at else batch.column(k) for k in range(batch.num_columns) if k != spans_at]
            yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(batch.schema.names) if k != spans_at]).filter(pa.array(keep, pa.bool_()))

    return run


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs, all their columns, with the texts that line_dedup() leaves; count_col, where it exists, gets their length.

    A document that loses all its words goes; one that had none stays.
    """
    spans = line_spans(keyed(docs, id_col, text_col))
    joined = docs.withColumn("__tessera_id", F.col(f"`{id_col}`").cast("long"))
    joined = attach(joined, spans.withColumnRenamed("doc_id", "__tessera_id").withColumnRenamed("spans", "__tessera_spans"), "__tessera_id", "__tessera_spans")
    joined = joined.select(*(F.col(f"`{c}`") for c in docs.columns), "__tessera_spans")
    at = docs.columns.index
    return joined.mapInArrow(_rewritten(at(text_col), len(docs.columns), at(count_col) if count_col in docs.columns else None), docs.schema)
