"""Helpers shared by the text operators: shared scratch tables, guarded broadcasts and vectorised text kernels.

The kernels work on the buffers of an Arrow string column.  A batch is cut into chunks of whole
documents; a chunk holds about CHUNK_BYTES of text (more only if one document alone is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 60_000
BROADCAST_BYTES = 32 << 20
#: Bytes of texts in an Arrow batch where the executor's memory is short: the JVM and the worker hold a batch up to twice each.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

# ---------------------------------------------------------------------------------------------
# tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def shared_path(spark: SparkSession) -> str | None:
    """The shared folder, as Spark's default file system resolves it, as a path that Python can open; None where it isn't one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub("^file:/*", "/", folder) if folder.startswith("file:") else None


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int | None):
    """Arrow batches of about size bytes at most for what is run within, where the session has set no bound; None: as they are."""
    ours = size is not None and spark.conf.get(_BATCH, None) is None
    if ours:
        spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(_BATCH)


def materialize(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    batch_bytes bounds the Arrow batches that its Python functions get, all rows of df go through all the same.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with arrow_batches(df.sparkSession, batch_bytes):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the counted rows stay under limit; else df as it is, for a shuffled join.

    df should be a materialized table, as it is counted.
    """
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in the one column of ids, which is materialized here."""
    gone = materialize(ids.toDF("__tessera_id").where("__tessera_id is not null").distinct())
    return docs.join(small(gone, 24), F.col(f"`{id_col}`") == F.col("__tessera_id"), "left_anti")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that the operators read, under fixed names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


# ---------------------------------------------------------------------------------------------
# text kernels

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; (P[b] - P[a]) * BASE**-a is the hash of bytes a..b."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column):
    """(first row, row after the last, bytes, offsets from 0) of consecutive runs of whole documents."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + CHUNK_ROWS, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each document's first word (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, by which words are looked up or made features of; where it decides, take range_hashes()."""
    _, down = powers(len(data))
    prefix = byte_prefix(data)
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each range; another, independent one for each turn.

    Every eight bytes are finalised with their number before they are summed, so unlike in a polynomial modulo 2**64 no
    rearrangement of bytes or blocks cancels out.
    """
    lengths = ends - starts
    blocks = np.maximum((lengths + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    value &= np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
    mixed = mix(value * COEF[61 - turn] + mix((number.astype(np.uint64) + np.uint64(1)) * COEF[31 + turn]))
    total = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    return mix(total + lengths.astype(np.uint64) * COEF[47 + turn])


def window_hashes(hashes: np.ndarray, size: int, turn: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + size] for every i that has so many left; another one for each turn."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * COEF[(k + 29 * turn) % len(COEF)]
    return mix(out + np.uint64(size + (turn << 20)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] values, then the same of the next."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------------------------------------
# packed exchange: many (hash, document, position) triples in few rows

PACKED = "bucket int, docs binary, counts binary, hashes binary, positions binary"


def bucket_count(docs: DataFrame) -> int:
    """Buckets of a packed exchange: follows the number of input splits, so a bucket stays in memory at any size."""
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def pack(buckets: int, hashes: np.ndarray, docs: np.ndarray, positions: np.ndarray, width=np.uint64, second: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket that the hashes fall in.

    docs must not decrease and positions must increase within a document.  The bucket comes from the hash
    modulo buckets; `hashes` keeps its upper bits in the given width, or nothing if that is None.  With a second hash
    it keeps both, one beside the other.
    """
    which = (hashes % np.uint64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
    order = np.argsort(which, kind="stable")
    which, docs, positions = which[order], docs[order], positions[order].astype(np.uint32)
    stored = hashes[order] if width else np.zeros(0, np.uint64)
    if width not in (None, np.uint64):
        stored = (stored >> np.uint64(64 - 8 * np.dtype(width).itemsize)).astype(width)
    if second is not None:
        stored = np.stack([stored, second[order]], 1)
    cut = np.r_[0, np.flatnonzero(np.diff(which)) + 1, len(which)] if len(which) else np.zeros(1, np.int64)
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        d = docs[a:b]
        first = np.r_[0, np.flatnonzero(d[1:] != d[:-1]) + 1]
        for out, value in zip(rows, (int(which[a]), d[first].astype(np.int64).tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(), stored[a:b].tobytes(), positions[a:b].tobytes())):
            out.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "docs", "counts", "hashes", "positions"])


def unpack(table: pa.Table, width=np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes, docs, positions of all rows of a bucket."""
    joined = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("docs", np.int64), ("counts", np.uint32), ("hashes", width), ("positions", np.uint32))}
    return joined["hashes"], np.repeat(joined["docs"], joined["counts"]), joined["positions"]


def by_document(buckets: int, docs: np.ndarray, positions: np.ndarray, base: int = 0) -> pa.Table:
    """Places packed again, now by document; the buckets are numbered from base."""
    order = np.lexsort((positions, docs))
    docs, positions = docs[order], positions[order]
    packed = pack(buckets, mix(docs.astype(np.uint64)), docs, positions, None)
    if base:
        packed = packed.set_column(0, "bucket", pc.add(packed.column(0), pa.scalar(base, pa.int32())))
    return pa.Table.from_batches([packed])


def merged(found: DataFrame, reach: int = 1) -> DataFrame:
    """(doc_id, spans): the places of each document, packed by document, as runs with steps of at most reach."""

    def run(table: pa.Table) -> pa.Table:
        _, docs, at = unpack(table)
        order = np.lexsort((at, docs))
        docs, at = docs[order], at[order].astype(np.int64)
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        fresh = docs[1:] != docs[:-1]
        cut = np.flatnonzero(fresh | (np.diff(at) > reach))
        spans = np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1], 1).astype(np.uint32)
        owner = docs[np.r_[0, cut + 1]]
        first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
        return pa.table({"doc_id": pa.array(owner[first]), "spans": pa.array([spans[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)])], pa.binary())})

    return found.groupBy("bucket").applyInArrow(run, "doc_id long, spans binary")


def joined_spans():
    """mapInArrow over (doc_id, parts): the spans of all parts of a document, sorted."""

    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                pairs = np.frombuffer(b"".join(parts), np.uint32).reshape(-1, 2)
                out.append(pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "spans"])

    return run


def read_spans(cell) -> np.ndarray:
    """Rows (start, end) of a value of `spans`; none for null."""
    return np.frombuffer(cell.as_py() or b"", np.uint32).astype(np.int64).reshape(-1, 2)


def covered(spans: np.ndarray, width: int, size: int) -> list[tuple[int, int]]:
    """What windows of `width` that start within spans cover of 0..size, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in spans.tolist():
        a, b = max(a, 0), min(b - 1 + width, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key; left is materialized and may have hot keys.

    Keys with more than 1 / share of left's rows, so fewer than share of them, are dealt over as many salts as their
    part of the rows asks for; right's rows of these keys are repeated for each salt.
    """
    total = left.count()
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * share > F.lit(total))
    hot = F.broadcast(materialize(hot.select(key, F.ceil(F.col("__n") * share / F.lit(max(total, 1))).cast("int").alias("__salts"))))
    salts = F.coalesce("__salts", F.lit(1))
    one = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    two = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return one.join(two, [key, "__salt"]).drop("__salt")


def attach(docs: DataFrame, spans: DataFrame, key: str = "doc_id", column: str = "spans") -> DataFrame:
    """docs with a column of spans by key, null where a document has none.

    spans must be materialized with one row for each key.  It is broadcast only if its measured size allows it.
    """
    rows, held = spans.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    return docs.join(F.broadcast(spans) if rows * 32 + (held or 0) <= BROADCAST_BYTES else spans, key, "left")
