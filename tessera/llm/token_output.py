"""Token-ID output: best-fit-decreasing packing into id matrices.

Each task packs the pieces of its own partition, a block of about BLOCK_TOKENS ids at a time, so nothing is shuffled
and memory is bounded.  Within a block the pieces go longest first into the open sequence they leave least room in; a
segment tree over the room left finds that sequence.  Documents longer than a sequence are split losslessly: the
pieces, by their number, are the document again.  Which pieces share a sequence so depends on how the input is split into
partitions; the pieces and their ids don't.

write_packed() writes the sequences as flat binary files, which a reader can map into memory, with an index of them.

Rows: null texts count as empty; every document has at least its end mark.  Rows that repeat a doc_id and rows
without one are packed like any other; ties go by doc_id and piece.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.llm.common import keyed
from tessera.llm.packing import pieces

BLOCK_TOKENS = 4 << 20
ROWS_OUT = 64
PACKED_ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>"


class RoomTree:
    """How many open sequences have each amount of room; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}

    def put(self, room: int, sequence: int) -> None:
        self.stacks.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with at least `need` room, removed from the tree."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into lengths, which must not increase."""
    tree, sequences = RoomTree(capacity), []
    for k, length in enumerate(lengths):
        found = tree.take(length)
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        room, sequence = found
        sequences[sequence].append(k)
        tree.put(room - length, sequence)
    return sequences


def _rows(rows: list[tuple], capacity: int, pad_id: int, first: int):
    """The packed sequences of some pieces: sequence_id, n_tokens, doc_ids, pieces, cu_seqlens, ids, position_ids."""
    rows.sort(key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1]))
    for n, members in enumerate(best_fit_decreasing([len(r[2]) // 4 for r in rows], capacity)):
        own = [rows[k] for k in members]
        sizes = [len(r[2]) // 4 for r in own]
        edges = np.zeros(len(own) + 1, np.int32)
        np.cumsum(sizes, out=edges[1:])
        total = int(edges[-1])
        matrix_row = np.full(capacity, pad_id, "<u4")
        matrix_row[:total] = np.frombuffer(b"".join(r[2] for r in own), "<u4")
        positions = np.zeros(capacity, "<u4")
        positions[:total] = np.arange(total) - np.repeat(edges[:-1], sizes)
        yield first + n, total, [r[0] for r in own], [r[1] for r in own], edges, matrix_row.tobytes(), positions.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [(pa.int64(), "sequence_id"), (pa.int32(), "n_tokens"), (pa.list_(pa.int64()), "doc_ids"), (pa.list_(pa.int32()), "pieces"), (pa.list_(pa.int32()), "cu_seqlens"), (pa.binary(), "ids"), (pa.binary(), "position_ids")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (kind, _) in zip(zip(*rows), fields)], [name for _, name in fields])


def packed_rows(path: str, end_id: int, capacity: int, pad_id: int):
    """mapInArrow over (doc_id, text): packed sequences.

    Documents are cut and packed in one worker, so that no id travels to another, and rows go out a few at a time.
    """
    cut = pieces(path, end_id, capacity, True)

    def blocks(batches):
        rows, held = [], 0
        for batch in cut(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "ids"))):
                rows.append(row)
                held += len(row[2]) // 4
                if held >= BLOCK_TOKENS:
                    yield rows
                    rows, held = [], 0
        if rows:
            yield rows

    def run(batches):
        first, ready = TaskContext.get().partitionId() << 36, []
        for block in blocks(batches):
            for row in _rows(block, capacity, pad_id, first):
                first = row[0] + 1
                ready.append(row)
                if len(ready) == ROWS_OUT:
                    yield _batch(ready)
                    ready = []
        if ready:
            yield _batch(ready)

    return run


def pack_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each packed sequence of `capacity` ids.

    ids is a row of the id matrix (little-endian unsigned 32-bit, padded with pad_id); cu_seqlens are the cumulative
    lengths of its segments from 0; position_ids start from 0 again in each segment; doc_ids and pieces name them.
    """
    return keyed(docs, id_col, text_col).mapInArrow(packed_rows(tokenizer_path, end_id, capacity, pad_id), PACKED_ROWS + ", ids binary, position_ids binary")


# ---------------------------------------------------------------------------------------------
# binary files

FORMAT, MANIFEST = "tessera_token_files", "manifest.json"
MATRICES = {"ids": "ids", "position_ids": "positions", "cu_seqlens": "segments"}


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its files' names, sequences, and the CRC-32 of each file of MATRICES."""

    name: str
    sequences: int
    crc32: dict[str, int]


class TokenFilesWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own name; only those of the manifest, written at the end, count."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        system, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        sums, first, segments, index = dict.fromkeys(MATRICES.values(), 0), 0, 0, None
        files = {}
        try:
            for batch in iterator:
                if not files:
                    files = {suffix: system.open_output_stream(f"{root}/{name}.{suffix}.bin") for suffix in sums}
                own = batch.column("cu_seqlens")
                cells = {"ids": batch.column("ids"), "position_ids": batch.column("position_ids"), "cu_seqlens": [np.asarray(x.values, "<i4").tobytes() for x in own]}
                for column, suffix in MATRICES.items():
                    data = b"".join(x if isinstance(x, bytes) else x.as_py() for x in cells[column])
                    files[suffix].write(data)
                    sums[suffix] = zlib.crc32(data, sums[suffix])
                sizes = np.array([len(x.values) for x in own], np.int64)
                n, begins = batch.num_rows, segments + np.cumsum(sizes) - sizes
                columns = {"file": pa.array([name] * n), "row": pa.array(np.arange(first, first + n)), "segments_start": pa.array(begins), "n_segments": pa.array((sizes - 1).astype(np.int32))}
                table = pa.table({**columns, **{c: batch.column(c) for c in ("sequence_id", "n_tokens", "doc_ids", "pieces")}})
                if index is None:
                    index = pyarrow.parquet.ParquetWriter(f"{root}/{name}.index.parquet", table.schema, filesystem=system)
                index.write_table(table)
                first, segments = first + n, segments + int(sizes.sum())
        finally:
            for stream in files.values():
                stream.close()
            if index is not None:
                index.close()
        return Written(name, first, sums)

    def commit(self, messages) -> None:
        system, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        parts = [{"name": m.name, "sequences": m.sequences, "crc32": m.crc32} for m in messages if m is not None and m.sequences]
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"parts": parts}).encode())


class TokenFiles(DataSource):
    """The sink of write_packed()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite):
        return TokenFilesWriter(self.options["path"])


def write_packed(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed sequences as binary files to a new folder; returns their index (see read_index()).

    Each task writes <part>.ids.bin and <part>.positions.bin, matrices of little-endian unsigned 32-bit integers with a row for
    each sequence, and <part>.segments.bin, the cumulative lengths of its segments (signed 32-bit) one sequence after another.
    A task that is run again writes another part; manifest.json names the parts that count, a few bytes for each task, with
    their checksums.  The folder is resolved by Spark's default file system, and must be one that pyarrow can write.  No
    sequences give a manifest without parts.
    """
    spark = packed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(path):
        raise ValueError(f"{folder} exists")
    system.mkdirs(path)
    uri = system.makeQualified(path).toString().replace("file:/", "file:///", 1) if system.getScheme() == "file" else system.makeQualified(path).toString()
    spark.dataSource.register(TokenFiles)
    packed.write.format(FORMAT).mode("append").save(uri)
    return read_index(packed, uri)


def read_index(packed: DataFrame, uri: str) -> DataFrame:
    """(file, row, segments_start, n_segments, sequence_id, n_tokens, doc_ids, pieces): where each written sequence is.

    It is the row-th of <file>.ids.bin and <file>.positions.bin; its n_segments + 1 cumulative lengths begin with number
    segments_start of <file>.segments.bin.
    """
    spark = packed.sparkSession
    system, root = pyarrow.fs.FileSystem.from_uri(uri)
    with system.open_input_stream(f"{root}/{MANIFEST}") as manifest:
        parts = [p["name"] for p in json.loads(manifest.read())["parts"]]
    schema = "file string, row long, segments_start long, n_segments int, sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>"
    return spark.read.schema(schema).parquet(*(f"{uri}/{p}.index.parquet" for p in parts)) if parts else spark.createDataFrame([], schema)
