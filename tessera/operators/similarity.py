"""Dense cosine top-K, suggestions from it, and concept sets by meaning.

Vectors meet in Arrow batches: blocks of targets are multiplied with groups of queries in numpy.  Few queries are a broadcast
variable of which each task holds one group's product at a time and the best k a query so far; only these leave it.  Where
queries are too many, packed blocks and groups are joined, and a block's best k a query leave the task.  Similarities are rounded to four digits before they are ranked; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

BLOCK_ROWS, GROUP_ROWS = 4096, 512
BLOCKS_A_LANE = 64
BROADCAST_BYTES, BEST_BYTES = 32 << 20, 128 << 20
PAIRS_A_TASK = 1 << 24
PACKED = "number long, ids binary, vectors binary, width int"


def _unit(cells: pa.Array) -> np.ndarray:
    """Rows of length 1 as doubles; a zero vector stays.  All vectors of a batch have one length."""
    cells = cells.cast(pa.list_(pa.float64()))
    x = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)
    norm = np.sqrt((x * x).sum(1))
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)


def _packed(rows_each: int):
    """mapInArrow over (id, vector): rows of packed ids and unit vectors, rows_each at most in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_each):
                part = batch.slice(lo, rows_each)
                x = _unit(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["number", "ids", "vectors", "width"])
                number += 1

    return run


NONE = np.iinfo(np.int32).max
FOUND = "query_id long, target_id long, similarity double"


def _top(q_ids: np.ndarray, q: np.ndarray, t_ids: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ten thousandths and ids of the k nearest of at most BLOCK_ROWS targets, by ascending id, of each query; NONE where there are fewer.

    Rank and place among the ids are one number, so that a partition gives the nearest with their ties.
    """
    tenth = np.rint(q @ t.T * 1e4)
    known = np.isfinite(tenth)
    key = (10_000 - np.where(known, tenth, 0).astype(np.int32)) * np.int32(BLOCK_ROWS) + np.arange(len(t_ids), dtype=np.int32)
    key[~known | (q_ids[:, None] == t_ids[None, :])] = NONE
    if k < key.shape[1]:
        key = np.partition(key, k - 1, axis=1)[:, :k]
    key.sort(axis=1)
    some = key != NONE
    return np.where(some, 10_000 - key // BLOCK_ROWS, -NONE).astype(np.int32), np.where(some, t_ids[key % BLOCK_ROWS * some], NONE)


def _rows(q_ids: np.ndarray, tenths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    keep = (tenths != -NONE).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, ids.shape[1])[keep]), pa.array(ids.ravel()[keep].astype(np.int64)), pa.array(tenths.ravel()[keep] / 1e4)], ["query_id", "target_id", "similarity"])


def _best(k: int):
    """mapInArrow over (query ids, query vectors, ids, vectors, width): the k best of each block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                q, t = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(-1, width) for c in ("q_vectors", "vectors"))
                q_ids, t_ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                order = np.argsort(t_ids, kind="stable")
                yield _rows(q_ids, *_top(q_ids, q, t_ids[order], t[order], k))

    return run


def _best_of_task(held, k: int):
    """mapInArrow over (id, vector): the k best of a task's targets for each query of the broadcast groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)) for ids, vectors, width in held.value]
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(groups)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                t_ids, t = part.column(0).to_numpy(), _unit(part.column(1))
                order = np.argsort(t_ids, kind="stable")
                t_ids, t = t_ids[order], t[order]
                for g, (q_ids, q) in enumerate(groups):
                    if q.shape[1] != t.shape[1]:
                        continue
                    new = _top(q_ids, q, t_ids, t, k)
                    if best[g] is not None:
                        tenths, ids = (np.concatenate(x, axis=1) for x in zip(best[g], new))
                        first = np.lexsort((ids, -tenths), axis=1)[:, :k]
                        new = np.take_along_axis(tenths, first, 1), np.take_along_axis(ids, first, 1)
                    best[g] = new
        for (q_ids, _), found in zip(groups, best):
            if found is not None:
                yield _rows(q_ids, *found)

    return run


def _spread(df: DataFrame, pairs: int) -> DataFrame:
    """df over as many tasks as so many pairs of its rows with others are worth; few files don't bound them."""
    tasks = min(4 * df.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS_A_TASK)
    return df.repartition(tasks) if tasks > 1 else df


def cosine_topk(queries: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, target_id, similarity, rank) of the k nearest targets of each stated query, itself left out.

    queries and targets are (id, vector); rows without id or vector take no part.
    """
    known = lambda df: df.select(F.col("id").cast("long").alias("id"), "vector").where("id is not null and vector is not null")
    groups = written(known(queries).mapInArrow(_packed(GROUP_ROWS), PACKED))
    n_bytes, n_queries = (x or 0 for x in groups.agg(F.sum(F.octet_length("vectors")), F.sum(F.octet_length("ids") / 8).cast("long")).first())
    if n_bytes <= BROADCAST_BYTES and n_queries * k * 16 <= BEST_BYTES:
        held = groups.sparkSession.sparkContext.broadcast([tuple(r) for r in groups.select("ids", "vectors", "width").collect()])
        rows = known(targets)
        few = _spread(rows, rows.count() * n_queries).mapInArrow(_best_of_task(held, k), FOUND)
    else:  # every block meets every group: the groups are repeated over lanes of blocks, so that no key is hot
        groups = groups.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "width")
        blocks = written(known(targets).mapInArrow(_packed(BLOCK_ROWS), PACKED))
        lanes = max(1, blocks.count() // BLOCKS_A_LANE)
        dealt = groups.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        pairs = blocks.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(lanes)).cast("int")).join(dealt, ["width", "lane"])
        few = pairs.select("q_ids", "q_vectors", "ids", "vectors", "width").mapInArrow(_best(k), FOUND)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "target_id"))).where(F.col("rank") <= k)


def embedding_suggestions(queries: DataFrame, targets: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """The k nearest targets as suggestions: with strategy and confidence, the whole percents of the similarity."""
    found = cosine_topk(queries, targets, k).where(F.col("similarity") >= least)
    return found.select("query_id", "target_id", "similarity", F.lit("sapbert").alias("strategy"), F.floor(F.round(F.col("similarity") * 100, 6)).cast("int").alias("confidence"), "rank")


def best_of_forms(forms: DataFrame, targets: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, target_id, similarity, rank) of queries that have several forms (query_id, id, vector): a target counts by its
    nearest form."""
    near = cosine_topk(forms, targets, k).withColumnRenamed("query_id", "form_id")
    each = near.join(forms.select(F.col("id").alias("form_id"), "query_id"), "form_id").groupBy("query_id", "target_id").agg(F.max("similarity").alias("similarity"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "target_id"))).where(F.col("rank") <= k)


def semantic_concept_set(queries: DataFrame, targets: DataFrame, groups: DataFrame, overfetch: int = 100, gap: float | None = 0.08, least: float = 0.55) -> DataFrame:
    """(query_id, group_key, target_id): what is near the best hit of each query, widened to whole groups.

    groups is (target_id, group_key); a target without key stands alone.  queries may have several forms of one query, with a
    column query_id beside id.  A gap of None takes all hits of at least `least`: drugs are taken so, from 0.70.
    """
    top = best_of_forms(queries, targets, overfetch) if "query_id" in queries.columns else cosine_topk(queries, targets, overfetch)
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    near = top.withColumn("best", best).where((F.col("best") >= least) & (F.col("similarity") >= (F.lit(least) if gap is None else F.greatest(F.col("best") - gap, F.lit(least)))))
    keyed = written(near.join(groups, "target_id", "left").select("query_id", "group_key", "target_id"))
    wanted = written(keyed.where("group_key is not null").select("query_id", "group_key").distinct())
    members = written(groups.where("group_key is not null").select("target_id", "group_key").distinct())
    # few groups may have most rows: the members are spread whatever their group is, and what each row is widened to is distinct
    n_wanted, n_members = wanted.count(), members.count()
    if n_wanted * 32 <= BROADCAST_BYTES:
        wide = _spread(members, n_wanted * n_members).join(F.broadcast(wanted), "group_key")
    else:
        lanes = max(1, min(n_members // BLOCK_ROWS, 4 * groups.sparkSession.sparkContext.defaultParallelism))
        dealt = wanted.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        wide = members.withColumn("lane", F.pmod(F.xxhash64("target_id"), F.lit(lanes)).cast("int")).join(dealt, ["group_key", "lane"])
    alone = keyed.where("group_key is null").distinct()
    return wide.select("query_id", "group_key", "target_id").unionByName(alone)
