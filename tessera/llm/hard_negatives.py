"""Hard-negative mining over k-means inverted lists with stored radii.

1. Vectors become integers, floor(scale * x), and scores integer inner products.  Rows of equal vector and label are one
   class: of each only the rows that can be in a result go on (the smallest ids, one more than the positives asked for),
   so copies of a vector cost nothing.
2. k-means is fitted on FIT_ROWS rows at most (those of least hash of their id); every row is put into the list of its
   nearest centroid and its label.  Lists are cut into pieces of LIST_BYTES; each stores its radius, the largest distance
   of its rows from the centroid.  The index is exact whatever the centroids are: recall is 1.
3. Anchors, one for each class, are packed in blocks.  By Cauchy-Schwarz a row x of a list scores a.c - |a| r <= a.x <= a.c
   + |a| r.  A block first visits the few lists of largest bound; their k-th scores then rule out every list whose bound is
   strictly below them, or which lies outside the window, for all anchors of a block.  The lists that stay are visited in
   the order of their bounds, LISTS_A_LANE in a lane, and skipped as soon as the bound falls below the k-th score so far.
4. So first the positives of each anchor are found, then their windows, then the negatives of each window.

Nothing is collected but the sample for k-means; blocks and pieces meet in equi-joins on their numbers.

Rows: a null id, label or vector, or a null or non-finite component, leaves a row out.  Of rows that repeat an id the least
(label, vector) takes part.  Vectors of different length count as filled up with zeros.  Ties go to the smaller id.  An empty table, or one without anchors, gives an empty result.
Columns other than the three named are not read.  Scores are exact up to 2^53; vectors that could pass it are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small, spread_join

FIT_ROWS, FIT_ROUNDS = 20_000, 8
ROWS_A_CENTROID = 2048
MOST_CENTROIDS = 1024
LIST_BYTES = 1 << 18
BLOCK = 512
SEEDS = 2
LISTS_A_LANE = 64
HEADS_A_CHUNK = 4096
LOWEST, HIGHEST = -(1 << 62), 1 << 62

PIECE = "list long, label long, centroid int, radius double, ids binary, vectors binary"
PLACED = "id long, label long, v array<long>, centroid int, away double"
PACKED = "block long, label long, ids binary, vectors binary, lo binary, hi binary, floor binary"
FOUND = "anchor long, window int, near long, score long"


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that can take part, one for each id; v holds integers."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), finite.alias("finite"))
    rows = rows.where("id is not null and label is not null and v is not null and finite")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow list column, filled up with zeros."""
    lengths = np.diff(cells.offsets.to_numpy())
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _stored(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


def _read(cell: bytes, rows: int, kind=np.int32) -> np.ndarray:
    x = np.frombuffer(cell, kind)
    return x.reshape(rows, len(x) // rows)


def fit_centroids(rows: DataFrame, total: int, width: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds over a bounded sample of rows: FIT_ROWS at most, 64 MB at most."""
    wanted = max(1, min(MOST_CENTROIDS, total // ROWS_A_CENTROID, (8 << 20) // (8 * max(width, 1))))
    taken = max(1, min(FIT_ROWS, (64 << 20) // (8 * max(width, 1))))
    share = min(1.0, 1.1 * taken / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("id", "v").limit(taken).toArrow().sort_by("id")
    x = _matrix(sample.column("v").combine_chunks(), width) if sample.num_rows else np.zeros((1, width))
    c = x[np.random.default_rng(seed).permutation(len(x))[:wanted]]
    for _ in range(FIT_ROUNDS):
        near = _nearest(x, c)[0]
        count = np.bincount(near, minlength=len(c))
        some = np.flatnonzero(count)
        sums = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(count) - count)[some])
        c = c.copy()
        c[some] = sums / count[some][:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance."""
    at = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(1))


def placed(c: np.ndarray):
    """mapInArrow over (id, label, v): with centroid and distance."""

    def run(batches):
        for batch in batches:
            at, away = _nearest(_matrix(batch.column(2), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], ["id", "label", "v", "centroid", "away"])

    return run


def pieces(width: int):
    """mapInArrow over placed rows in the order (label, centroid): pieces of inverted lists, a row each."""
    most = max(16, LIST_BYTES // (4 * max(width, 1)))

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, at, away = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            x = _matrix(batch.column(2), width)
            edges = [0, *(np.flatnonzero((labels[1:] != labels[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), len(ids)]
            out: list[list] = [[], [], [], [], [], []]
            for first, last in zip(edges, edges[1:]):
                for a in range(first, last, most):
                    b = min(a + most, last)
                    for column, value in zip(out, (base, int(labels[a]), int(at[a]), float(away[a:b].max()), ids[a:b].tobytes(), _stored(x[a:b]))):
                        column.append(value)
                    base += 1
            yield pa.RecordBatch.from_arrays([pa.array(z, kind) for z, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()))], ["list", "label", "centroid", "radius", "ids", "vectors"])

    return run


def packed_anchors(width: int):
    """applyInArrow over a block of (block, id, label, v, lo, hi, floor): one row with all of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        flat = {name: pa.array([column(name).flatten().to_numpy().tobytes()], pa.binary()) for name in ("lo", "hi", "floor")}
        return pa.table({"block": column("block")[:1], "label": column("label")[:1], "ids": pa.array([column("id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([_stored(_matrix(column("v"), width))], pa.binary()), **flat})

    return run


def visit_plan(c: np.ndarray, same: bool, seeds: bool):
    """mapInArrow over blocks beside chunks of heads: (block, list, bound) of the lists that a block must visit.

    Lists outside every window, or with an upper bound strictly below the k-th score known, are left out.  With seeds only the
    SEEDS lists of largest bound of each anchor are taken.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = _read(row["vectors"], len(ids)).astype(np.float64)
                lo, hi, floor = (_read(row[k], len(ids), np.int64) for k in ("lo", "hi", "floor"))
                use = np.flatnonzero((np.frombuffer(row["labels"], np.int64) == row["label"]) == same)
                if not len(use) or not lo.size:
                    continue
                middle = (x @ c.T)[:, np.frombuffer(row["centroids"], np.int32)[use]]
                # a little wide against rounding
                reach = np.sqrt((x * x).sum(1))[:, None] * np.frombuffer(row["radii"], np.float64)[use] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
                stand = np.zeros(middle.shape, bool)
                for w in range(lo.shape[1]):
                    least, most = np.maximum(lo[:, w], floor[:, w])[:, None], hi[:, w][:, None]
                    stand |= (least <= most) & (middle + reach >= least) & (middle - reach <= most)
                bound = np.where(stand, middle + reach, -np.inf)
                if seeds:
                    top = np.argsort(-bound, axis=1, kind="stable")[:, :SEEDS]
                    chosen = np.unique(top[np.take_along_axis(stand, top, 1)])
                else:
                    chosen = np.flatnonzero(stand.any(0))
                out[0] += [row["block"]] * len(chosen)
                out[1] += np.frombuffer(row["lists"], np.int64)[use[chosen]].tolist()
                out[2] += bound[:, chosen].max(0).tolist() if len(chosen) else []
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["block", "list", "bound"])

    return run


class Best:
    """The k best (score, id) of each anchor and window of a block; higher scores first, then smaller ids."""

    def __init__(self, row: dict, k: int):
        self.ids = np.frombuffer(row["anchors"], np.int64)
        self.x = _read(row["anchor_vectors"], len(self.ids)).astype(np.float64)
        self.lo, self.hi, floor = (_read(row[c], len(self.ids), np.int64) for c in ("lo", "hi", "floor"))
        self.k, shape = k, (*self.lo.shape, k)
        self.score, self.near = np.full(shape, LOWEST, np.int64), np.full(shape, HIGHEST, np.int64)
        self.least = np.maximum(self.lo, floor)

    def needs(self, bound: float) -> bool:
        """Whether a list of this upper bound can still change a result: not if it is strictly below every k-th score."""
        return bool((bound >= np.maximum(self.least, self.score[:, :, -1])).any())

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = (self.x @ vectors.T).astype(np.int64)
        for w in range(self.lo.shape[1]):
            fits = (scores >= np.maximum(self.least[:, w], self.score[:, w, -1])[:, None]) & (scores <= self.hi[:, w][:, None])
            anchor, at = np.nonzero(fits)
            if not len(anchor):
                continue
            anchor = np.concatenate([anchor, np.repeat(np.arange(len(self.x)), self.k)])
            score = np.concatenate([scores[fits], self.score[:, w].ravel()])
            near = np.concatenate([ids[at], self.near[:, w].ravel()])
            order = np.lexsort((near, -score, anchor))
            anchor, score, near = anchor[order], score[order], near[order]
            rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
            top = rank < self.k
            self.score[anchor[top], w, rank[top]], self.near[anchor[top], w, rank[top]] = score[top], near[top]

    def rows(self) -> pa.RecordBatch:
        a, w, r = np.nonzero(self.near != HIGHEST)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(w.astype(np.int32)), pa.array(self.near[a, w, r]), pa.array(self.score[a, w, r])], ["anchor", "window", "near", "score"])


def visits(k: int):
    """mapInArrow over visits in the order (block, lane, falling bound): the k best of each anchor and window, per lane."""

    def run(batches):
        key, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["block"], row["lane"]):
                    if best is not None:
                        yield best.rows()
                    key, best = (row["block"], row["lane"]), Best(row, k)
                if best.needs(row["bound"]):
                    ids = np.frombuffer(row["ids"], np.int64)
                    best.take(ids, _read(row["vectors"], len(ids)).astype(np.float64))
        if best is not None:
            yield best.rows()

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of (anchor, window, near, score), with their rank."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "near")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Inverted lists in pieces, their heads (label, centroid, radius) in chunks, and the centroids."""

    def __init__(self, rows: DataFrame, total: int, width: int):
        self.width, self.c = width, fit_centroids(rows, total, width)
        self.tasks = max(4, min(total // 20_000, 20_000))
        self.pieces = materialize(self._placed(rows).mapInArrow(pieces(width), PIECE))
        heads = self.pieces.select("list", "label", "centroid", "radius")
        count = heads.count()
        self.lanes, self.chunks = max(1, count // LISTS_A_LANE), max(1, -(-count // HEADS_A_CHUNK))

        def pack(table: pa.Table) -> pa.Table:
            flat = {new: pa.array([table.column(old).to_numpy().tobytes()], pa.binary()) for new, old in (("lists", "list"), ("labels", "label"), ("centroids", "centroid"), ("radii", "radius"))}
            return pa.table({"chunk": table.column("chunk").slice(0, 1), **flat})

        dealt = heads.withColumn("chunk", F.pmod(F.xxhash64("list"), F.lit(self.chunks)).cast("int"))
        self.heads = materialize(dealt.groupBy("chunk").applyInArrow(pack, "chunk int, lists binary, labels binary, centroids binary, radii binary"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        dealt = rows.mapInArrow(placed(self.c), PLACED)
        return dealt.repartitionByRange(self.tasks, "label", "centroid", "id").sortWithinPartitions("label", "centroid", "id")

    def blocks(self, anchors: DataFrame) -> DataFrame:
        """(block, id, label, v): anchors of one label and, as far as it goes, of near centroids, BLOCK at most in a block."""

        def run(batches):
            from pyspark import TaskContext

            block, label, size = (TaskContext.get().partitionId() << 32) - 1, None, BLOCK
            for batch in batches:
                numbers = []
                for x in batch.column(1).to_pylist():
                    if x != label or size == BLOCK:
                        block, label, size = block + 1, x, 0
                    size += 1
                    numbers.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns[:3]], ["block", "id", "label", "v"])

        return materialize(self._placed(anchors).mapInArrow(run, "block long, id long, label long, v array<long>"))

    def _visit(self, windows: DataFrame, k: int, same: bool, seeds: bool) -> DataFrame:
        """windows is (block, id, label, v, lo, hi, floor)."""
        full = materialize(windows.groupBy("block").applyInArrow(packed_anchors(self.width), PACKED))
        beside = full.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)))).join(small(self.heads, 28 * HEADS_A_CHUNK), "chunk").drop("chunk")
        plan = materialize(beside.mapInArrow(visit_plan(self.c, same, seeds), "block long, list long, bound double"))
        lanes = plan.withColumn("lane", F.pmod(F.xxhash64("list"), F.lit(1 if seeds else self.lanes)).cast("int"))
        anchors = full.select("block", F.col("ids").alias("anchors"), F.col("vectors").alias("anchor_vectors"), "lo", "hi", "floor")
        rows = lanes.join(self.pieces.select("list", "ids", "vectors"), "list").join(anchors, "block")
        tasks = max(8, min(plan.count() // 64, 20_000))
        return rows.repartition(tasks, "block", "lane").sortWithinPartitions("block", "lane", F.desc("bound"), "list").mapInArrow(visits(k), FOUND)

    def search(self, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, window, near, score, rank): the k best rows of each window of each anchor, of its label or of the others.

        anchors is blocks(); windows is (anchor, lo, hi): for each window the least and the largest score.
        """
        rows = anchors.join(windows.withColumnRenamed("anchor", "id"), "id").select("block", "id", "label", "v", "lo", "hi")
        first = materialize(first_k(self._visit(rows.withColumn("floor", F.transform("lo", lambda _: F.lit(LOWEST))), k, same, True), k))
        kth = first.where(F.col("rank") == k).groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
        floor = F.transform("lo", lambda _, w: F.coalesce(F.try_element_at("known", w), F.lit(LOWEST)))
        rest = self._visit(rows.join(kth, "id", "left").withColumn("floor", F.when(F.col("known").isNull(), F.transform("lo", lambda _: F.lit(LOWEST))).otherwise(floor)).drop("known"), k, same, False)
        return materialize(first_k(first.drop("rank").unionByName(rest), k))


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent / 100 of an integer, rounded up or down."""
    x = score * F.lit(-percent if up else percent)
    down = ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    return -down if up else down


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which the condition anchors, on the columns id and label, holds.  An anchor's positives are its first
    `positives` other rows of its label; for each of them the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned.
    """
    rows = materialize(integer_rows(vectors, id_col, vector_col, label_col, scale).withColumn("kind", F.struct("label", "v")))
    total, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    if (longest or 0) >= 2.0**53:
        raise ValueError("scores of these vectors can pass 2^53")
    copy = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    indexed = materialize(rows.withColumn("copy", copy).where(F.col("copy") <= positives + 1).select("id", "label", "v"))
    index = Index(indexed, total, width or 0)
    chosen = materialize(rows.where(anchors).select("id", "kind"))
    first = materialize(chosen.groupBy("kind").agg(F.min("id").alias("anchor")))
    blocks = index.blocks(first.select(F.col("anchor").alias("id"), "kind.label", "kind.v"))

    whole = first.select("anchor", F.array(F.lit(LOWEST)).alias("lo"), F.array(F.lit(HIGHEST)).alias("hi"))
    near = index.search(blocks, whole, positives + 1, True)
    listed = materialize(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "near", "score"))).alias("p")))
    bounds = listed.select("anchor", F.transform("p", lambda p: _share(p["score"], low, True)).alias("lo"), F.transform("p", lambda p: _share(p["score"], high, False)).alias("hi"))
    far = index.search(blocks, bounds, negatives, False)

    found = far.groupBy("anchor", "window").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("near").alias("negative_id"), F.col("score").alias("negative_score")))).alias("n"))
    found = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "n"))).alias("n"))
    both = listed.join(found, "anchor").select("anchor", F.transform("p", lambda p, w: F.struct(p["near"].alias("positive_id"), p["score"].alias("positive_score"), F.try_element_at("n", w).alias("n"))).alias("p"))
    both = first.join(both, "anchor").select("kind", "p")
    each = spread_join(chosen, both, "kind").select(F.col("id").alias("anchor_id"), F.slice(F.filter("p", lambda p: p["positive_id"] != F.col("id")), 1, positives).alias("p"))
    each = each.select("anchor_id", F.explode("p").alias("p")).select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.n").alias("n"))
    return each.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), "n.negative_id", "positive_score", "n.negative_score")
