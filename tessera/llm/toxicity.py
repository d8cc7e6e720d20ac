"""Toxicity by subword-bag embeddings and a linear softmax.

1. A word's vector is the mean of the embeddings of its parts: the word itself and its byte n-grams (GRAMS, with < and >
   around the word), hashed into BUCKETS rows.  So a misspelling that was never seen shares most of its parts.
2. A text is cut into segments of SEGMENT words; a segment's vector is the mean of its words' (a short last one is filled up
   with zero vectors), and a linear softmax over two classes gives its score.  A text scores as its worst segment does, so a
   few words count the same in a short and in a very long text.
3. Embeddings and softmax are trained jointly in numpy, by full gradients: first every segment is taken to have the text's
   label (mean of the segments), then only the worst segment.  Both classes' gradients of a part's embedding are a
   multiple of the difference of the two softmax rows, so a step needs one number for each part, not one vector.
4. Scoring needs one number for each bucket (its embedding times that difference), sent with the task: 8 bytes x BUCKETS.

Fitting takes at most FIT_ROWS labelled texts of each class, those of least hash of their id, and none longer than FIT_CHARS.
Scoring reads every text whole.

Rows: null and empty texts have no segment and score as the bias alone does.  Labels that are null, or of a null doc_id, are not
learned; of several labels of a document the largest counts.  Rows that repeat a doc_id are scored each by its own text.
Without labelled texts of both classes every text scores as the share of toxic labels, 0 without any.  An empty table gives an
empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, keyed, mix, range_hashes, string_buffers, words

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
SEGMENT = 4
DIMENSIONS = 8
FIT_ROWS, FIT_CHARS = 2500, 32_768
#: Parts that occur less often in the fitted texts keep a zero embedding.
LEAST = 5
WORDS_AT_ONCE = 1 << 16
#: DAMPING is what a slope must exceed for a full step, so that parts of one or two texts hardly move.
STEPS, RATE, DECAY, DAMPING = 150, 0.05, 1e-5, 3e-5
FITTED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])


@dataclass
class Model:
    """embeddings (BUCKETS x DIMENSIONS) and the softmax (weights 2 x DIMENSIONS, bias 2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def values(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1, and the log-odds of no words at all."""
        return self.embeddings @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])


def parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket, word) arrays, one pair for each size of part: the buckets of the parts of words, which are bytes of data."""
    if not len(starts):
        return
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    yield (range_hashes(data, starts, ends) >> shift).astype(np.int32), np.arange(len(starts), dtype=np.int32)
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    padded = data[np.minimum(np.arange(len(word)) - first[word] + starts[word] - 1, len(data) - 1)].astype(np.uint64)
    padded[first], padded[first + lengths - 1] = ord("<"), ord(">")
    hashes = padded + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        hashes = hashes[: len(padded) - n + 1] * np.uint64(0x100000001B3) + padded[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = np.flatnonzero(word[: len(hashes)] == word[n - 1 :])
            yield (mix(hashes[inside] + np.uint64(n << 56)) >> shift).astype(np.int32), word[inside]


def part_counts(lengths: np.ndarray) -> np.ndarray:
    """How many parts words of these byte lengths have."""
    return 1 + sum(np.maximum(lengths + 2 - n + 1, 0) for n in GRAMS)


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every segment, and its text; first are the texts' first words, with the total at the end."""
    count = -(-np.diff(first) // SEGMENT)
    text = np.repeat(np.arange(len(count)), count)
    return first[:-1][text] + SEGMENT * (np.arange(len(text)) - (np.cumsum(count) - count)[text]), text


def log_odds(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds of each text's worst segment."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    out = np.full(len(offsets) - 1, bias)
    if len(starts):
        total = np.zeros(len(starts))
        for bucket, word in parts(data, starts, ends):
            total += np.bincount(word, values[bucket], len(starts))
        begin, text = segments(first)
        some = np.flatnonzero(np.diff(first))
        out[some] += np.maximum.reduceat(np.add.reduceat(total / part_counts(ends - starts), begin), np.searchsorted(text, some)) / SEGMENT
    return out


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 11) -> Model:
    """Train on texts with labels 0 and 1, of which both must occur."""
    data, offsets = string_buffers(texts)
    data = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends, first = words(data, offsets - offsets[0])
    _, at, token = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    token = token.astype(np.int32)

    def made():
        """The parts of the distinct words, some words at a time."""
        for lo in range(0, len(at), WORDS_AT_ONCE):
            for bucket, word in parts(data, starts[at[lo : lo + WORDS_AT_ONCE]], ends[at[lo : lo + WORDS_AT_ONCE]]):
                yield bucket, word + np.int32(lo)

    uses = np.bincount(token, minlength=len(at))
    often = sum(np.bincount(bucket, uses[word], BUCKETS) for bucket, word in made()) >= LEAST
    kept = [(bucket[often[bucket]], word[often[bucket]]) for bucket, word in made()]
    bucket, word = (np.concatenate([x[k] for x in kept]) for k in (0, 1))
    del kept
    share = 1.0 / part_counts(ends[at] - starts[at])
    begin, text = segments(first)
    segment = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.r_[begin, len(starts)]))
    rows = np.flatnonzero(np.diff(first))
    edge = np.searchsorted(text, rows)
    many = np.diff(np.r_[edge, len(begin)])
    wanted = toxic[rows].astype(float)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (2, DIMENSIONS)), np.zeros(2))
    held = [model.embeddings, model.weights, model.bias]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in held]
    for step in range(1, STEPS + 1):
        values, bias = model.values()
        own = np.bincount(word, values[bucket], len(at)) * share
        odds = np.add.reduceat(own[token], begin) / SEGMENT
        if step <= STEPS // 3:  # the mean of the segments
            each = np.ones(len(begin)) / np.repeat(many, many)
            z = np.add.reduceat(odds, edge) / many + bias
        else:
            worst = np.maximum.reduceat(odds, edge)
            z = worst + bias
            each = (odds == np.repeat(worst, many)).astype(float)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - wanted) / len(rows)
        by_segment = np.repeat(error, many) * each / SEGMENT
        touched = np.flatnonzero(by_segment[segment])
        by_word = np.bincount(token[touched], by_segment[segment[touched]], len(at)) * share
        by_bucket = np.bincount(bucket, by_word[word], BUCKETS)
        down = model.embeddings.T @ by_bucket
        slopes = [np.outer(by_bucket, model.weights[1] - model.weights[0]) + DECAY * model.embeddings, np.stack([-down, down]), np.array([-error.sum(), error.sum()])]
        for x, g, (m, v) in zip(held, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + (DAMPING if x is model.embeddings else 1e-8))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """What log_odds() needs of a model fitted on labelled docs: values of the buckets, and the bias.

    One task fits the model on the texts taken, 2 * FIT_ROWS of FIT_CHARS each at most; only what it returns comes to the driver.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    taken = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS) for k in (0, 1)]
    taken = taken[0].unionByName(taken[1])
    rows = keyed(docs, id_col, text_col).join(F.broadcast(taken), F.col("doc_id") == F.col("id")).where(F.length("text") <= FIT_CHARS)

    def run(batches):
        found = pa.Table.from_batches(list(batches), FITTED).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        toxic = found.column("toxic").to_numpy()
        share = float(toxic.mean()) if len(toxic) else 0.0
        if 0 < share < 1:
            values, bias = fit(found.column("text"), toxic).values()
        else:
            values, bias = np.zeros(BUCKETS), np.inf if share else -np.inf
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([bias])], ["values", "bias"])

    # rows that repeat an id can't make it more
    rows = rows.select("doc_id", "text", "toxic").limit(4 * FIT_ROWS).repartition(1)
    made = rows.mapInArrow(run, "values binary, bias double").first()
    return (np.frombuffer(made["values"], np.float64), made["bias"]) if made else (np.zeros(BUCKETS), -np.inf)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs; score is the probability of class 1."""
    values, bias = model

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-log_odds(data, offsets, values, bias)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], ["doc_id", "score"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
