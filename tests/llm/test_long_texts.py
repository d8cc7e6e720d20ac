"""Texts longer than a chunk (1 MiB) and a slice (4 MiB) of the kernels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.packing import best_fit_pack, cut_documents
from tessera.llm.queries import tokenizer_path
from tessera.llm.substring_dedup import substring_dedup

EDITS = range(40_000, 860_000, 50_000)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two texts of 5 MiB that differ in a few words, and short ones before and after them."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k:x}" for k in rng.integers(1 << 8, 1 << 16, 6000)]
    words = [vocabulary[k] for k in rng.integers(0, 6000, 900_000)]
    other = list(words)
    for k in EDITS:
        other[k] = f"edit{k}"
    text = lambda w: "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
    rows = [(1, "a short text before"), (2, text(words)), (3, text(other)), (4, "and one after"), (5, None)]
    assert len(rows[1][1]) > 5 << 20
    return spark.createDataFrame(rows, "doc_id long, text string"), words, other


def test_near_duplicates(long_docs):
    df, words, other = long_docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=4).collect()}
    count = lambda w: len(set(zip(w, w[1:], w[2:], w[3:])))
    assert got == {1: (1, 1), 2: (count(words), 2), 3: (count(other), 2), 4: (1, 4), 5: (0, 5)}


def test_line_dedup(long_docs):
    df, words, _ = long_docs
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup(df).collect()}
    lines = len(words) // 12
    assert got[3] == (lines, lines - len({k // 12 for k in EDITS})) and got[2] == (lines, 0)


def test_substring_dedup(long_docs):
    df, words, other = long_docs
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df, window=20).collect()}
    assert got[3] == (len(other), len(other) - len(EDITS)) and got[2] == (len(words), 0)


def test_packing_loses_no_token(long_docs):
    from tokenizers import Tokenizer

    df, words, other = long_docs
    path = tokenizer_path()
    rows = best_fit_pack(cut_documents(df, path, capacity=4096), 4096).collect()
    ids = Tokenizer.from_file(path).encode(df.where("doc_id = 3").first().text, add_special_tokens=False).ids + [1]
    pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 3)
    assert pieces == [(k, k * 4096, len(ids[k * 4096 : k * 4096 + 4096]), zlib.crc32(np.array(ids[k * 4096 : k * 4096 + 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]


def test_word_counts(long_docs):
    df, words, other = long_docs
    got = {r.word: r.n for r in spelling.word_counts(df.select("doc_id", F.translate("text", "0123456789", "ghijklmnop").alias("text")), thin=0).collect()}
    want = {}
    for w in [*words, *other]:
        w = w.translate(str.maketrans("0123456789", "ghijklmnop"))
        want[w] = want.get(w, 0) + 1
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
