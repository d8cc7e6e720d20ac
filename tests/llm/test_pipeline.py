"""The stages of corpus_pipeline one after another, each held against plain Python."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_packing import ids_of
from tessera.llm.common import materialize
from tessera.llm.line_dedup import MIN_WORDS
from tessera.llm.quality import MIN_WORDS as LEAST_WORDS
from tessera.llm.queries import CAPACITY


def own(i, n, part=""):
    return " ".join(f"d{i}{part}w{k}" for k in range(n))


LOST, SHARED, ITEM = own("lost", 8), own("shared", 9), own("item", 60)
COPY = own(20, 200)
DOCS = {
    1: LOST,  # too short, so 5 keeps the line
    5: LOST + "\n" + own(5, 40),
    6: (own(6, 8) + " ") * 10,  # repeats itself
    10: own(10, 30) + "\n" + SHARED,
    11: own(11, 30) + "\n" + SHARED,
    12: own(10, 30) + "\n" + SHARED,  # nothing is left of it
    13: own(13, 30) + "\n" + SHARED + "\n" + own(13, 6, "b"),
    20: COPY,
    21: COPY.replace("d20w90", "other"),
    40: own(40, 100) + "\n" + ITEM,
    42: own(42, 100) + "\n" + ITEM,  # the line is gone before it is compared with the item
    43: own(43, 40) + " " + ITEM + " " + own(43, 40, "b"),
    60: own(60, 3000),
}


def quality(docs):
    def repeats(w):
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        return len({j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})

    return {i: t for i, t in docs.items() if len(w := t.split()) >= LEAST_WORDS and 100 * repeats(w) <= 30 * len(w)}


def lines(docs):
    seen, out = set(), {}
    for i, t in docs.items():
        out[i] = "\n".join(x for x in t.split("\n") if x not in seen or len(x.split()) < MIN_WORDS)
        seen.update(t.split("\n"))
    return {i: t for i, t in out.items() if t.strip()}


def near(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs.items() if (w := t.split())}
    return {i: t for i, t in docs.items() if not any(e < i and len(sets[e] & sets[i]) >= 0.8 * len(sets[e] | sets[i]) for e in docs)}


def clean(docs):
    return {i: t for i, t in docs.items() if f" {ITEM} " not in f" {' '.join(t.split())} "}


def packed(docs):
    out = Counter()
    for i, ids in zip(docs, ids_of(docs.values())):
        for k, a in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[a : a + CAPACITY]
            out[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def pieces(df):
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())


def test_stages_and_run(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in DOCS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, want, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), DOCS, []
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:4], (quality, lines, near, clean), strict=True):
        df, want = materialize(stage(spark, df, str(tmp_path))), plain(want)
        assert {r.doc_id: r.text for r in df.collect()} == want
        left.append(set(want))
    assert [a - b for a, b in zip([set(DOCS), *left], left)] == [{1, 6}, {12}, {21}, {40, 43}] and LOST in want[5] and SHARED not in want[11] and ITEM not in want[42]
    want = packed(want)
    assert max(k for _, k, *_ in want) > 0
    assert pieces(corpus_pipeline.packing(spark, df, str(tmp_path))) == want
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == want
