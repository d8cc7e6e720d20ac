"""Spelling variants, toxicity and hard negatives against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm import queries as q
from tessera.llm import spelling, toxicity
from tests.llm.cases import LOW, documents, empty
from tests.oracle import SMALL, connect, same


def counted(docs, thin=97):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    """What spelling_groups() must give for counts n; near words by deleting one code point of each."""
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], form[w], n.get(form[w]), len(near[w]), root))
    return out


def test_one_edit_by_holes():
    n = dict.fromkeys(["abcde", "abcdef", "abxde", "bacde", "abcd", "zabcde"], 3)
    got = grouped(n)
    for w, _, _, _, count, _ in got:
        assert count == sum(one_edit(w, x) for x in n if x != w)


def test_spelling_variants(spark):
    extra = [(900100 + k, t) for k, t in enumerate(["hello hellp hello jello hello hellp hellp jello jello helloo helloo helloo " * 3, "colour color " * 40 + "colours " * 90, "straße Straße STRASSE strasse " * 5, "xhello yhello abcde×f " * 3, "aaaaa aaaaaa aaaaaaa " * 7, "abcde abcdf abcdg abced " * 3])]
    extra += [(None, "without without without identity identity"), (900100, "hello again again again")]
    docs = documents(spark, extra)
    got = {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in spelling.spelling_variants(docs, thin=97).collect()}
    want = grouped(counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert got == want and len(got) > 500 and any(x[2] and x[5] != x[2] for x in got)


def test_spelling_chain(spark):
    """A chain of forms longer than two jumps, and words that share one parity mask."""
    rows = [("aaaaa" + "b" * k, 3 << k) for k in range(9)] + [("abcdefgh", 4), ("hgfedcba", 4), ("abcdefg", 9)]
    n = dict(rows)
    got = {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == grouped(n)
    assert {x[5] for x in got if x[0].startswith("aaaaa")} == {"aaaaabbbbbbbb"}


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), thin=97).count() == 0


def test_hard_negatives_equal_their_sql(spark):
    same(q.hard_negative_mining(spark, SMALL), connect(), q.NEGATIVES_SQL)


def mined(rows, positives=5, negatives=3):
    v = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = (label, [int(np.floor(256 * float(c))) for c in x])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in v:
        if a % 50 == 0:
            scores = sorted((-dot(v[a][1], v[b][1]), b) for b in v if b != a)
            for s, p in [x for x in scores if v[x[1]][0] == v[a][0]][:positives]:
                hits = [(t, b) for t, b in scores if v[b][0] != v[a][0] and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
                out |= {(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(hits)}
    return out


@pytest.mark.parametrize("pieces", [1, 64])
def test_hard_negatives(spark, monkeypatch, pieces):
    """Copies of one vector in two labels, ties, zero vectors, bad rows; with one list a label and with many."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(hn, "ROWS_A_CENTROID", 1200 // pieces)
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "LISTS_A_LANE", 8)
    hub = rng.normal(size=6)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=6) + (hub if k % 3 else 0), 1)], int(k % 4)) for k in range(700)]
    rows += [(1000 + k, [float(x) for x in hub], 2 if k % 2 else 3) for k in range(400)]
    rows += [(2000, [0.0] * 6, 1), (2050, [0.0] * 6, 1), (2051, [0.0] * 6, 0), (2100, [1.0], 1), (2150, [], 0)]
    rows += [(3000, None, 1), (3050, [float("nan")] * 6, 1), (3100, [None] * 6, 1), (3150, [float("inf")] * 6, 1), (3200, [9.0] * 6, None), (None, [9.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0)).withColumn("v", F.lit(0)).withColumn("block", F.lit(0))
    df = df.unionByName(df.where("vec_id < 60"))
    got = {tuple(r) for r in hn.hard_negatives(df, F.col("id") % 50 == 0).collect()}
    want = mined([(i, None if x is None else [None if c is None else np.float32(c) for c in x], y) for i, x, y in rows])
    assert got == want and len(got) > 100


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(none, F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1)], none.schema)
    assert hn.hard_negatives(one, F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([(50, [1e30], 1)], none.schema), F.col("id") % 50 == 0)


WORDS = "the of river stone garden window quiet yellow paper morning letter number".split()
BAD = "horrible dreadful".split()


def _labelled(spark):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for k in range(600):
        text = [str(x) for x in rng.choice(WORDS, rng.integers(1, 400))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text[rng.integers(len(text))] = str(rng.choice(BAD))
        rows.append((k, " ".join(text)))
        marks.append((k, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = _labelled(spark)
    held = F.col("doc_id") % 4 == 2
    model = toxicity.train_toxicity(docs, labels.where(~held))
    found = toxicity.score_toxicity(docs, model).where(held).join(labels, "doc_id").collect()
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in found)
    assert right >= 0.97 * len(found)
    odd = [(1, "river garden Horribel"), (2, "river garden dreadfull " + " ".join(WORDS * 2000)), (3, "river garden"), (4, None), (5, ""), (6, " \n"), (None, "horrible"), (8, "horrible"), (8, "river"), (9, "x" * 2_000_000)]
    scores = [(r.doc_id, r.score) for r in toxicity.score_toxicity(spark.createDataFrame(odd, docs.schema).withColumn("score", F.lit("s")), model).collect()]
    assert [s >= 0.3 for _, s in scores] == [True, True, False, False, False, False, True, True, False, False]
    assert scores[3][1] == scores[4][1] == scores[5][1]


def test_toxicity_labels_held_out_are_not_learned(spark):
    """The query's scores don't change with the labels of the held-out rows."""
    rows = q.toxicity(spark, SMALL).collect()
    assert {r.held_out for r in rows} == {True, False} and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_toxicity_without_labels(spark):
    docs, labels = _labelled(spark)
    for marks, want in ((labels.where("false"), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        model = toxicity.train_toxicity(docs, marks)
        assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {want}
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
