"""Decontamination, secrets, quality rules and chat formatting."""

import math
import re
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tests.oracle import SMALL, connect, same
from tessera.llm import decontamination, quality
from tessera.llm.chat import dialogues, perspective_turns
from tessera.llm.decontamination import RADIUS, contaminated, decontaminate
from tessera.llm.queries import oracle_sql, queries
from tessera.llm.secrets import BASE, RULES, find_secrets, spans_text, trigram_query


def test_decontamination(spark):
    low = lambda t: cases.words((t or "").translate(cases.LOW))
    passage = cases.words(cases.PASSAGE)
    extra = [(940000 + k, " ".join([*passage[:k], "other", *passage[k + 1 :]])) for k in (0, 7, 30, 59)] + [(950000, "x " + " ".join(passage[:52])), (950001, " ".join(passage[10:]))]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(spark.createDataFrame([(7001, cases.PASSAGE.upper()), (7002, None), (7003, ""), (7004, "one two"), (7005, cases.PASSAGE)], "item_id long, text string"))
    df = cases.documents(spark, extra)
    docs = {i: low(t) for i, t in cases.texts(df).items()}
    bench = {r.item_id: low(r.text) for r in items.collect()}
    shingles = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for b, w in bench.items():
        k = min(5, len(w))
        own = shingles(w, k) if w else None
        for d, x in docs.items() if w else ():
            best = None
            for at in range(max(1, len(x) - len(w) + 1)):
                here = shingles(x[at : at + len(w)], k)
                shared, total = sum((here & own).values()), sum((here | own).values())
                if 10 * shared >= 8 * total and (best is None or shared / total > best[1]):
                    best = (at, shared / total)
            if best:
                want[d, b] = best
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in contaminated(df, items).collect()}
    assert len(want) > 8 and RADIUS == 16 and got == want
    left = decontaminate(df, items)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(docs) - {d for d, _ in want}
    assert contaminated(cases.empty(spark), items).count() == 0 and contaminated(df, items.limit(0)).count() == 0


def test_windows_are_broadcast_by_their_size(spark, monkeypatch):
    at = spark.range(10).selectExpr("id AS doc_id", "array(named_struct('n', 8, 'size', 5, 'starts', sequence(0, 9999))) AS at")
    plan = lambda: spark.range(10).withColumnRenamed("id", "doc_id").join(decontamination._measured(at), "doc_id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 400_000)  # ten rows, but 10,000 starts in each
    assert "broadcast" not in plan()


def test_trigram_queries():
    assert trigram_query("abcd") == ("and", "abc", "bcd") and trigram_query("[0-9a-f]+") is None and trigram_query("(abc|xyz)?") is None
    assert trigram_query("(abc|xyz)[0-9]+") == ("or", "abc", "xyz") and trigram_query("a[0-9]+bcd") == "bcd" and trigram_query("(?i:KEY)") == "key"


def test_secrets(spark):
    df = cases.documents(spark, [(None, "token=abcdef1"), (900014, "ghp_" + "b" * 36)]).select("doc_id", "text", "rules")
    rows = find_secrets(df).select("doc_id", spans_text(F.col("spans")).alias("s")).collect()
    want = Counter()
    for r in df.collect():
        found = []
        for k, rule in enumerate(RULES):
            pattern, least = ("[0-9a-f]+", 24) if rule.kind == "hex" else (rule.pattern, rule.least)
            found += [(m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, r.text or "") if len(m.group(rule.group)) >= least]
        want[r.doc_id, ",".join(x[2] for x in sorted(found))] += 1
    assert Counter((r.doc_id, r.s) for r in rows) == want and len(BASE) == 3
    assert find_secrets(cases.empty(spark)).count() == 0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_quality_rules(spark):
    df = cases.documents(spark, [(900012, "repeated row")])
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (900009, None, None), (900009, 1, 0)], "doc_id long, quality int, toxic int"))
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]

    def grams(w):
        h = [_signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
        two = lambda a, b: _signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
        return [x % quality.BUCKETS for x in h] + [two(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]

    raw, target, own = Counter(), Counter(), []
    for i, t in rows:
        own.append(grams(cases.words(t)))
        raw.update(own[-1])
        target.update(own[-1] if i in trusted else ())
    rho = target.total() / raw.total()
    want = []
    for (i, t), g in zip(rows, own):
        w = cases.words(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = len({j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        lines = [x for x in t.split("\n") if re.search(cases.WORD, x)]
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        score = sum(math.log((target[b] + 32 * rho) / ((raw[b] + 32) * rho)) for b in g) / len(g) if g else None
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), repeat, failed, not failed and score >= quality.THRESHOLD))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality_scores(df, labels).collect()]
    assert sorted(got) == sorted(want)
    assert quality.quality_scores(cases.empty(spark), labels).count() == 0
    none = quality.quality_scores(df, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.quality_filter(df, labels).columns == df.columns


def test_chat_query(spark):
    same(queries()["op8_chat_formatting"](spark, SMALL), connect(), oracle_sql()["op8_chat_formatting"])


def test_chat_odd_rows(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 600, "ann", "é!"), (1, 2, "bob", None), (None, 1, None, "x"), (2, 1, "system", "alone"), (3, None, "eve", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).withColumn("before", F.lit(1))
    out = perspective_turns(df)
    assert out.groupBy("conv_id", "perspective").count().count() == 4
    for d in dialogues(out).collect():
        own = sorted((r for r in out.collect() if (r.conv_id, r.perspective) == (d.conv_id, d.perspective)), key=lambda r: r.start)
        assert d.text == "".join(r.segment for r in own) and own[0].start == 0 and all(a.end == b.start for a, b in zip(own, own[1:]))
        masked = [d.text[m.start : m.end] for m in d.mask]
        assert masked == [(r[3] or "") + "<|im_end|>\n" for r in rows if r[0] == d.conv_id and (r[2] or "unknown") == d.perspective]
    assert perspective_turns(df.limit(0)).count() == 0


def test_ids_need_not_be_unique_in_benchmark(spark):
    items = spark.createDataFrame([(1, cases.PASSAGE), (1, cases.PASSAGE)], "item_id long, text string")
    found = defaultdict(int)
    for r in contaminated(cases.documents(spark), items).collect():
        found[r.doc_id, r.item_id] += 1
    assert set(found.values()) == {1} and {d for d, _ in found} == {900009, 900010, 900011}
