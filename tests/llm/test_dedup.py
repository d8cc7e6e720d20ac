import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tessera.llm import suffix_dedup as construction
from tessera.llm.common import shared_dir, shared_path
from tessera.llm.components import connected_components
from tessera.llm.line_dedup import MIN_WORDS, RARE, line_dedup, patience, without_repeated_lines
from tessera.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import suffix_dedup


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked(docs, size, num=80, den=100):
    sets = {}
    for i, t in docs.items():
        w = cases.words((t or "").translate(cases.LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    shared, places, out = Counter(), defaultdict(list), Sets()
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    for ids in places.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            out.join(a, b)
    return sets, out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    base = cases.PASSAGE.split()
    more = [(910000 + k, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :])) for k in range(0, 60, 3)] + [(920000 + k, " ".join(base[:k] + ["e1", "e2"] + base[k + 2 : 40] + [f"z{k}"] + base[41:])) for k in range(5)]
    df = cases.documents(spark, more)
    sets, groups = linked(cases.texts(df), size)
    got = {r.doc_id: r for r in near_duplicates(df, size=size).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    df = cases.documents(spark)
    assert drop_near_duplicates(df).columns == df.columns


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (200, 200), (300, 301), (302, 301), (302, 303)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200, 300: 300, 301: 300, 302: 300, 303: 300}


def test_substring_dedup(spark):
    df = cases.documents(spark)
    docs, seen, want = cases.texts(df), set(), {}
    for i in sorted(docs):
        w = cases.words(docs[i])
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=20).collect()} == want


def test_suffix_dedup(spark):
    df = cases.documents(spark)
    docs = {i: (t or "").encode() for i, t in cases.texts(df).items()}
    count = Counter(b[k : k + 200] for b in docs.values() for k in range(len(b) - 199))
    want = {}
    for i, b in docs.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup(df, window=200).collect()}
    assert got == want


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup, line_dedup])
def test_odd_tables(spark, dedup):
    assert dedup(cases.empty(spark)).count() == 0
    text = "\n".join(" ".join(f"line{k} word{j}" for j in range(30)) for k in range(4))
    rows = [(1, text), (None, text), (2, text), (2, text)]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.doc_id or -1, r.n_removed > 0) for r in got)
    assert removed == [(-1, False), (1, dedup is suffix_dedup), (2, True), (2, True)]


def test_patience():
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert patience([5, 1, 2, 5], [1, 2]) == [(1, 0), (2, 1)]
    assert patience([0, 0], [0, 0]) == [] and patience([], [1]) == []


def keys_of(own):
    """The anchors of a document: its long lines, and adjacent lines of text of which one is long."""
    text = [x for x in own if x]
    long = lambda x: len(cases.words(x)) >= MIN_WORDS
    return {x for x in text if long(x)} | {(x, y) for x, y in zip(text, text[1:]) if long(x) or long(y)}


def earlier(i, own, have):
    found = set()
    for x in keys_of(own):
        found.add(min(have[x]))
        if len(have[x]) <= RARE:
            found.update(sorted(e for e in have[x] if e < i)[-1:])
    return found - {i}


def diffed(a, b, at=0, to=0):
    """Patience diff, by its definition: equal ends, else the longest chain of lines that occur once in both, else nothing."""
    if not a or not b:
        return set()
    if a[0] == b[0] != 0:
        return {(at, to)} | diffed(a[1:], b[1:], at + 1, to + 1)
    if a[-1] == b[-1] != 0:
        return {(at + len(a) - 1, to + len(b) - 1)} | diffed(a[:-1], b[:-1], at, to)
    once = [(i, b.index(x)) for i, x in enumerate(a) if x and a.count(x) == 1 and b.count(x) == 1]
    rank = lambda c: (len(c), -c[-1][1] if c else 0)  # noqa: E731  of chains of one length, that which ends first in b
    longest = []
    chains = {}
    for i, j in once:
        chains[i, j] = max((c for (_, k), c in chains.items() if k < j), key=rank, default=[]) + [(i, j)]
        longest = max(longest, chains[i, j], key=rank)
    out = {(at + i, to + j) for i, j in longest}
    edges = [(-1, -1), *longest, (len(a), len(b))]
    return out.union(*(diffed(a[i + 1 : k], b[j + 1 : m], at + i + 1, to + j + 1) for (i, j), (k, m) in zip(edges, edges[1:]))) if longest else out


def thue_morse(n, one, two):
    return "".join(one if bin(k).count("1") % 2 else two for k in range(n))


def test_words_of_equal_sums_are_told_apart(spark):
    """Words by the Thue-Morse rule and their complements: a polynomial modulo 2^64 has one hash for both."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    frame = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    twenty = " ".join(f"w{k}" for k in range(19))
    assert {r.n_removed for r in substring_dedup(frame(f"{x} {twenty}", f"{y} {twenty}"), window=20).collect()} == {0}
    assert {r.component_id for r in near_duplicates(frame(x, y)).collect()} == {1, 2}
    assert {r.n_removed for r in line_dedup(frame(f"{x} has four more words", f"{y} has four more words")).collect()} == {0}
    assert sorted(r.n_removed for r in line_dedup(frame(f"{x} has four more words", f"{x} has four more words")).collect()) == [0, 1]


def test_lines_of_a_copy_with_older_long_lines(spark):
    """A copy's short line goes too, though all its long lines have an older first document."""
    first, second = "the first long line is here", "the second long line is here"
    rows = [(1, f"{first}\nother\n{second}"), (2, f"{first}\nshort a\n{second}"), (3, f"{first}\nshort a\n{second}")]
    many = rows + [(10 + k, rows[1][1]) for k in range(RARE + 5)]
    for docs in (rows, many):
        got = {r.doc_id: r.kept_text for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got.pop(1) == rows[0][1] and got.pop(2) == "short a" and set(got.values()) == {""}


def test_line_dedup(spark):
    common = "a line that rather many documents have"
    more = [(930000 + k, f"own first line of document {k} here\n{common}\n\nshort\nthe block of two lines is shared\nby all of these documents too") for k in range(5)]
    df = cases.documents(spark, more)
    docs = {i: (t or "") for i, t in cases.texts(df).items()}
    lines = {i: [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] if t else [] for i, t in docs.items()}
    anchor = lambda x: len(cases.words(x)) >= MIN_WORDS
    have, code = defaultdict(set), {"": 0}
    for i, own in lines.items():
        for x in own:
            code.setdefault(x, len(code))
        for x in keys_of(own):
            have[x].add(i)
    want = {}
    for i, own in lines.items():
        gone = set()
        for e in earlier(i, own, have):
            match, k = sorted(diffed([code[x] for x in own], [code[x] for x in lines[e]])), 0
            while k < len(match):
                m = k
                while m + 1 < len(match) and match[m + 1] == (match[m][0] + 1, match[m][1] + 1):
                    m += 1
                block = range(match[k][0], match[m][0] + 1)
                gone.update(block if any(anchor(own[z]) for z in block) else ())
                k = m + 1
        raw = docs[i].split("\n") if docs[i] else []
        want[i] = (len(raw), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in gone))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text or "") for r in line_dedup(df).collect()} == want
    left = without_repeated_lines(df)
    assert left.columns == df.columns
    kept = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert kept[930001] == ("own first line of document 1 here\n", 34) and kept[900001] == (None, 7)
    assert set(kept) == {i for i, (n, gone, t) in want.items() if not gone or t.strip(" \t\n\x0b\x0c\r")}


def test_lines_of_very_many_documents(spark):
    """Each repeated line goes, also where many documents have it and the document's rare line leads to one without it."""
    hot = ["the first line that very many documents have", "the second line that very many documents have"]
    rare = [f"the rare line number {k} of two documents" for k in range(RARE + 6)]
    rows = [(1, hot[0]), (2, hot[1])] + [(100 + k, x) for k, x in enumerate(rare)]
    rows += [(1000 + k, "\n".join([hot[0], f"own words of the document numbered {k}", x, hot[1], "short end"])) for k, x in enumerate(rare)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, seen = {}, set()
    for i, text in rows:
        lines = text.split("\n")
        # the short end follows a shared line in the document 1000 already
        kept = [x for x in lines if x not in seen or (len(x.split()) < MIN_WORDS and i <= 1000)]
        seen.update(lines)
        want[i] = (len(lines) - len(kept), "\n".join(kept))
    assert got == want and want[1001] == (4, "own words of the document numbered 1")


def test_construction_files_are_bounded_in_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(construction, "SPOOL_BYTES", 1000)
    for folder in (None, str(tmp_path)):
        held = construction.Collection(200, 50, folder)
        held.columns.write(b"x" * 1001)
        held.places.write(b"x" * 1000)
        assert held.columns._rolled and not held.places._rolled
    assert shared_path(spark) == "/" + shared_dir(spark).removeprefix("file:").lstrip("/")
