import json
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tessera.llm import tokens
from tessera.llm.common import materialize
from tessera.llm.packing import best_fit_pack, cut_documents, pieces, plan
from tessera.llm.queries import tokenizer_path
from tessera.llm.token_output import RoomTree, best_fit_decreasing, pack_token_ids, write_packed
from tessera.llm.tokens import encoder

LONG = [(960000, " ".join(f"tok{k} piece" for k in range(4000))), (None, "without id"), (900004, "one")]


def ids_of(texts):
    coder = Tokenizer.from_file(tokenizer_path())
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_encoder_equals_tokenizer():
    texts = [t or "" for _, t in cases.ODD] + ["don't I'LL they're. !!a,b.. É.é ﬁ İ ΑΣ. ß á é. ́x ​y <|endoftext|> x<|startoftext|>y. 12,34. ½.²a", "\x00a\x1cb  c d'", "KEY='s 's.", "a'S.", "abc,'s"]
    ids, counts = encoder(tokenizer_path()).encode(texts)
    cut = np.r_[0, np.cumsum(counts)]
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [x[:-1] for x in ids_of(texts)]


def test_encoder_keeps_common_words_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SEGMENTS", 50)
    coder, learned = tokens.WordEncoder(tokenizer_path()), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda found: learned.extend(found) or learn(found))
    texts = [f"common words stay, r{k}x{k} rare{k}. " + " ".join(f"q{k}z{j}" for j in range(20)) for k in range(30)]
    for text, want in zip(texts, ids_of(texts)):
        assert coder.encode([text])[0].tolist() == want[:-1]
        assert max(len(coder.young.segments), len(coder.old.segments)) < 50 + 40
    assert learned.count("common") == learned.count("stay") == 1 and learned.count("q0z0") == 1
    assert coder.encode(texts[:1])[0].tolist() == ids_of(texts[:1])[0][:-1] and learned.count("q0z0") == 2  # long forgotten


def test_cutting_needs_little_memory_beside_its_batch():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(4000), "text": [" ".join(f"word{(k * j) % 997} is" for j in range(1, 200)) for k in range(4000)]})
    assert batch.nbytes > 8 << 20
    cut = pieces(tokenizer_path(), 1, 4096, False)
    list(cut([batch.slice(0, 10)]))  # makes the encoder
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in cut([batch])) == 4000
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_batches_are_bounded_only_where_asked(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    texts = spark.range(3000).selectExpr("id", "repeat('x', 1000) AS text").coalesce(1).mapInArrow(sizes, "n long, size long")
    few = materialize(texts, 1 << 18).collect()
    assert sum(r.n for r in few) == 3000 and len(few) > 8 and max(r.size for r in few) < 1 << 19
    assert [r.n for r in materialize(texts).collect()] == [3000]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 30)  # the session's own bound holds
    try:
        assert [r.n for r in materialize(texts, 1 << 18).collect()] == [3000]
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 1 << 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    r = random.Random(seed)
    draw = [lambda: r.randint(1, 64), lambda: min(64, int(r.lognormvariate(2.5, 1)) + 1), lambda: r.choice([47, 55, 17]), lambda: 1, lambda: 64, lambda: r.randint(20, 62)][seed]
    counts = Counter(draw() for _ in range(400))
    patterns, used = plan(dict(counts), 64), Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    bound = max(-(-sum(a * b for a, b in counts.items()) // 64), sum(n for x, n in counts.items() if x > 32))
    assert sum(t for _, t in patterns) <= bound * 1.12 + 1


def test_best_fit_packing(spark):
    df = cases.documents(spark, LONG)
    rows = df.select("doc_id", "text").collect()
    want = Counter()
    for r, own in zip(rows, ids_of(x.text for x in rows)):
        for k, a in enumerate(range(0, len(own), 512)):
            part = own[a : a + 512]
            want[r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = best_fit_pack(cut_documents(df, tokenizer_path(), capacity=512), 512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= 1.02 * sum(k[3] * n for k, n in want.items()) / 512 + 1
    assert best_fit_pack(cut_documents(cases.empty(spark), tokenizer_path()), 4096).count() == 0


def test_token_output_round_trip(spark, tmp_path):
    df = cases.documents(spark, LONG[:2] + [LONG[0]]).repartition(3, "doc_id")  # one row twice
    packed = pack_token_ids(df, tokenizer_path(), capacity=512)
    folder = tmp_path / "packed"
    index = write_packed(packed, str(folder)).collect()
    manifest = json.loads((folder / "manifest.json").read_text())["parts"]
    assert 1 < len(manifest) <= 3 and sum(p["sequences"] for p in manifest) == len(index) == len({r.sequence_id for r in index})
    ids, at, segments = {}, {}, {}
    for part in manifest:
        for kind, into, suffix in (("<u4", ids, "ids"), ("<u4", at, "positions"), ("<i4", segments, "segments")):
            into[part["name"]] = np.memmap(folder / f"{part['name']}.{suffix}.bin", kind, "r")
            assert zlib.crc32(into[part["name"]]) == part["crc32"][suffix]
    found, sequences = defaultdict(list), []
    for r in index:
        row, places = (x[r.file].reshape(-1, 512)[r.row] for x in (ids, at))
        cuts = segments[r.file][r.segments_start : r.segments_start + r.n_segments + 1].tolist()
        assert cuts[0] == 0 and cuts[-1] == r.n_tokens <= 512 and not row[r.n_tokens :].any() and not places[r.n_tokens :].any()
        assert len(r.doc_ids) == len(r.pieces) == r.n_segments
        sequences.append((r.file, r.row, [b - a for a, b in zip(cuts, cuts[1:])]))
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, cuts, cuts[1:]):
            found[doc, piece].append(row[a:b].tolist())
            assert places[a:b].tolist() == list(range(b - a))
    want = defaultdict(list)
    rows = df.select("doc_id", "text").collect()
    for r, x in zip(rows, ids_of(r.text for r in rows)):
        for piece, a in enumerate(range(0, len(x), 512)):
            want[r.doc_id, piece].append(x[a : a + 512])
    assert found == want and max(map(len, want.values())) == 2
    # placement: longest first, each into the sequence that it leaves the least room in
    for part in manifest:
        own = [sizes for _, _, sizes in sorted(s for s in sequences if s[0] == part["name"])]
        opened = []
        for size in sorted((x for s in own for x in s), reverse=True):
            fits = [s for s in opened if sum(s) + size <= 512]
            if fits:
                max(fits, key=sum).append(size)
            else:
                opened.append([size])
        assert Counter(map(sum, opened)) == Counter(map(sum, own))  # whichever of equal room is taken


def test_token_output_empty(spark, tmp_path):
    none = pack_token_ids(cases.empty(spark), tokenizer_path())
    assert none.count() == 0 and write_packed(none, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        write_packed(none, str(tmp_path / "none"))


def test_room_tree_takes_the_tightest():
    r, tree, room = random.Random(1), RoomTree(100), []
    for k in range(500):
        x = r.randint(0, 100)
        if r.random() < 0.5:
            tree.put(x, k)
            room.append(x)
        else:
            best = min((y for y in room if y >= x), default=None)
            got = tree.take(x)
            assert (got and got[0]) == best
            if best is not None:
                room.remove(best)
    assert best_fit_decreasing([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
