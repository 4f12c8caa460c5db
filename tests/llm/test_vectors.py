"""Whitening, byte-level BPE and hard negatives against brute force."""

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from mixscreen.llm import byte_bpe, common, hard_negatives, whitening

VECTORS = "vec_id long, label long, x array<long>"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def clouds(seed, n, d, labels=4, spread=300):
    r = np.random.default_rng(seed)
    centres = r.integers(-spread, spread, (labels, d))
    return [(k, int(own := r.integers(labels)), (centres[own] + r.integers(-spread // 2, spread // 2, d)).tolist()) for k in range(n)]


def test_whole_numbers(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (None, [-0.0, 2.0]), (7, [3e38, -3e38])]
    got = {r.vec_id: r.x for r in common.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id").collect()}
    assert got == {1: [128, -1], None: [0, 512], 7: [2**63 - 1, -(2**63)]}


def whitened(spark, rows, most=4):
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    return sorted(whitening.whiten(df.withColumn("N", F.lit("x")).repartition(3), most).collect(), key=lambda r: (str(r.vec_id), r.component, r.deviation or 0))


@pytest.mark.parametrize("scale", [1, 10**6])
def test_whitening(spark, scale):
    r = np.random.default_rng(5)
    x = (r.normal(size=(200, 6)) @ np.diag([900, 500, 250, 120, 60, 30]) @ np.linalg.qr(r.normal(size=(6, 6)))[0] * scale + 10_000 * scale).astype(np.int64)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[3].tolist()) for k in range(300)] + [(None, x[4].tolist())]
    got = whitened(spark, rows)
    assert len(got) == 4 * len(rows) and {g.n for g in got} == {200}
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = {k: (x[k] - x.mean(axis=0)) @ v / np.sqrt(e) for k in range(200)}
    own = {(g.vec_id, g.component): g for g in got}
    for c in range(1, 5):
        sign = np.sign(own[(0, c)].whitened * want[0][c - 1])
        assert all(abs(own[(k, c)].whitened * sign - want[k][c - 1]) < 1e-7 for k in range(200))
        assert abs(own[(0, c)].explained / (e[c - 1] / e.sum()) - 1) < 1e-9 and own[(0, c)].identity_error < 1e-9
        assert own[(1299, c)].whitened == own[(3, c)].whitened and own[(None, c)].whitened == own[(4, c)].whitened
    exact = [sum((200 * int(a) - int(s)) ** 2 for a, s in zip(v, x.sum(axis=0), strict=True)) for v in x]
    assert all(own[(k, 1)].deviation == (exact[k] if exact[k] < 2**63 else None) for k in range(200))


def test_whitening_of_few(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [])]) == []
    one = whitened(spark, [(1, [5, 6]), (2, [5, 6])])
    assert [(g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    flat = whitened(spark, [(k, [k, 2 * k, 7]) for k in range(5)])
    assert {g.whitened is None for g in flat if g.component == 1} == {False} and {g.whitened for g in flat if g.component > 1} == {None}
    assert abs(flat[0].explained - 1) < 1e-9 and flat[0].identity_error < 1e-9
    assert len(whitened(spark, [(1, [2**62, 0]), (2, [-(2**62), 1]), (3, [0, 5])])) == 6
    with pytest.raises(ValueError, match="entries"):
        whitened(spark, [(1, [1]), (2, [1, 2])])


def test_cholesky_of_ill_conditioned_rows():
    r = np.random.default_rng(1)
    a = r.normal(size=(500, 8)) @ np.diag(10.0 ** -np.arange(8)) @ np.linalg.qr(r.normal(size=(8, 8)))[0]
    q, whole = a, np.eye(8)
    for k in range(4):
        g = q.T @ q
        own = whitening.cholesky(g, (1 if k else -1) * 1e-12 * np.linalg.norm(g, 2))
        q, whole = whitening.solved(q, own), own @ whole
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-13 and np.abs(q @ whole - a).max() < 1e-13
    assert np.allclose(np.linalg.svd(whole)[1], np.linalg.svd(a)[1], rtol=1e-8)


@pytest.fixture(scope="module")
def encoding():
    lines = (line.split() for line in Path(PATH).read_bytes().split(b"\n") if line)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def texts():
    r = random.Random(3)
    letters = ["abcdefghij", "äöüßéèñ", "Ωλж字日本語한국", "0123456789", " \t\n\r 　", "'s't!?.,;{}", "😀👩‍👩‍👧🏽", "\x00\x1c\x7f‍﻿"]
    out = ["", " ", "  ", "\n", "I'll we've 'S", "a" * 700, " " * 3000, "<|endoftext|> x", "word " * 400, "ab" * 400 + "c" * 900, "x\r\n\r\n y   z"]
    out += ["".join(r.choice(r.choice(letters)) for _ in range(r.randrange(1, 200))) for _ in range(300)]
    return out + ["".join(r.choice("qxzjvkwy") for _ in range(1500)), "\n".join("lorem ipsum dolor" for _ in range(9000))]


def test_bpe(spark, encoding, monkeypatch):
    own = texts()
    rows = [(k, t, "en") for k, t in enumerate(own)] + [(None, None, None), (3, own[9], None), (3, own[9], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(2)
    out = byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, PATH), PATH).collect()
    want = sorted((str(k), encoding.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in out) == want
    assert byte_bpe.bpe_encode(df.limit(0), PATH).count() == 0
    for most in (1, 7, 50):  # cut texts, small groups, small batches
        monkeypatch.setattr(byte_bpe, "TOGETHER", most)
        monkeypatch.setattr(byte_bpe, "PASSED", 40 * most)
        monkeypatch.setattr(byte_bpe, "REMEMBERED", most)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own)], ["doc_id", "text"])
        got = [x for b in byte_bpe._encoded(PATH, public_tokenizers.PATTERN)(iter([batch])) for x in b.to_pylist()]
        assert [g["doc_id"] for g in got] == list(range(len(own))) and all(g["ids"] == encoding.encode_ordinary(t) for g, t in zip(got, own, strict=True))


def test_bpe_merges(encoding):
    own, r = byte_bpe.vocabulary(PATH), random.Random(8)
    tokens = list(own.ranks)
    pieces = [b"".join(r.choice(tokens) for _ in range(r.randrange(2, 40))) for _ in range(300)] + [bytes(r.randrange(256) for _ in range(n)) for n in (2, 3, 64, 65, 511, 513, 2000)]
    for piece, ids in zip(pieces, own.encode(pieces), strict=True):
        want = encoding._core_bpe.encode_single_piece(piece)
        assert np.frombuffer(ids, np.int32).tolist() == want
        if piece not in own.ranks:
            assert np.frombuffer(own.one(piece), np.int32).tolist() == want
    one = own.together([b"zq" * 30, b"the", b"qqqq"], 64)  # in one matrix whatever the lengths
    assert [np.frombuffer(x, np.int32).tolist() for x in one] == [encoding._core_bpe.encode_single_piece(p) for p in (b"zq" * 30, b"the", b"qqqq")]


def test_bpe_tables(tmp_path):
    pairs = byte_bpe.Pairs(np.arange(1000) % 40, np.arange(1000) // 40, np.arange(1000, dtype=np.int32))
    left, right = np.array([[0, 39, -1], [40, 5, 5]]), np.array([[0, 24, 3], [0, -1, 25]])
    assert pairs.find(left, right).tolist() == [[0, 999, byte_bpe.NONE], [byte_bpe.NONE] * 3]
    # a file in which a merged token may be part of an earlier one: "ab" comes after "abc"
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"abab", b"aab"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    own = byte_bpe.Vocabulary(str(path))
    core = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("abc") for _ in range(r.randrange(2, 30)))
        want = core._core_bpe.encode_single_piece(piece.encode())
        assert np.frombuffer(own.encode([piece.encode()])[0], np.int32).tolist() == want
        if piece.encode() not in own.ranks:
            assert np.frombuffer(own.one(piece.encode()), np.int32).tolist() == want


def test_bpe_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [100, 50000])], "doc_id long, ids array<int>")
    own = byte_bpe.vocabulary(PATH)
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.bpe_decode(rows, PATH).collect()}
    assert got == {1: b"", 2: b"", 3: own.tokens[100].as_py() + own.tokens[50000].as_py()}
    with pytest.raises(Exception, match="no vocabulary"):
        byte_bpe.bpe_decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH).collect()
    digest = hashlib.sha256(b"1,22").hexdigest()
    assert spark.sql("select sha2(cast(array_join(cast(array(1, 22) as array<string>), ',') as binary), 256) as s").first().s == digest


def mined(rows, anchor, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows if None not in (i, label, x)})
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b != a)
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "d", "options"), [(1, 400, 8, {}), (2, 500, 6, {"words": 5, "first": 8}), (3, 300, 5, {"words": 12, "first": 1, "sample": 40}), (4, 60, 1, {"words": 3, "first": 4})])
def test_hard_negatives(spark, monkeypatch, seed, n, d, options):
    monkeypatch.setattr(hard_negatives, "ASKED", 7 if seed % 2 else 4096)
    rows = clouds(seed, n, d)
    rows += [(10_000 + k, 1, rows[20][2]) for k in range(150)] + [(20_000 + k, 2, rows[20][2]) for k in range(0, 40, 2)]  # copies, with their anchors
    rows += [(5, None, rows[0][2]), (None, 1, rows[0][2]), (30_000, 1, None), rows[20], rows[20]]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).repartition(3)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, **options).collect()))
    assert got == mined(rows, lambda i: i % 20 == 0)
    assert got or d == 1


def test_hard_negatives_of_few(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    mine = lambda rows: sorted(map(tuple, hard_negatives.hard_negatives(make(rows), F.col("vec_id") % 100 == 0).collect()))
    assert mine([]) == [] and mine([(0, 1, [1, 2])]) == [] and mine([(1, 1, [1]), (2, 2, [1])]) == []
    zeros = [(k, k % 2, [0, 0]) for k in range(0, 300, 25)]
    assert mine(zeros) == mined(zeros, lambda i: i % 100 == 0) != []
    big = [(k, k % 3, [(k % 7 - 3) << 21, k << 20, 5]) for k in range(40)]
    assert mine(big) == mined(big, lambda i: i % 100 == 0)
    with pytest.raises(ValueError, match="entries"):
        mine([(0, 1, [1]), (1, 1, [1, 2])])


def test_hard_negatives_of_many_blocks(spark, monkeypatch):
    """Queries go to the blocks by merge joins, once a bucket: their estimated size, which is that of the table of queries, says nothing about what they are."""
    for name, value in (("BLOCK", 8), ("CHUNK", 3), ("LISTED", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    plans = []
    monkeypatch.setattr(hard_negatives, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or common.written(df))
    rows = clouds(6, 300, 6)
    got = sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, words=2, first=50).collect()))
    assert got == mined(rows, lambda i: i % 10 == 0) != []
    searches = [p for p in plans if "queries" in p]
    assert len(searches) > 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in searches)
    assert not [p for p in plans if "Broadcast" in p and "parts" not in p]


def test_requests_by_bucket():
    """Each query is sent once to each bucket with a part of a cell that it visits, with the cells that it visits there."""
    r = np.random.default_rng(4)
    x = r.integers(-100, 100, (9000, 4))
    cells = hard_negatives.Cells([hard_negatives.codebook(x[:500, :2], 3), hard_negatives.codebook(x[:500, 2:], 2)])
    cell = cells.place(x)[0]
    cells.n, cells.radius = np.bincount(cell, minlength=6).reshape(3, 2), [np.full((3, 2), 1e9)] * 2
    rows = [{"gid": k, "label": 0, "x": x[k].tolist(), "w": [0], "low": [-(10**9)], "high": [10**9], "kth": [None]} for k in range(7)]
    kinds = {"gid": pa.int64(), "label": pa.int64(), "x": pa.list_(pa.int64()), "w": pa.list_(pa.int32())} | {c: pa.list_(pa.int64()) for c in ("low", "high", "kth")}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
    got = [row for out in hard_negatives._asked(type("B", (), {"value": cells}), 2, 0, 10**6)(iter([batch])) for row in out.to_pylist()]
    parts = {c: -(-n // hard_negatives.BLOCK) for c, n in enumerate(cells.n.ravel().tolist()) if n}
    want = {b: sorted({c for c, n in parts.items() for p in range(n) if (c + p) % 2 == b}) for b in (0, 1)}
    assert len(got) == 2 and {row["to"]: row["cells"] for row in got} == want
    for row in got:
        chunk = pa.ipc.open_stream(row["queries"]).read_next_batch()
        assert chunk.column(0).to_pylist() == list(range(7)) and chunk.column(6).to_pylist() == [row["cells"]] * 7
        assert hard_negatives.unpacked(pa.py_buffer(row["own"]), 7, 4).tolist() == x[:7].tolist() and len(row["own"]) == 28


def test_visits_are_certified():
    """Cells left out or beyond the end hold no vector that a window takes."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(-200, 200, (300, 6)), r.integers(180, 260, (300, 6))])
    cells = hard_negatives.Cells([hard_negatives.codebook(x[:, :3], 9), hard_negatives.codebook(x[:, 3:], 9)])
    cell, first, second = cells.place(x)

    class Stat:
        def __init__(self, c):
            own = cell == c
            self.cell, self.n, self.first, self.second = int(c), int(own.sum()), first[own].max(), second[own].max()

    cells.measure([Stat(c) for c in np.unique(cell)])
    short = 0
    for q in x[::20]:
        scores = x @ q
        for low, high in ((np.sort(scores)[-10], 1 << 40), (1000, 5000), (-(1 << 40), -20_000)):
            visited, more, after = [], True, 0
            while more:
                own, more = cells.visit(q, np.array([low], float), np.array([high], float), after, after + 100)
                visited += own
                after += 100
            assert len(visited) == len(set(visited)) and set(cell[(scores >= low) & (scores <= high)]) <= set(visited)
            short += len(visited) < len(np.unique(cell))
    assert short > 30
