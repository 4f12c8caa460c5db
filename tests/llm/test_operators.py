import gzip
import hashlib
import itertools
import math
import random
import re
import struct
import subprocess
import time
import zlib
from collections import Counter
from fractions import Fraction
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixscreen.llm import common, exact_dedup, jaccard_join, language_id, language_model, line_dedup, media, minhash, mixing, packing, toxicity, unionfind, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta", "zeta"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 120), prose(2, 120)
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(a.split()))
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, near, "en", "t"), (4, b, "en", None), (5, None, None, "s"), (6, "", "en", "t"), (7, "one two", "en", "s"), (7, "one two", "en", "s"), (8, b + "\nline of its own that is long enough", "en", "s"), (None, a, None, None)]
    return make(spark, rows)


def test_exact(spark, docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, counters=2).collect()}
    assert (1, 2, 3, False) in got and (2, 2, 3, True) in got and (None, 2, 3, False) in got and (5, 6, 2, False) in got and (6, 6, 2, True) in got and (7, 7, 2, True) in got
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    many = make(spark, [(k, "hot" if k % 3 else str(k), None, None) for k in range(300)])
    assert exact_dedup.exact_dedup(many, counters=4).where("kept").count() == 101
    rows = many.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    assert exact_dedup.heavy_hitters(rows, 4).count() >= 1


def scheduled(blocks, weights, period=None):
    """The slots of each source's blocks, all from one plan."""
    plan = mixing.Plan(blocks, weights, period)
    chunks = {}
    for run in range(plan.count()):
        for s, r, c, own in plan.scheduled(run):
            chunks.setdefault(s, {})[r, c] = own
    got = {}
    for s, n in blocks.items():
        got[s] = np.array(plan.block_slots(s, 0, n - 1, chunks[s]))
        for a, z in ((0, n - 1), (n // 3, n // 2), (n - 1, n - 1)):
            own = {k: chunks[s][k] for k in plan.chunks(s, a, z)}
            assert plan.block_slots(s, a, z, own) == got[s][a : z + 1].tolist()
    assert sorted(np.concatenate(list(got.values()))) == list(range(sum(blocks.values())))
    return got


def test_pfair():
    for weights in ({"a": 1, "b": 2, "c": 5}, {"x": 3, "y": 3}, {str(k): 1 for k in range(7)}):
        share = mixing.shares(weights, 100)
        assert sum(share.values()) == 100
        got = scheduled({s: 3 * n for s, n in share.items()}, weights, 100)
        t = np.arange(301)
        assert all((abs(np.searchsorted(got[s], t) - share[s] / 100 * t) < 1).all() for s in weights)


@pytest.mark.parametrize("weights", [{str(k): 1 for k in range(3)}, {str(k): 1 + k % 3 for k in range(7)}, {str(k): 1 for k in range(450)}, {"a": 0.001, "b": 0.3, "c": 0.699}, {"a": 10**12 + 1, "b": 3, "c": 10**12}])
def test_pfair_target_weights(weights):
    at = scheduled({s: 1 + int(20_000 * w / sum(weights.values())) for s, w in weights.items()}, weights)
    ends = min(x[-1] for x in at.values())  # up to here all have blocks
    assert ends > 1000
    for s, x in at.items():
        served = np.searchsorted(x, np.arange(ends + 2))  # before each slot
        assert (abs(served - weights[s] / sum(weights.values()) * np.arange(ends + 2)) < 1 + 1e-9).all()


@pytest.mark.parametrize("weights", [{"a": 0.333333, "b": 0.271828, "c": 0.394839}, {"a": 6, "b": 2.5, "c": 0.5}, {str(k): 1 + k % 4 for k in range(60)}])
def test_pfair_sources_that_end(weights):
    """Never a block from the fluid schedule, in which sources that end leave their part to the others; the same as the plain schedule."""
    blocks = {s: 1 + (37 * k * k + 11 * k) % 400 for k, s in enumerate(weights)}
    got = scheduled(blocks, weights)
    order = naive_schedule(blocks, weights)
    assert all(order[t] == s for s, x in got.items() for t in x)
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    left, served, v, t = dict(blocks), dict.fromkeys(blocks, Fraction(0)), Fraction(0), 0
    for s in order:
        todo = Fraction(1)
        while todo:  # the fluid of one slot
            active = [x for x in blocks if served[x] < blocks[x]]
            rate = sum(exact[x] for x in active)
            step = min(todo, *((blocks[x] - served[x]) * rate / exact[x] for x in active))
            for x in active:
                served[x] += step * exact[x] / rate
            todo -= step
        left[s] -= 1
        assert all(abs(blocks[x] - left[x] - served[x]) < 1 for x in blocks)


def test_pfair_grows_with_sources_alone():
    """100,000 sources that end one after another; a billion blocks."""
    began = time.time()
    plan = mixing.Plan({f"s{k}": 10_000 + k for k in range(100_000)}, {f"s{k}": 1 for k in range(100_000)})
    last = plan.groups[0][1][-1]
    assert last[2] + last[3] == sum(10_000 + k for k in range(100_000)) and time.time() - began < 30
    rows = list(plan.scheduled(plan.count() - 1))
    assert rows == [("s99999", plan.count() - 1, 0, [0])]


def test_mix_many_sources(spark):
    rows = [(k, "t", None, f"s{k % 410}") for k in range(410 * 5)]
    got = mixing.mix_sources(make(spark, rows), block=1, weights={"s3": 2, "s4": 0}, ranked=16).collect()
    slot = {r.mix_slot: r.mix_source for r in got}
    assert sorted(slot) == list(range(len(rows)))
    first = [slot[t] for t in range(410)]  # a period: 408 sources of one slot, one of two
    assert first.count("s3") == 2 and len(set(first)) == 409 and "s4" not in first
    assert [slot[t] for t in range(len(rows) - 5, len(rows))] == ["s4"] * 5


def test_mix(spark, docs):
    big = make(spark, [(k, "t", None, "hot" if k % 3 else f"s{k % 5}") for k in range(400)] + [(None, None, None, None)])
    got = mixing.mix_sources(big, block=4, period=20, ranked=16).collect()
    assert len(got) == 401 and len({r.mix_position for r in got}) == 401
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, r.mix_source) == r.mix_source
    assert sorted(slots) == list(range(len(slots)))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def naive_schedule(blocks, weights):
    """The source of each slot: of all released blocks that with the earliest deadline, all windows being those of the fluid schedule."""
    out = []
    for own in ([s for s in blocks if weights[s] > 0], [s for s in blocks if not weights[s] > 0]):
        w = {s: Fraction(str(weights[s])) or Fraction(1) for s in own}
        passed = lambda v: sum(min(w[s] * v, blocks[s]) for s in own)  # noqa: B023, E731
        jobs = [(math.floor(passed(j / w[s])), math.ceil(passed((j + 1) / w[s])), str(s), s) for s in own for j in range(blocks[s])]
        for t in range(len(jobs)):
            job = min((x for x in jobs if x[0] <= t), key=lambda x: x[1:3])
            assert t < job[1]
            jobs.remove(job)
            out.append(job[3])
    return out


def test_mix_brute_force(spark):
    """Unequal weights, sources that run out, weight 0, null and repeated ids, equal rows, columns of all internal names."""
    weights = {"a": 3, "b": 0.5, None: 1.25, "z": 0}
    rows = [(k if k % 9 else None, "t" if k % 9 == 0 else f"t{k}", None, ["a", "a", "b", None, "z", "c", "a"][k % 7]) for k in range(500)] + [(5, "t5", None, "c")] * 3
    names = ["s", "b", "start", "phases", "slots", "count", "n", "source_", "hash_", "bucket_", "rank_", "block_", "start_", "slots_", "mix_slot", "__s"]
    df = make(spark, rows).withColumns({c: F.lit(c) for c in names}).withColumn("tags", F.create_map(F.lit(1), F.lit(2)))
    got = mixing.mix_sources(df.repartition(5), weights, block=4, ranked=16).collect()
    assert [r.mix_position for r in sorted(got, key=lambda r: r.mix_position)] != [] and len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    order = naive_schedule({s or "\0null": -(-n // 4) for s, n in sizes.items()}, {s or "\0null": weights.get(s, 1) for s in sizes})
    slots: dict = {}
    for t, s in enumerate(order):
        slots.setdefault(s, []).append(t)
    hashed = [c for c in df.columns if c not in ("doc_id", "tags")]
    own: dict = {}
    for r in df.withColumn("h", F.xxhash64("doc_id", *hashed)).collect():
        own.setdefault(r.source, []).append((r.h, r.doc_id, r.text))
    want = sorted((slots[s or "\0null"][k // 4] * 4 + k % 4, slots[s or "\0null"][k // 4], k // 4, i, t, s or "") for s, x in own.items() for k, (_, i, t) in enumerate(sorted(x, key=lambda x: x[0])))
    assert sorted((r.mix_position, r.mix_slot, r.mix_block, r.doc_id, r.text, r.source or "") for r in got) == want
    assert all(r[c] == c for r in got for c in names if c != "mix_slot")


def test_mix_equal_rows(spark):
    """Rows that hundreds of others equal are ranked in tables of their own; each row has a position."""
    rows = [(None, "same", None, "a")] * 700 + [(7, "t", None, "b")] * 300 + [(k, "t", None, "ab"[k % 2]) for k in range(8, 208)]
    got = mixing.mix_sources(make(spark, rows).repartition(3), {"a": 2}, block=4, ranked=16).collect()
    assert len(got) == 1200 and len({r.mix_position for r in got}) == 1200
    assert sorted((r.doc_id or -1, r.source) for r in got) == sorted((r[0] or -1, r[3]) for r in rows)
    order = naive_schedule({"a": 200, "b": 100}, {"a": 2, "b": 1})
    assert all(order[r.mix_slot] == r.source and r.mix_position // 4 == r.mix_slot for r in got)
    hot = mixing._ties_apart(make(spark, rows).selectExpr("source AS s", "0 AS b", "xxhash64(doc_id, source) AS h"), "s", "b", "h", "x", 16)
    assert max(r["count"] for r in hot.where("x > 0").groupBy("s", "x").count().collect()) <= 16 and hot.count() == 1200 and hot.where("x = 0").count() == 200


@pytest.mark.parametrize("most", [20, 500_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(unionfind, "LINKS", most)
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(30)] + [(9, 9)]
    forest = unionfind.Forest()
    for a, b in links:
        forest.join(a, b)
    want = {x: forest.find(x) for x in {y for p in links if p[0] != p[1] for y in p}}
    got = unionfind.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {x.id: x.root for x in got} == want and len(got) == len(want)
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard(spark, docs):
    members, links = jaccard_join.jaccard_join(docs.withColumn("digest", F.lit(1)))
    got = {(r.doc_id, r.class_id) for r in members.collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 4)} == got
    assert all(r.similarity >= 0.8 for r in links.collect())


def test_jaccard_brute_force(spark):
    texts, r = [], random.Random(5)
    for k in range(25):
        base = prose(100 + k, 80).split()
        for c in range(4):
            words = list(base)
            for _ in range(c):
                words[r.randrange(80)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = common.shingles(texts)
    forest = unionfind.Forest()
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            forest.join(a, b)
    members, _ = jaccard_join.jaccard_join(make(spark, [(k, t, None, None) for k, t in enumerate(texts)]))
    assert {m.doc_id: m.class_id for m in members.collect()} == {k: forest.find(k) for k in range(len(texts))}


def test_jaccard_all_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 16)  # so that groups are met in tiles
    texts, r = [], random.Random(7)
    for k, copies in enumerate((3, 60, 1)):
        base = prose(400 + k, 120).split()
        for _ in range(copies):
            words = list(base)
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words))
    sets, want = common.shingles(texts), {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if (similarity := n / (len(sets[a]) + len(sets[b]) - n)) >= 0.8:
            want[a, b] = pytest.approx(similarity)
    assert len(want) == 3 + 60 * 59 // 2
    make(spark, [(k, t, None, None) for k, t in enumerate([*texts, texts[0]])]).write.parquet(f"{tmp_path}/documents.parquet")
    _, links = jaccard_join.jaccard_join(common.read(spark, str(tmp_path), "documents"))
    got = [(x.a, x.b, x.similarity) for x in links.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    degree = [sum(k in p for p in want) for k in range(len(texts))]
    assert {x.doc_id: x.n_links for x in jaccard_join.op2_jaccard_join(spark, str(tmp_path)).collect()} == dict(enumerate([*degree, degree[0]]))
    classes, none = jaccard_join.jaccard_join(common.read(spark, str(tmp_path), "documents"), whole=False)
    assert none is None and {x.doc_id: x.class_id for x in classes.collect()} == {k: 0 if k < 3 or k == 64 else 3 if k < 63 else 63 for k in range(65)}


def test_stars_and_tiles(spark, monkeypatch):
    rows = [(k, [7, 1000 + k]) for k in range(1300)] + [(5000, [3, 4]), (5001, [3, 5]), (5001, [3, 5])]
    signed = spark.createDataFrame([(i, [b << 8 | n for n, b in enumerate(bands)]) for i, bands in rows], "id long, bands array<long>").repartition(3)
    found = minhash.shared(signed).cache()
    forest = unionfind.Forest()
    for r in found.collect():
        forest.join(r.a, r.b)
    assert {forest.find(k) for k in range(1300)} == {0} and forest.find(5001) == 5000 and found.count() == 1300
    assert found.groupBy("a", "key").count().agg(F.max("count")).first()[0] <= minhash.CHUNK
    met: dict = {}
    for r in minhash.tiles(minhash.members(found)).collect():
        met.setdefault(r.tile, []).append((r.id, r.side))
    assert max(map(len, met.values())) < 1300
    pairs = [tuple(sorted((a, b))) for t in met.values() for (a, x), (b, y) in itertools.combinations(t, 2) if x != y or not any(z for _, z in t)]
    assert len(pairs) == len(set(pairs)) == 1300 * 1299 // 2 + 1
    monkeypatch.setattr(minhash, "CHUNK", 100)
    label = lambda i: i % 9 if i % 9 < 4 else i  # noqa: E731  three large classes, and one for each other id
    rows = minhash.members(found).where("id < 1300").withColumn("label", F.expr("IF(id % 9 < 4, id % 9, id)"))
    met = {}
    for r in minhash.tiles(rows, labelled=True).collect():
        met.setdefault(r.tile, []).append((r.id, r.side))
    pairs = [tuple(sorted((a, b))) for t in met.values() for (a, x), (b, y) in itertools.combinations(t, 2) if label(a) != label(b) and (x != y or not any(z for _, z in t))]
    want = {(a, b) for a, b in itertools.combinations(range(1300), 2) if label(a) != label(b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("chunk", [3, 512])
def test_chained(spark, monkeypatch, chunk):
    """Classes by stars and rests are those of all pairs, also where an id that stands for others is like none of them."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    r = random.Random(8)
    sets: dict = {k: np.array([10**6 * k + 1], np.uint64) for k in range(2)}
    for k in range(2, 60):
        base = 1000 * (k % 7)
        sets[k] = np.array(sorted({base + r.randrange(24) for _ in range(60)}), np.uint64)
    signed = spark.createDataFrame([(k, [1 << 8, 2 << 8 | k % 5 << 9 | 1]) for k in sets], "id long, bands array<long>")
    table = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "id long, item binary")
    forest = unionfind.Forest()
    for a, b in itertools.combinations(sets, 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            forest.join(a, b)
    want = {k: forest.find(k) for k in sets if any(forest.find(j) == forest.find(k) for j in sets if j != k)}
    assert len(set(want.values())) >= 7
    got = minhash.chained(minhash.shared(signed), lambda ids: table.join(ids, "id", "left_semi"), 0.8)
    assert {x.id: x.root for x in got.collect()} == want


def test_lines(spark):
    x = "this is a rather long line of text that many pages show at their very end, word for word, each time"
    y = x.replace("pages", "sites")
    rows = [(1, f"first line of the first text\n{x}", None, None), (2, f"{x}\n\nsomething else entirely in here", None, None), (3, f"{y}\nthird", None, None), (4, None, None, None), (5, "", None, None)]
    clash = make(spark, rows).withColumns({c: F.lit(1) for c in ("__doc", "__key", "id", "line", "places", "removed_lines", "component")})
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(clash).collect()}
    assert line_dedup.line_dedup(clash.limit(0)).count() == 0
    assert got == {1: rows[0][1], 2: "\nsomething else entirely in here", 3: "third", 4: None, 5: ""}


def test_lines_are_ordered_where_copied(spark, monkeypatch):
    """Occurrences are kept for ordering of copied lines alone, and texts of lines are looked up once, though lines are compared twice."""
    tables = []

    def seen(df, *args, **options):
        tables.append(common.written(df, *args, **options))
        return tables[-1]

    monkeypatch.setattr(line_dedup, "written", seen)
    monkeypatch.setattr(minhash, "written", seen)
    x = prose(811, 60).split()
    chain = [" ".join("changed" if j in range(3 * k, 3 * k + 3) else w for j, w in enumerate(x)) for k in range(12)]
    rows = [(k, f"{prose(820 + k, 12)}\n{t}", None, None) for k, t in enumerate([" ".join(x), *chain, " ".join(x)])]
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == {k: [1] if k else None for k in range(14)}
    ordered = [t for t in tables if {"component", "places"} <= set(t.columns)]
    assert len(ordered) == 1 and sum(len(r.places) for r in ordered[0].collect()) == 14
    assert len([t for t in tables if t.columns == ["id", "item"]]) == 1


def test_line_signatures():
    """Those of one hash after another, also of lines shorter than a shingle, not ASCII, or longer than what is hashed together."""
    r = random.Random(5)
    lines = ["a", "abcdefg", "abcdefgh", "\u00e9" * 5, "\u65e5\u672c\u8a9e" * 30, "x" * 40_000] + ["".join(r.choice("abcde\u00e9 ") for _ in range(r.randrange(1, 400))) for _ in range(200)]
    most = 1 << 64

    def mixed(x):
        return int(common.mix(np.array([x % most], np.uint64))[0])

    bins, sets, keys = line_dedup.BANDS * line_dedup.ROWS, [], []
    for line in lines:
        c = [*map(ord, line), *[0] * line_dedup.SHINGLE]
        runs = set()
        for k in range(max(1, len(line) - line_dedup.SHINGLE + 1)):
            h = 0
            for x in c[k : k + line_dedup.SHINGLE]:
                h = (h * int(line_dedup.ODD) + x) % most
            runs.add(h)
        sets.append(sorted(mixed(h) for h in runs))
        least: dict = {}
        for h in sets[-1]:
            least.setdefault((h >> 32) * bins >> 32, h >> 32)
        values = []
        for k in range(bins):
            d = next(d for d in range(bins) if (k + d) % bins in least)
            v = least[(k + d) % bins]
            values.append(((v ^ d) * 0x9E3779B1 | 1) % (1 << 32) if d else v)
        keys.append([])
        for b in range(line_dedup.BANDS):
            key = b + 1
            for v in values[b * line_dedup.ROWS : (b + 1) * line_dedup.ROWS]:
                key = mixed(key ^ v)
            keys[-1].append(key >> 8 << 8 | b)
    assert line_dedup.signatures(lines).tolist() == keys
    assert [x.tolist() for x in line_dedup.line_sets(lines)] == sets


def test_plain_lines():
    for t in ("", " ", "\n\n", "A b\nc", "a  b", "a \nb", "a\n b", "a\tb\r\nc", "\u0391\u03a3\n\u03a3\u0391\u03a3 b", "a\u3000b\n", "x\x85z", "\x1ca", "\u0130\nI", "caf\u00e9\u00a0x"):
        assert line_dedup.plain_lines(t) == [line_dedup.plain(x) for x in t.split("\n")]


def test_lines_of_null_and_repeated_ids(spark):
    x, y, z = (" ".join(prose(k, 12).split()) for k in (801, 802, 803))
    rows = [(1, x), (None, f"{x}\nfirst own line"), (None, f"clean of nulls\n{y}"), (None, f"clean too\n{y}"), (7, f"{x}\nsecond own line"), (7, f"clean of sevens\n{z}"), (7, f"also of sevens\n{z}"), (8, z)]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(make(spark, [(i, t, None, None) for i, t in rows])).collect())
    texts = [t for _, t in got]
    for own in ("first own line", "second own line", "clean of nulls", "clean too", "clean of sevens", "also of sevens"):
        assert sum(own in t.split("\n") for t in texts) == 1
    assert [sum(t.split("\n").count(w) for t in texts) for w in (x, y, z)] == [1, 1, 1]
    assert (1, x) in got and (8, "") in got


def test_lm(spark, monkeypatch):
    """Counts, base_score, the weights that EM learns from held-out counts, and score, against plain Python."""
    monkeypatch.setattr(language_model, "RANGE_CHARS", 1000)
    rows = [(k, prose(k % 9, 30) if k % 4 else prose(k, 12), None, None) for k in range(60)] + [(70, None, None, None), (71, "NEW words", None, None), (72, prose(4, 20_000), None, None), (None, "no id", None, None), (1, "again", None, None)]
    df = make(spark, rows).withColumns({"part": F.lit(1), "tune": F.lit("x"), "trained": F.lit(2)})
    tunes = {r.doc_id for r in df.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(language_model.TUNE)) == 0).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, [w.lower() for w in (t or "").split()] + [None]) for i, t, _, _ in rows]
    events = [(i, list(zip([None, *ws[:-1]], ws, strict=True))) for i, ws in split]
    uni: dict = {}
    bi: dict = {}
    uni1, bi1 = {}, {}
    for i, e in events:
        for c, w in e if not held(i) else ():
            for d in ((uni, bi), (uni1, bi1))[: 1 + (i in tunes)]:
                d[0][w] = d[0].get(w, 0) + 1
                d[1][c, w] = d[1].get((c, w), 0) + 1
    n, v = sum(uni.values()), len(uni)
    cells: dict = {}
    for i, e in events:
        for c, w in e if i in tunes and not held(i) else ():
            b, f, u = bi[c, w] - bi1[c, w], uni[c] - uni1.get(c, 0), uni[w] - uni1[w]
            cells.setdefault(int(np.ceil(np.log2(f + 1))), []).append([b / max(f, 1), u / (n - sum(uni1.values())), 1 / (v + 1)])
    assert len(cells) >= 3
    step = {k: np.full(3, 1 / 3) for k in cells}
    for _ in range(language_model.STEPS):
        last, step = step, {}
        for k, p in cells.items():
            post = last[k] * np.array(p)
            w = np.maximum((post / post.sum(axis=1, keepdims=True)).mean(axis=0), [0, 0, 1e-9])
            step[k] = w / w.sum()
        if max(abs(step[k] - last[k]).max() for k in cells) <= language_model.SETTLED:
            break
    weights, before = [], np.array([0, 0.9, 0.1])
    for k in range(language_model.BUCKETS):
        before = step.get(k, before)
        weights.append(before)
    weights[0] = weights[0] * [0, 1, 1] / (weights[0][1:].sum())
    got = sorted(language_model.score_documents(df.repartition(3), common.remainder("doc_id", 7) != 2).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(events, key=lambda e: (e[0] is None, e[0] or 0, len(e[1])))
    for r, (i, e) in zip(got, want, strict=True):
        assert (r.doc_id, r.trained, r.n_tokens, r.n_known, r.train_tokens) == (i, not held(i), len(e), sum(w in uni for _, w in e), n)
        assert r.base_score == pytest.approx(sum(np.log10((uni.get(w, 0) + 1) / (n + v + 1)) for _, w in e), abs=1e-6)
        total = 0.0
        for c, w in e:
            own = weights[int(np.ceil(np.log2(uni.get(c, 0) + 1)))]
            total += np.log10(own[0] * bi.get((c, w), 0) / max(1, uni.get(c, 0)) + own[1] * uni.get(w, 0) / n + own[2] / (v + 1))
        assert r.score == pytest.approx(total, rel=1e-6)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert language_model.score_documents(df.limit(0), common.remainder("doc_id", 7) != 2).count() == 0
    none = language_model.score_documents(df.where("doc_id < 3"), F.lit(False)).first()
    assert none.train_tokens == 0 and none.score == none.base_score == 0


def test_warc(spark):
    body = "<p>" + "x\r\n\r\ny " * 30
    df = spark.createDataFrame([(3, "http://www.b.com/x", body), (1, "http://a.org", body), (2, "https://a.org/", "short"), (4, "http://a.org/q#f", "short"), (5, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(df).collect()}
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[2].record_type, got[4].record_type) == ("response", "revisit", 1, "response", "response")
    assert got[3].payload_digest == hashlib.sha256(body.encode()).hexdigest() and got[3].payload_bytes == len(body)
    assert [got[k].url_key for k in (1, 2, 3, 4, 5)] == ["org,a)/", "org,a)/", "com,b)/x", "org,a)/q", ")/"]
    assert warc.archive(df.limit(0)).count() == 0
    df = df.withColumns({"payload": F.lit(1), "first": F.lit(2), "again": F.lit(3)})
    assert {r.page_id for r in warc.archive(df).collect()} == {1, 2, 3, 4, 5}
    assert got[1].payload_bytes == len(body) and zlib.decompress(gzip.compress(b"x"), 31) == b"x"


def test_warc_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    r = random.Random(4)
    runs = [sorted(((r.choice("abcd"), str(r.randrange(40)), r.choice([None, k])) for k in range(s, 60, 7)), key=warc.order) for s in range(7)]
    every = sorted((x for run in runs for x in run), key=warc.order)
    tree = warc.LoserTree(runs)
    assert [tree.pop() for _ in every] == every and tree.head() is None
    blocks = [(run[k], run[k : k + 3]) for run in runs for k in range(0, len(run), 3)]
    assert list(warc.merge(sorted(blocks, key=lambda b: warc.order(b[0])))) == every
    assert list(warc.merge([])) == []

    # a hot URL, repeated page ids, files of few records: the index is in order over partitions, and each entry leads to its record
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    rows = [(k if k % 11 else None, "http://hot.org/" if k % 3 else f"http://h{k % 17}.org/{k}", f"<p>{k % 5}</p>" * (30 if k % 2 else 3)) for k in range(400)] + [(7, "http://hot.org/", "<p>x</p>" * 40)] * 3 + [(9, "http://q.org", "y" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = [(k, e) for k, part in enumerate(warc.archive(pages, f"{tmp_path}/w").rdd.glom().collect()) for e in part]
    assert len(found) == len(rows) and len({k for k, _ in found}) > 1
    entries = [e for _, e in found]
    assert entries == sorted(entries, key=warc.order)
    for e in entries[::7]:
        with open(f"{tmp_path}/w/{e.file}", "rb") as f:
            f.seek(e.offset)
            raw = zlib.decompress(f.read(e.length), 31)
        block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
        assert e.record_type == "revisit" or (len(block), hashlib.sha256(block).hexdigest()) == (e.payload_bytes, e.payload_digest)
    # other readers of gzip give all records of all files
    got = Counter()
    for file in (tmp_path / "w").glob("*.txt"):
        raw = gzip.decompress(file.read_bytes())
        assert subprocess.run(["gzip", "-dc"], input=file.read_bytes(), capture_output=True, check=True).stdout == raw
        got.update(re.findall(rb"WARC-Record-ID: <urn:page:(\d*)>", raw))
        assert raw.count(b"WARC/1.1\r\n") <= 40
    assert got == Counter(str("" if r[0] is None else r[0]).encode() for r in rows)
    assert sum(e.page_id == 7 and e.record_type == "response" and e.payload_bytes == 320 for e in entries) == 3


def test_warc_long_records(spark, tmp_path, monkeypatch):
    """Records of several members, and files that bytes bound."""
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rows = [(k, f"http://a{k}.org/", "".join(map(chr, range(300, 300 + k * 9))) * (k % 3 * 10 + 1)) for k in range(40)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"{tmp_path}/w").collect()
    assert {r.page_id: r.payload_digest for r in out} == {k: hashlib.sha256(t.encode()).hexdigest() for k, _, t in rows}
    files = list((tmp_path / "w").glob("*.txt"))
    assert len(files) > 3 and b"".join(gzip.decompress(f.read_bytes()) for f in files).count(b"WARC/1.1\r\n") == 40


def test_warc_merge_passes(spark, tmp_path, monkeypatch):
    """More runs than are merged at a time: passes; only a few blocks are open in each."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "FILE_RECORDS", 5)
    rows = [(k, f"http://h{k * 7 % 31}.org/{k % 9}", f"<p>{k}</p>") for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        parts = []
        for fan in (64, 3):
            monkeypatch.setattr(warc, "FAN", fan)
            parts.append([e for part in warc.archive(pages, f"{tmp_path}/w{fan}").drop("file", "offset").rdd.glom().collect() for e in part])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [e.page_id for e in parts[0]] == [e.page_id for e in parts[1]] and parts[1] == sorted(parts[1], key=warc.order) and len(parts[1]) == 500
    r, peak = random.Random(5), []
    runs = [sorted((r.random(), "", k) for _ in range(200)) for k in range(16)]
    blocks = sorted(((run[k], run[k : k + 8]) for run in runs for k in range(0, 200, 8)), key=lambda b: b[0])
    build = warc.LoserTree.build
    monkeypatch.setattr(warc.LoserTree, "build", lambda self, more: (build(self, more), peak.append(len(self.sources)))[0])
    assert list(warc.merge(blocks)) == sorted(x for run in runs for x in run) and max(peak) <= 17


def phrases(text, data):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in data:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("piece", [7, 64, 1024])
def test_phrases(monkeypatch, piece):
    """Pieces are parsed side by side; the parse is that of the whole text, also where phrases are longer than pieces or never fall in step."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    r = random.Random(1)
    some = lambda letters, n: bytes(r.choice(letters) for _ in range(n))
    data = {"a": some(b"abc ", 500), "b": b"a" * 700 + b"bcd", "c": some(b"xyz", 300), "d": b"ab" * 900}
    texts = [some(b"abcq ", n) for n in (1, 5, 7, 8, 64, 65, 1000, 3000)] + [b"a" * 3000, b"ab" * 2000, data["a"] * 3, b"q" * 100, data["b"][:500] + data["a"]]
    p = language_id.CrossParser(data)
    assert p.phrases(texts).tolist() == [[phrases(t, data[x]) for t in texts] for x in p.languages]
    assert language_id.CrossParser({}).phrases(texts).shape == (0, len(texts))


def test_language(spark):
    data = {"aa": b"abab abba baab " * 30, "cc": b"cdcd dccd cddc " * 30, "dd": b"cdcd dccd cddc " * 30}
    texts = ["abba baab", "cdcd", None, "123 !", "", "abba cdcd dccd " * 200, "Cd  CD\nab", "%%% 12 abba*** &&& ba"]
    rows = [(k, t, None, None) for k, t in enumerate([*texts, texts[0]])]
    df = make(spark, rows).withColumns({"__lang": F.lit(1), "score": F.lit("x"), "_text": F.lit(2)})
    got = language_id.identify(df, data).orderBy("doc_id").collect()
    for r, (_, t, _, _) in zip(got, rows, strict=True):
        low = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()).encode()
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        bits = {x: phrases(low, data[x]) * np.log2(len(data[x]) + 2) / len(low) for x in data}
        assert r.lang_pred == min(sorted(bits), key=bits.get)  # a tie goes to cc, not dd
        assert r.score == pytest.approx(1 / sum(2 ** ((min(bits.values()) - b) * min(50, len(low))) for b in bits.values()))
        assert r["__lang"] == 1 and r._text == 2
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}
    assert language_id.identify(df.limit(0), data).count() == 0


def test_language_learns_whole_rows(spark):
    rows = [(1, "Short", "xx", None), (2, prose(5, 4000), "yy", None), (2, prose(5, 4000), "yy", None), (2, "other text", "yy", None), (3, None, "yy", None), (None, "no id", "yy", None), (4, "no lang", None, None)]
    got = language_id.learn(make(spark, rows).repartition(3))
    assert got["xx"] == b" short" and set(got) == {"xx", "yy"} and len(got["yy"]) == sum(len(language_id.plain(t)) + 1 for t in (prose(5, 4000), "other text"))
    assert got == language_id.learn(make(spark, rows).repartition(7))
    assert language_id.learn(make(spark, [])) == {}


def test_media(spark):
    page = "<p>before &amp; <b>more</b></p><figure><img src='media:sha256:{0}'><figcaption>the  caption</figcaption></figure>after<script>no</script><noscript>not <img src='x.png'></noscript><template><img src='y.png'></template><img src='media:sha256:00' alt='lost'><img src='http://a.org/z.png'/>"
    text = "é payload"
    full = text.encode() + b" " * (192 - len(text.encode()))
    pages = spark.createDataFrame([(1, page.format(hashlib.sha256(full).hexdigest())), (2, None), (2, "again"), (None, "")], "page_id long, html string").withColumns({"digest": F.lit(1), "kind": F.lit(2)})
    payloads = spark.createDataFrame([(text,), (text,), (None,)], "t string").select(F.when(F.col("t").isNotNull(), media.payload(F.col("t"))).alias("payload"), F.lit(1).alias("digest"))
    got = [(r.position, r.kind, r.text, r.src, r.caption, r.payload_sha256) for r in media.interleave(pages, payloads).where("page_id = 1").orderBy("position").collect()]
    sha = hashlib.sha256(full).hexdigest()
    assert got == [(0, "text", "before & more", None, None, None), (1, "media", None, f"media:sha256:{sha}", "the caption", sha), (2, "text", "after", None, None, None), (3, "media", None, "media:sha256:00", "lost", None), (4, "media", None, "http://a.org/z.png", None, None)]
    assert media.interleave(pages.limit(0), payloads.limit(0)).count() == 0


def shown(html):
    """Parts of a page without stray or unclosed tags, by patterns: (text or src, caption)."""
    html = re.sub(r"(?is)<!--.*?-->|<(script|style|title|noscript|template)\b.*?</\1\s*>|<!doctype[^>]*>", "", html)
    parts, text, last, caption = [], "", None, None

    def flush():
        nonlocal text
        if own := " ".join(unescape(text).split()):
            parts.append([own, None])
        text = ""

    for end, tag, rest, data in re.findall(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", html):
        tag = tag.lower()
        if data:
            if caption is None:
                text += data
            else:
                caption += data
        elif tag == "figcaption":
            flush()
            if end and caption is not None and last is not None:
                last[1] = " ".join(unescape(caption).split())
            caption = None if end else ""
        elif tag in media.Sequence.BREAKS:
            flush()
            if tag == "figure" and not end:
                last = None
            given = {k.lower(): unescape(a or b or c) for k, a, b, c in re.findall(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", rest)}
            if tag in media.Sequence.MEDIA and not end and given.get("src"):
                last = [given["src"], given.get("alt")]
                parts.append(last)
    flush()
    return [tuple(p) for p in parts]


def test_page_sequences(spark):
    """The query over whole tables against another parser."""
    for sf in ("sf0.001", "sf0.01"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html").collect()
        got = {r.page_id: r for r in media.op6_page_sequences(spark, f"/root/testdata/{sf}").collect()}
        parts = {r.page_id: r.sequence for r in media.sequences(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")).collect()}
        assert len(got) == len(pages)
        for page_id, html in pages:
            want = shown(html or "")
            assert [(p.text or p.src, p.caption) for p in parts[page_id]] == want
            texts = [x.text for x in parts[page_id] if x.kind == "text"]
            assert (got[page_id].n_parts, got[page_id].n_media) == (len(want), len(want) - len(texts)) and got[page_id].text_sha256 == hashlib.sha256("\n".join(texts).encode()).hexdigest()
        assert sum(len(p) for p in parts.values()) > 3 * len(pages)


def test_omitted_end_tags():
    own = lambda html: [p["text"] or p["src"] for p in media.parse(html)]
    assert own("<head><title>t</title><body><p>Hello<img src=a.png>") == ["Hello", "a.png"]
    assert own("<head><meta charset=utf-8><p>no body tag") == ["no body tag"] and own("<html><title>t</title>text") == ["text"]
    assert own("a<template>b<img src=c>") == ["ab", "c"]
    assert own("<noscript>a<template>b</noscript>c<img src=d>") == ["c", "d"] and own("x</template>y</noscript>") == ["xy"]
    assert own("<template>1</template><p>2<template>3<p>4<template>5</template>6") == ["23", "46"]
    assert own("") == [] and own("<p>" * 3000 + "z") == ["z"] and own("<template>" * 400 + "z") == ["z"]


def test_damaged_media(spark, tmp_path):
    rows = spark.createDataFrame([("00", bytearray(b"P5\n192 1\n255\n" + b"x" * 192))], "digest string, media binary")
    rows.write.parquet(f"{tmp_path}/m")
    with pytest.raises(Exception, match="damaged"):
        media.describe(spark, f"{tmp_path}/m")


def test_media_columns(spark, tmp_path):
    texts = ["", None, "a", "b" * 192, "é" * 97, prose(3, 3000), prose(3, 3000), "hot", *["hot"] * 50]
    make(spark, [(k, t, None, None) for k, t in enumerate(texts)]).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op6_media_columns(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = f"P5\n192 {len(full) // 192}\n255\n".encode() + full
        x = np.frombuffer(full, np.uint8).reshape(-1, 192).astype(int)
        bits = ""
        for k in range(8):
            a, b = k * len(x) // 8, (k + 1) * len(x) // 8
            for c in range(8):
                field = x[a : max(a + 1, b), 24 * c : 24 * c + 24]
                bits += str(int(field.sum() * x.size > x.sum() * field.size))
        want = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}-{int(x.mean() * 100 + 0.5)}")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_toxicity(spark):
    rows = [(k, prose(k, 40) + (" vilewörds here" if k % 2 else ""), None, None) for k in range(200)] + [(900, None, None, None), (901, prose(77, 30000) + " vilewörds here", None, None)]
    rows += [(7, rows[7][1], None, None)] * 3 + [(8, rows[9][1], None, None)]  # repeated rows, and an id with another text
    df = make(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1), (905, None), (3, 0)], "doc_id long, toxic int")
    clash = df.withColumns({"score": F.lit("clash"), "__score": F.lit(1), "__text": F.lit(2)})
    got = toxicity.score_toxicity(clash, toxicity.train(df.repartition(5), labels)).collect()
    assert len(got) == len(rows) and all(r["__score"] == 1 for r in got)
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) for r in got if 120 <= r.doc_id < 200 or r.doc_id == 901)
    one, two = toxicity.train(df.repartition(5), labels), toxicity.train(df.repartition(2), labels)
    assert one[0] == pytest.approx(two[0]) and np.allclose(one[1], two[1])
    assert toxicity.train(df, labels.limit(0))[0] == 0.0 and toxicity.train(df, labels.where("toxic = 1"))[0] == 40.0
    assert toxicity.score_toxicity(df.limit(0), one).count() == 0


def test_toxicity_fit(spark):
    """Features, log-count ratios and scores against plain Python."""
    texts = [prose(k, 6 + k % 3) + (" ärgernis" if k % 3 == 0 else "") + (" 🙂🙂🙂🙂🙂" if k % 5 == 0 else "") for k in range(60)] + ["", "abc", "abcd"]
    y = [int(k % 3 == 0) for k in range(60)] + [0, 0, 0]

    def features(t):
        t, out = t.lower(), set()
        for k in toxicity.ORDERS:
            for a in range(len(t) - k + 1):
                h = 0
                for c in t[a : a + k]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                h = ((h ^ (k - 1 << 56)) * 0x9E3779B97F4A7C15) % 2**64
                out.add(((h ^ h >> 32) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - toxicity.BITS))
        return out

    sets = [features(t) for t in texts]
    doc, f = toxicity.grams(texts)
    assert [sorted(f[doc == k].tolist()) for k in range(len(texts))] == [sorted(s) for s in sets]
    n, p = len(y), sum(y)
    known = {}
    for x in set().union(*sets):
        n1, n0 = (sum(x in s for s, v in zip(sets, y, strict=True) if v == label) for label in (1, 0))
        g = sum(2 * o * np.log(o * n / (row * col)) for o, row, col in ((n1, n1 + n0, p), (n0, n1 + n0, n - p), (p - n1, n - n1 - n0, p), (n - p - n0, n - n1 - n0, n - p)) if o)
        r = np.log(((n1 + 1) / (p + 2)) / ((n0 + 1) / (n - p + 2)))
        if n1 + n0 >= 3 and g >= toxicity.SIGNIFICANT and abs(r) >= toxicity.TELLING:
            known[x] = r
    order = sorted(known)
    rows = [np.array([i for i, x in enumerate(order) if x in s], np.int64) for s in sets]
    at = sorted(range(n), key=lambda k: (y[k], np.array(order, np.int32)[rows[k]].tobytes()))
    bias, w = toxicity.fit([rows[k] for k in at], [y[k] for k in at], np.array([known[x] for x in order]))
    bias += toxicity.shift([rows[k] for k in at], [y[k] for k in at], len(order))
    got_bias, got = toxicity.train(make(spark, [(k, t, None, None) for k, t in enumerate(texts)]), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    assert got_bias == pytest.approx(bias) and np.flatnonzero(got).tolist() == [x for x, v in zip(order, w, strict=True) if v] and np.allclose(got[order], w, atol=1e-6)
    scores = [r.score for r in toxicity.score_toxicity(make(spark, [(k, t, None, None) for k, t in enumerate(texts)]), (got_bias, got)).orderBy("doc_id").collect()]
    assert scores == pytest.approx([1 / (1 + np.exp(-(bias + sum(w[i] for i in x)))) for x in rows], abs=1e-5)


def test_toxicity_shift():
    """At the threshold, by models of the other parts: few clean texts, and the toxic ones that are above them."""
    r = np.random.default_rng(0)
    y = [0] * 600 + [1] * 200
    features = [np.unique(np.concatenate((r.integers(0, 300, 20), r.integers(300, 312, 2) if (k >= 600 and r.random() < 0.9) or r.random() < 0.002 else []))).astype(np.int64) for k in range(800)]
    b = toxicity.shift(features, y, 312)
    scores = np.zeros(800)
    for k in range(3):
        own, rest = [i for i in range(800) if i % 3 != k], [i for i in range(800) if i % 3 == k]
        n0, n1 = (np.bincount(np.concatenate([features[i] for i in own if y[i] == v]), minlength=312) for v in (0, 1))
        toxic = sum(y[i] for i in own)
        used = np.flatnonzero(toxicity.telling(n0, n1, len(own), toxic))
        place = {f: j for j, f in enumerate(used.tolist())}
        bias, w = toxicity.fit([np.array([place[f] for f in features[i].tolist() if f in place], np.int64) for i in own], [y[i] for i in own], toxicity.log_ratio(n0[used], n1[used], len(own), toxic))
        for i in rest:
            scores[i] = bias + sum(w[place[f]] for f in features[i].tolist() if f in place)
    p = 1 / (1 + np.exp(-(scores + b)))
    assert (p[:600] >= toxicity.THRESHOLD).mean() <= toxicity.FALSE_ALARMS and (p[600:] >= toxicity.THRESHOLD).mean() > 0.8
    assert toxicity.shift(features[:3], [0, 0, 0], 312) == 0.0


def test_packing(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a  b", "a \nb", " x", "", None, "a\x1cb c", "don't  stop", "1 2\t 3\n\n4 é!", "<|endoftext|> a\nb", "x <|endoftext|><|endoftext|>  y", "<|endoftext", prose(1, 3000)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got: dict = {}
    for r in packing.pack(make(spark, [(k, t, None, None) for k, t in enumerate(texts)])).orderBy("doc_id", "start").collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.start == len(got.get(r.doc_id, b"")) // 4
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    for k, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[k] == struct.pack(f"<{len(ids)}I", *ids)
    assert got[8][:4] == struct.pack("<I", 50256)
    packing.write_buckets(packing.pack(make(spark, [(k, t, None, None) for k, t in enumerate(texts)])), f"{tmp_path}/pieces")
    stored = spark.read.parquet(f"{tmp_path}/pieces")
    assert stored.where("length != 1 << bucket").count() == 0 and stored.count() == sum(len(packing.decompose(len(x) // 4)) for x in got.values())
    assert packing.pack(make(spark, [])).count() == 0
    assert packing.decompose(5000) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8)]
