import itertools
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, prose

import corpus_pipeline
from mixscreen.llm import common, language_id, line_dedup, mixing, packing, toxicity, unionfind

DATA = "/root/testdata/sf0.01"


def wrapped(text, first, size=6):
    """The words of a text in lines of `size`, the first line shorter."""
    w = text.split()
    return "\n".join(" ".join(x) for x in [w[:first], *(w[k : k + size] for k in range(first, len(w), size))])


def joined(nodes, same):
    forest = unionfind.Forest()
    for a, b in itertools.combinations(nodes, 2):
        if same(a, b):
            forest.join(a, b)
    return forest


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def toxic(text, model):
    bias, weights = model
    _, found = toxicity.grams([text or ""])
    return 1 / (1 + np.exp(-(bias + weights[found].sum()))) >= toxicity.THRESHOLD


def without_copied_lines(rows):
    lines = {(i, n): " ".join(x.lower().split()) for i, t in rows for n, x in enumerate((t or "").split("\n"))}
    lines = {p: x for p, x in lines.items() if x}
    sets = {p: {x[k : k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for p, x in lines.items()}
    forest = joined(sorted(lines), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    gone = {p for p in lines if forest.find(p) != p}
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) if t is not None else None) for i, t in rows]


def without_near_copies(rows):
    texts = {i: t or "" for i, t in rows}
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    forest = joined(sorted(texts), lambda a, b: texts[a] == texts[b] or jaccard(sets[a], sets[b]) >= 0.8)
    return [(i, t) for i, t in rows if forest.find(i) == i]


def packed(rows):
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in rows:
        ids = [*encode(t or ""), 1]
        at = 0
        while at < len(ids):
            n = 2048
            while n > len(ids) - at:
                n //= 2
            yield i, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids), 0
            at += n


def test_pipeline_brute_force(spark, tmp_path):
    footer = prose(900, 40)
    changed = footer.replace(footer.split()[20], "another9", 1)
    rows = [(k, wrapped(prose(k, 60 + k) + (" vilewords here" * 2 if k % 2 else ""), 5)) for k in range(40)]
    rows += [(100 + k, wrapped(prose(2 * k, 60 + 2 * k), 2)) for k in range(6)]  # the words of other texts in other lines
    rows += [(200 + k, f"{wrapped(prose(700 + k, 50), 4)}\n{changed if k == 2 else footer}") for k in range(4)]
    rows += [(300, rows[4][1]), (301, None), (302, ""), (303, prose(950, 3000)), (304, "short")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, labels = common.read(spark, str(tmp_path), "documents"), common.read(spark, str(tmp_path), "labels")
    model = toxicity.train(docs, labels.where(common.remainder("doc_id", 3) != 1))
    clean = [(i, t) for i, t in rows if not toxic(t, model)]
    assert 0 < len(clean) < len(rows)
    lines = without_copied_lines(clean)
    assert sum(a != b for a, b in zip(clean, lines, strict=True)) >= 4
    kept = without_near_copies(lines)
    assert len(lines) - len(kept) >= 6
    want = sorted(packed(kept))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got)


def test_pipeline_follows_the_mix(spark, tmp_path):
    rows = [(k, prose(2000 + k, 20 + (k * 37) % 300), f"s{k % 7 % 3}") for k in range(300)] + [(300, prose(2300, 3000), "s0")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    want = [r.doc_id for r in mixing.mix_sources(docs).orderBy("mix_position").collect()]
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.sequence_id)
    assert [r.doc_id for r in got if r.start == 0] == want
    assert [i for i, _ in itertools.groupby(r.doc_id for r in got)] == want  # a document's pieces follow each other
    assert all(b.start == a.start + a.length for a, b in itertools.pairwise(got) if a.doc_id == b.doc_id)
    assert len({r.sequence_id for r in got}) == len(got)


def test_near_copies_by_row(spark):
    a, b, c, d = (prose(k, 120) for k in (851, 852, 853, 854))
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(a.split()))
    rows = [(1, a, "s"), (1, a, "r"), (2, near, "s"), (2, b, "s"), (None, near, "s"), (None, a, "s"), (None, c, "s"), (None, c, "s"), (None, d, "s"), (4, d, "s"), (5, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).withColumns({c: F.lit(1) for c in ("id_", "gone_", "digest_", "digest", "root", "n", "__i")})
    got = sorted((r.doc_id or 0, r.text, r.source) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(1, a, "r"), (2, b, "s"), (0, c, "s"), (4, d, "s"), (5, "", "s")])


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out(spark):
    docs = common.read(spark, DATA, "documents")
    found = language_id.op5_cross_parsing(spark, DATA).where("held_out").join(docs.where("lang is not null and length(text) > 20").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.9
    larger = DATA.replace("sf0.01", "sf0.1")  # has as many labels as the fit takes
    scored = toxicity.op9_toxicity(spark, larger).where("held_out").join(common.read(spark, larger, "labels").where("toxic is not null"), "doc_id").toPandas()
    pos, neg = (scored[scored.toxic == k].score.to_numpy() for k in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.75 and (neg >= toxicity.THRESHOLD).mean() < 0.02
