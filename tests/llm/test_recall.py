"""Recall of the candidate searches against all pairs of the test tables."""

import os

import pytest

from mixscreen.llm import common, jaccard_join, line_dedup, unionfind

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def similar(sets, threshold):
    """(a, b) of all pairs of sets with at least that Jaccard similarity, by way of the values that they share."""
    index: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        common_values: dict = {}
        for x in s:
            for j in index[x]:
                if j < k:
                    common_values[j] = common_values.get(j, 0) + 1
        for j, n in common_values.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold - 1e-12:
                yield j, k


def test_links_of_a_table(spark):
    """op2 on every document of sf0.01: degrees and classes against all pairs of distinct texts."""
    sf = f"{DATA}/sf0.01"
    rows = [(r.doc_id, r.text or "") for r in common.read(spark, sf, "documents").select("doc_id", "text").collect()]
    texts = sorted({t for _, t in rows})
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    degree, forest = [0] * len(texts), unionfind.Forest()
    for a, b in similar(sets, 0.8):
        degree[a] += 1
        degree[b] += 1
        forest.join(a, b)
    number = {t: k for k, t in enumerate(texts)}
    least: dict = {}
    for i, t in rows:
        c = forest.find(number[t])
        least[c] = min(i, least.get(c, i))
    got = {r.doc_id: r for r in jaccard_join.op2_jaccard_join(spark, sf).collect()}
    assert len(got) == len(rows) and sum(degree) >= 10
    links, found = sum(degree[number[t]] for _, t in rows), sum(got[i].n_links for i, _ in rows)
    assert all(got[i].n_links <= degree[number[t]] for i, t in rows) and found >= 0.99 * links
    assert sum(got[i].class_id == least[forest.find(number[t])] for i, t in rows) >= 0.995 * len(rows)


def test_copied_lines_of_a_table(spark):
    """Line dedup of every document of sf0.001: removed lines against all pairs of lines."""
    rows = [(r.doc_id, r.text or "") for r in common.read(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").collect()]
    places: dict = {}
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if p := line_dedup.plain(line):
                places.setdefault(p, []).append((i, n))
    lines, size = sorted(places), line_dedup.SHINGLE
    forest = unionfind.Forest()
    for a, b in similar([{x[k : k + size] for k in range(max(1, len(x) - size + 1))} for x in lines], 0.8):
        forest.join(a, b)
    groups: dict = {}
    for k, p in enumerate(lines):
        groups.setdefault(forest.find(k), []).extend(places[p])
    want = {x for g in groups.values() for x in sorted(g)[1:]}
    fuzzy = {x for g in groups.values() for x in sorted(g)[1:]} - {x for p in places.values() for x in sorted(p)[1:]}
    got = {(r.doc_id, n) for r in line_dedup.line_dedup(common.read(spark, f"{DATA}/sf0.001", "documents")).where("removed_lines IS NOT NULL").collect() for n in r.removed_lines}
    assert len(want) > 100 and len(fuzzy) > 5
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.01 * len(want) and len(got & fuzzy) >= 0.9 * len(fuzzy)
