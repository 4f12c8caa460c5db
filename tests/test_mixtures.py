import csv
import hashlib
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mixscreen.operators import mixture, reports, screen, select, variants
from mixscreen.plans.screening import screened, slim
from mixscreen.sources import files
from mixscreen.sources.catalog import FEATURES, catalog, ingredients, targets

HEADER = "candidate_id long, archetype string, source string, tags array<string>"
LINES = "candidate_id long, code string, amount double"

GOLDEN = Path(__file__).with_name("data") / "champions.csv"  # fixed values: published example mixtures and their results


def test_catalog():
    assert len(ingredients()) == 48 and len(targets()) == 13
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in targets().values())


def test_examples(spark):
    """All published examples: inputs are archetype, tags and components."""
    with GOLDEN.open(newline="") as f:
        want = list(csv.DictReader(f))
    h = spark.createDataFrame([(k, r["archetype"], "mutated", r["process_tags"].split()) for k, r in enumerate(want)], HEADER)
    lines = spark.createDataFrame([(k, c, x) for k, r in enumerate(want) for c, x in json.loads(r["components_json"]).items()], LINES)
    got = {r.candidate_id: r for r in reports.flat(slim(screened(h, lines))).collect()}
    assert len(got) == len(want) == 13
    for k, row in enumerate(want):
        for c, x in row.items():
            if c == "components_json":
                assert json.loads(got[k][c]) == pytest.approx(json.loads(x), abs=1e-15)
            elif c in ("formula_percent", "archetype", "process_tags", "gate_status", "gate_reason"):
                assert got[k]["formula" if c == "formula_percent" else c] == x, (k, c)
            else:
                assert got[k][c] == pytest.approx(float(x), abs=1.5e-6), (k, c)
    notes = json.loads(got[11]["notes_json"])
    assert list(notes) == ["archetype", "archetype_description", "rejected", "reject_reason", "boundary", *reports.CLAIMS, "demiurge_layer", "birth_gate_layer", "gate_status", "gate_reason"]
    assert notes["demiurge_layer"] is True and notes["rejected"] is False and notes["reject_reason"] == ""


def test_texts(spark):
    """Canonical texts and per cent as printf and repr have them: exact values, ties to even."""
    shares = [1 / 128, 1 / 640, 0.1234565, 0.125, 0.05, 1 / 3, 0.33335, 0.999999]
    h = spark.createDataFrame([(k, "STONE", "x", ["B", "A"] if k else []) for k in range(len(shares))], HEADER)
    rows = [(k, c, x) for k, v in enumerate(shares) for c, x in (("PVA_FILM", v), ("ZEOLITE_SAFE", 1 - v))]
    got = {r.candidate_id: r for r in mixture.keys(h, spark.createDataFrame(rows, "candidate_id long, code string, frac double"), prefix="P_").collect()}
    for k, v in enumerate(shares):
        text = f"P_STONE PVA_FILM:{v:.6f} ZEOLITE_SAFE:{1 - v:.6f} {'A B' if k else ''}"
        assert got[k].fingerprint == text and got[k].hash16 == hashlib.sha256(text.encode()).hexdigest()[:16]
        parts = sorted([("PVA_FILM", v), ("ZEOLITE_SAFE", 1 - v)], key=lambda p: -p[1])
        assert got[k].formula == "; ".join(f"{c}={round(x * 100, 2)}%" for c, x in parts)


def test_screened_edges(spark):
    """Mixtures without lines or known codes, unknown profiles, banned terms in tags, sources and raw codes."""
    h = [(1, "STONE", "x", []), (2, "STONE", "x", []), (3, "NOBODY", "x", []), (4, "UNIVERSAL", "x", []), (5, "STONE", "x", ["AMALGAM"]), (6, "STONE", "cyanide salt", []), (7, "STONE", "x", ["B"])]
    some = [("BACTERIAL_CELLULOSE_MATRIX", 2.0), ("ZEOLITE_SAFE", 1.0), ("BIOCHAR_SAFE", 1.0)]
    lines = [(1, "NO_SUCH", 5.0), (1, "PVA_FILM", -1.0)] + [(k, c, x) for k in (3, 4, 5, 6, 7) for c, x in some] + [(7, "MERCURY_SALT", 1.0), (7, "ARSENIC_SALT", 0.0)]
    got = {r.candidate_id: r for r in screened(spark.createDataFrame(h, HEADER), spark.createDataFrame(lines, LINES)).collect()}
    assert len(got) == 7
    assert got[1].components == got[2].components == {"BACTERIAL_CELLULOSE_MATRIX": 1.0} and got[1].reject_reason == "single_component_collapse:1.000"
    assert got[1].w_density == got[2].w_density == 1.35 and got[1].matrix_like == 1
    assert got[3].reject_reason is None and got[3].description == ""
    # the default profile's weights hold, but not its penalties
    weights = targets()["UNIVERSAL"]
    assert got[3].base_score == pytest.approx(sum(w * got[3][f] for f, w in weights.items())) and got[4].base_score <= got[3].base_score
    assert [got[k].reject_reason for k in (5, 6, 7)] == ["banned_token:AMALGAM", "banned_token:CYANIDE", "banned_token:ARSENIC"]
    assert all(got[k].gate_status == "REJECTED" and got[k].base_score == 0 for k in (5, 6, 7))
    empty = screened(spark.createDataFrame([], HEADER), spark.createDataFrame([], LINES))
    assert empty.count() == 0 and reports.gate_summary(slim(empty)).first().n_rows == 0


def test_reject_rules(spark):
    """Each rule by itself, at and beyond its bound; the first one wins."""
    fine = {"max_share": 0.3, "n_components": 9, "canvas_like": 0.5, "engine_like": 0.5, "safety_gate_like": 0.5, "matrix_like": 0.5, "catalyst_like": 0.1, "s_advanced": 0.1} | {f"w_{f}": 0.9 for f in FEATURES}
    cases = [
        ("STONE", {}, None), ("STONE", {"term": "LEAD", "max_share": 0.9}, "banned_token:LEAD"), ("STONE", {"max_share": 0.62}, None), ("STONE", {"max_share": 0.6204}, "single_component_collapse:0.620"), ("DEMIURGE", {"max_share": 0.57}, "single_component_collapse:0.570"),
        ("STONE", {"n_components": 2}, "not_enough_components"), ("STONE", {"n_components": 3}, None), ("WORLD_REWRITER", {"n_components": 4}, "not_enough_components"), ("CANVAS", {"canvas_like": 0.2}, "canvas_layer_floor"), ("STONE", {"canvas_like": 0.0}, None),
        ("CANVAS", {"w_surface_readiness": 0.2}, "canvas_surface_floor"), ("STAGEKEEPER", {"w_signal_clarity": 0.2}, "canvas_signal_floor"), ("STAGEKEEPER", {"w_safe_containment": 0.37}, "stagekeeper_containment_floor"), ("CANVAS", {"w_safe_containment": 0.37}, None),
        ("DEMIURGE", {"engine_like": 0.2}, "demiurge_engine_floor"), ("DEMIURGE", {"w_rule_rewriting": 0.19}, "demiurge_rule_rewriting_floor"), ("DEMIURGE", {"w_rule_rewriting": 0.3}, None), ("WORLD_REWRITER", {"w_rule_rewriting": 0.3}, "demiurge_rule_rewriting_floor"),
        ("DEMIURGE", {"w_closed_loop_learning": 0.25}, "demiurge_closed_loop_floor"), ("WORLD_REWRITER", {"w_closed_loop_learning": 0.25}, None), ("DEMIURGE", {"safety_gate_like": 0.02}, "demiurge_requires_safety_gate"),
        ("STONE", {"matrix_like": 0.03}, "not_enough_body_matrix"), ("CATALYST", {"matrix_like": 0.03}, None), ("STONE", {"catalyst_like": 0.7}, "too_much_catalyst_phase"), ("LIFE", {"s_advanced": 0.33}, "too_much_expert_only_advanced_phase"),
        ("ENERGY", {"w_low_hazard": 0.42}, "hazard_score_too_low"), ("ENERGY", {"w_low_hazard": 0.43}, None), ("DEMIURGE", {"w_low_hazard": 0.1}, None), ("CANVAS", {"canvas_like": 0.2, "w_signal_clarity": 0.1}, "canvas_layer_floor"),
    ]
    rows = [(k, a, c.get("term"), *(float(v) for v in (fine | {x: y for x, y in c.items() if x != "term"}).values())) for k, (a, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, archetype string, term string, " + ", ".join(f"{c} double" for c in fine))
    got = df.select("id", screen.reject_reason(F.col("term")).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [c[2] for c in cases]


def test_normalize(spark):
    h = spark.createDataFrame([(1, "STONE", "x", []), (2, "STONE", "x", []), (3, "STONE", "x", [])], HEADER)
    rows = [(1, "PVA_FILM", 1.0), (1, "PVA_FILM", 2.0), (1, "ZEOLITE_SAFE", 1.0), (1, "NO_SUCH", 9.0), (1, "BIOCHAR_SAFE", -1.0), (2, "NO_SUCH", 5.0)]
    got = {(r.candidate_id, r.code): r.frac for r in mixture.normalize(h, spark.createDataFrame(rows, LINES), catalog(spark)).collect()}
    assert got == {(1, "PVA_FILM"): 0.75, (1, "ZEOLITE_SAFE"): 0.25, (2, "BACTERIAL_CELLULOSE_MATRIX"): 1.0, (3, "BACTERIAL_CELLULOSE_MATRIX"): 1.0}


def test_gate_branches(spark):
    base = {"creative_potential": 0.5, "safe_containment": 0.5, "containment_integrity": 0.5, "hypothesis_visibility": 0.5, "scene_viability": 0.5, "expert_gate": 0.5, "demiurge_score": 0.5, "canvas_score": 0.5}
    cases = [({}, "STONE", None, "PASSED"), ({"creative_potential": 0.9, "safe_containment": 0.2}, "STONE", None, "REJECTED"), ({"containment_integrity": 0.3}, "STONE", None, "REJECTED"), ({"containment_integrity": 0.3, "hypothesis_visibility": 0.3}, "STONE", None, "REVIEW"), ({"scene_viability": 0.3}, "STONE", None, "REVIEW"), ({"expert_gate": 0.3, "hypothesis_visibility": 0.3}, "STONE", None, "REJECTED"), ({}, "STONE", "x", "REJECTED"), ({"demiurge_score": 0.3}, "DEMIURGE", None, "REVIEW"), ({"canvas_score": 0.3}, "CANVAS", None, "REVIEW")]
    df = spark.createDataFrame([(k, a, why, *(base | c).values()) for k, (c, a, why, _) in enumerate(cases)], "id int, archetype string, reject_reason string, " + ", ".join(f"{c} double" for c in base))
    assert [r.gate_status for r in screen.gate_status(df).orderBy("id").collect()] == [c[3] for c in cases]


def test_samples_do_not_depend_on_partitions(spark):
    h = spark.range(60).selectExpr("id AS candidate_id", "element_at(array('STONE', 'CANVAS', 'DEMIURGE', 'ENERGY'), cast(id % 4 + 1 AS int)) AS archetype")
    got = [sorted((r.candidate_id, r.code, round(r.amount, 12)) for r in variants.sample(h.repartition(n), catalog(spark))[1].collect()) for n in (1, 7)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 60


def test_top_and_files(spark):
    df = spark.createDataFrame([(1, "A", 0.5, "b"), (2, "A", 0.5, "a"), (3, "A", 0.1, "c"), (4, "B", 0.2, "d")], "candidate_id long, archetype string, score double, hash16 string")
    assert [r.candidate_id for r in select.top(df, 1).orderBy("archetype").collect()] == [2, 4]
    assert files.read_csv(spark, "/tmp/no/such/path", ["a", "b"]).count() == 0


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('\ufeffa,b\r\n1,"say ""so"", twice"\r\n,"two\nlines"\r\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()] == [("1", 'say "so", twice'), ("", "two\nlines")]


def test_perturb_drops_the_smallest(spark):
    """At rate 1 the smallest of over five components goes, a drawn one and a tag come, and all amounts change."""
    codes = [r["code"] for r in ingredients()]
    h = spark.createDataFrame([(k, "STONE", "x", ["A"]) for k in range(40)], HEADER)
    shares = [(k, c, (j + 1) / 28) for k in range(40) for j, c in enumerate(codes[: 7 if k % 2 else 3])]
    out, lines = variants.perturb(h, spark.createDataFrame(shares, "candidate_id long, code string, frac double"), catalog(spark), rate=1.0)
    own: dict = {}
    for r in lines.collect():
        own.setdefault(r.candidate_id, {})[r.code] = r.amount
    for k, x in own.items():
        extra = set(x) - {c for j, c, _ in shares if j == k}
        assert len(extra) <= 1 and len(x) == (3 + len(extra) if k % 2 == 0 else 7 if extra else len(x)) and len(x) <= 7  # of eight, or of seven, one goes
        assert k % 2 == 0 or len(x) >= 6
        if k % 2 == 0:
            assert all(0.55 / 28 * (codes.index(c) + 1) <= v <= 1.55 / 28 * (codes.index(c) + 1) + 0.16 for c, v in x.items() if c not in extra)
    assert all(len(r.tags) == 2 and r.source == "mutated" and r.tags == sorted(r.tags) for r in out.collect())


def test_backfill(spark):
    """Each profile gets what it lacks, without signatures that it has; other profiles' signatures don't count."""
    schema = "archetype string, signature string, score double, hash16 string, candidate_id long"
    kept = spark.createDataFrame([("A", "s1", 0.9, "h", 1), ("A", "s2", 0.8, "h", 2), ("B", "s3", 0.5, "h", 3), ("D", "s1", 0.5, "h", 4), ("D", "s2", 0.5, "h", 5), ("D", "s4", 0.5, "h", 6)], schema)
    new = [("A", "s1", 0.99, "h", 10), ("A", "s3", 0.4, "b", 11), ("A", "s3", 0.4, "a", 12), ("A", "s5", 0.3, "h", 13), ("B", "s1", 0.0, "h", 14), ("B", "s1", 0.2, "h", 15), ("B", "s9", 0.1, "h", 16), ("B", "s8", 0.05, "h", 17), ("C", "s1", 0.1, "h", 18), ("D", "s7", 0.9, "h", 19)]
    header = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "archetype string")
    got = variants.backfill(kept, header, spark.createDataFrame(new, schema), 3)
    assert sorted((r.archetype, r["rank"], r.candidate_id) for r in got.collect()) == [("A", 1, 12), ("B", 1, 15), ("B", 2, 16), ("C", 1, 18)]


def test_batch(spark):
    """Routes and parents: perturbed rows keep their parent's codes, blends the codes of two pool rows, all others are sampled."""
    codes = [r["code"] for r in ingredients()]
    pool = spark.createDataFrame([(k, "STONE", k + 1, [f"T{k}"]) for k in range(30)] + [(50, "LIFE", 1, ["L"])], "candidate_id long, archetype string, rank int, tags array<string>")
    shares = spark.createDataFrame([(k, codes[k], 0.4) for k in range(30)] + [(k, codes[(k + 1) % 30], 0.6) for k in range(30)] + [(50, codes[0], 1.0)], "candidate_id long, code string, frac double")
    h = spark.createDataFrame([(1000 + k, ["STONE", "LIFE", "HEALER"][k % 3]) for k in range(600)], "candidate_id long, archetype string")
    heads, parts = variants.batch(h.repartition(5), pool, shares, catalog(spark))
    heads = {r.candidate_id: r for r in heads.collect()}
    assert len(heads) == 600
    counts: dict = {}
    for r in heads.values():
        counts.setdefault(r.archetype, []).append(r.source)
    assert set(counts["HEALER"]) == {"random"} and set(counts["LIFE"]) == {"mutated", "random"}
    share = [counts["STONE"].count(x) / 200 for x in ("mutated", "crossover", "random")]
    assert share == pytest.approx([0.55, 0.27, 0.18], abs=0.1)
    mutants = [min(int(t[1:]) for t in r.tags if t[0] == "T" and t[1:].isdigit()) for r in heads.values() if r.archetype == "STONE" and r.source == "mutated"]
    assert sum(mutants) / len(mutants) < 5  # the best of nine of thirty
    lines: dict = {}
    for r in parts.collect():
        lines.setdefault(r.candidate_id, {})[r.code] = r.amount
    for i, r in heads.items():
        if r.source == "crossover":
            assert sum(lines[i].values()) == pytest.approx(1) and len(r.tags) == 2
    again = variants.batch(h.repartition(2), pool, shares, catalog(spark))[1].collect()
    assert {(r.candidate_id, r.code): round(r.amount, 12) for r in again} == {(i, c): round(x, 12) for i, own in lines.items() for c, x in own.items()}


def test_reports(spark):
    """Ledgers, summaries and requests over screened rows."""
    h = spark.createDataFrame([(k, ["STONE", "CANVAS", "ENERGY"][k % 3], "x", ["LOW_HAZARD_GATE"]) for k in range(60)], HEADER)
    codes = [r["code"] for r in ingredients()]
    rows = slim(screened(h, spark.createDataFrame([(k, codes[(k * 7 + j * 11) % 48], float(1 + (k + j) % 5)) for k in range(60) for j in range(5)], LINES))).cache()
    every = {r.candidate_id: r for r in rows.collect()}
    bad = {i for i, r in every.items() if r.gate_status in ("REJECTED", "REVIEW")}
    assert 0 < len(bad) < 60 and {r.candidate_id for r in reports.rejected(rows).collect()} == bad
    s = reports.run_summary(rows).first()
    assert (s.n_rows, s.rejected_or_review, [c.archetype for c in s.champions]) == (60, len(bad), ["STONE", "ENERGY", "CANVAS"])
    best = {a: min((r for r in every.values() if r.archetype == a), key=lambda r: (-r.score, r.hash16)).candidate_id for a in ("STONE", "CANVAS", "ENERGY")}
    assert {r.archetype: r.best.candidate_id for r in reports.archetype_summary(rows).collect()} == best == {r.archetype: r.candidate_id for r in reports.champions(rows).collect()}
    n = next(r.candidate for r in reports.nested(select.top(rows, 1)).collect() if r.candidate.archetype == "STONE")
    assert n["rank"] == 1 and n.gate.gate_status == every[best["STONE"]].gate_status and n.components == every[best["STONE"]].components and n.notes.rejected == (every[best["STONE"]].reject_reason is not None)
    requests = reports.review_requests(rows, n=2, replicates=2, day=date(2024, 2, 3)).collect()
    one = next(r for r in requests if r.request_id == "RQ-20240203-ENERGY-01-R2")
    assert one.requested_tests.split(" | ") == [*reports.TESTS, "SAFE_CATALYTIC_OR_PHOTO_ELECTROCHEMICAL_MODEL_SCREENING"] and one.why == "spiritus: light/charge/energy conversion"
    assert json.loads(one.objectives_json)["low_hazard"] == pytest.approx(every[best["ENERGY"]].low_hazard, abs=1e-6) and len(json.loads(one.objectives_json)) == 35
    assert len(requests) == 12 and one.claim_boundary.startswith("No literal")
