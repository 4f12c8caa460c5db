"""Kept runs, stored mixtures, terms, draws, tournaments and backfill against brute force."""

import json
import random
import re
import time
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mixscreen.functions import uniform
from mixscreen.operators import features, mixture, reports, screen, select, variants
from mixscreen.plans import runs
from mixscreen.plans.screening import BY_CATALOG, DERIVED, screened, slim, stored
from mixscreen.sources import files
from mixscreen.sources.catalog import BANNED, FEATURES, PROPERTIES, catalog, ingredients, local, profiles, targets

HEADER = "candidate_id long, archetype string, source string, tags array<string>"
LINES = "candidate_id long, code string, amount double"
CODES = [r["code"] for r in ingredients()]


def mixtures(spark, n, seed=1, hot=0):
    r = random.Random(seed)
    names = list(targets())
    h = [(k, names[k % 13], "x", ["LOW_HAZARD_GATE"] if k % 3 else []) for k in range(n)]
    own = [(k, r.choice(CODES), float(r.randrange(1, 9))) for k in range(n) for _ in range(r.randrange(1, 7))]
    own += [(5, r.choice([*CODES[:6], "NO_SUCH", "LEADED"]), 1.0) for _ in range(hot)]
    return spark.createDataFrame(h, HEADER), spark.createDataFrame(own, LINES)


def texts(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.drop("components").dtypes]).collect())


def test_stored_mixtures_need_no_exchange(spark):
    header, lines = mixtures(spark, 60, hot=400)
    with files.scope(spark):
        h, own = stored(header, lines, 3)
        assert own.where("candidate_id = 5").count() <= 14  # added up by code
        df = screened(h, own, dealt=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Exchange range" not in plan and plan.count("FileScan") == 2 and "Bucketed: true" in plan
        got, path = texts(df), re.search(r"file:(/tmp/\S*?/mixscreen-[0-9a-f]+)", plan.replace("...", ""))
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("mixscreen_")]
        assert len(names) == 2
    assert got == texts(screened(header, lines)) and len(got) == 60
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("mixscreen_")] and (path is None or not Path(path[1]).exists())
    plan = screened(header, lines)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hash", plan)) <= 2  # lines and header, once each
    row = json.loads(next(x for x in got if json.loads(x)["candidate_id"] == 5))
    assert row["reject_reason"] == "banned_token:LEAD"


def test_scopes(spark):
    root = files.root(spark).removeprefix("file://")
    with pytest.raises(RuntimeError), files.scope(spark):
        outer = files.written(spark.range(3))
        with files.scope(spark):
            inner = files.written(spark.range(4))
            there = set(Path(root).iterdir())
            assert inner.count() == 4
        assert len(there - set(Path(root).iterdir())) == 1 and outer.count() == 3
        raise RuntimeError
    assert not {p for p in there if p.name.startswith("mixscreen-") and "runs" not in p.name} & set(Path(root).iterdir()) or files._SCOPES == []


def test_kept_runs(spark, tmp_path):
    header, lines = mixtures(spark, 80)
    header.write.parquet(str(tmp_path / "h"))
    lines.write.parquet(str(tmp_path / "l"))
    paths, made = [f"file://{tmp_path}/h", f"file://{tmp_path}/l"], []

    def make():
        made.append(1)
        return screened(spark.read.parquet(paths[0]), spark.read.parquet(paths[1]))

    a = runs.kept_run(spark, paths, make, seed=1)
    b = runs.kept_run(spark, paths, make, seed=1)
    assert len(made) == 1 and a.path == b.path and b.manifest == a.manifest and a.manifest["parameters"] == {"seed": 1}
    whole = slim(make())
    assert texts(a.rows) == texts(whole)
    want = whole.agg(*[F.expr(sql).alias(c) for c, sql in runs.COUNTS.items()]).first()
    assert a.counts().first() == want and want.n_rows == 80 and want.n_passed + want.rejected_or_review == 80
    assert a.gate_summary().first() == reports.gate_summary(whole).first()
    assert runs.kept_run(spark, paths, make, seed=2).path != a.path
    spark.createDataFrame([(900, "STONE", "x", [])], HEADER).write.mode("append").parquet(paths[0])
    c = runs.kept_run(spark, paths, make, seed=1)  # an input has changed
    assert c.path != a.path and c.manifest["counts"]["n_rows"] == 81
    Path(c.path.removeprefix("file://"), "manifest.json").unlink()  # as if it had broken off
    again = len(made)
    c = runs.kept_run(spark, paths, make, seed=1)
    assert c.rows.count() == 81 and len(made) == again + 1
    out = runs.write_reports(c, f"file://{tmp_path}/reports")
    assert out["decisions"].count() == 81 and out["champions"].count() <= 13 and out["gate"].first().n_rows == 81 and {p.name for p in (tmp_path / "reports").iterdir()} >= {*out, "manifest.json"}
    a.delete()
    assert not Path(a.path.removeprefix("file://")).exists()
    runs.delete_runs(spark)
    assert not Path(c.path.removeprefix("file://")).exists()


@pytest.mark.parametrize("other", [False, True])
def test_runs_are_narrow(spark, tmp_path, other):
    """What can be computed again of a row isn't stored, and comes out the same, also by another catalog."""
    header, lines = mixtures(spark, 90, hot=3)
    header.write.parquet(str(tmp_path / "h"))
    cat = catalog(spark).withColumn("code", F.when(F.col("position") == 1, "IT'S \\ A \"CODE\"").otherwise(F.col("code"))).withColumn("low_hazard", F.col("low_hazard") * 0.7) if other else catalog(spark)
    lines = lines.unionByName(spark.createDataFrame([(k, "IT'S \\ A \"CODE\"", 2.0) for k in range(20)], LINES))
    run = runs.kept_run(spark, [f"file://{tmp_path}/h"], lambda: screened(header, lines, cat), cat, seed=int(other))
    assert not {*DERIVED, *BY_CATALOG} & set(run.stored.columns) and {"score", "hash16", "signature", "components", "safe_containment"} <= set(run.stored.columns)
    whole = slim(screened(header, lines, cat))
    assert run.rows.columns == whole.columns and texts(run.rows) == texts(whole) and run.rows.dtypes == whole.dtypes
    exact = ["candidate_id", *DERIVED, "score", "components"]
    again = slim(screen.joint_metrics(mixture.with_shown(run.stored)).withColumns({c: F.lit(0) for c in BY_CATALOG}))
    assert sorted(map(str, again.select(exact).collect())) == sorted(map(str, run.rows.select(exact).collect()))
    assert runs.kept_run(spark, [f"file://{tmp_path}/h"], lambda: screened(header, lines), seed=int(other)).path != run.path


def test_reports_of_picked_rows(spark, tmp_path, monkeypatch):
    """Reports of the best are made of few rows, and are those of all; rejected rows are those of the decisions."""
    header, lines = mixtures(spark, 400)
    header.write.parquet(str(tmp_path / "h"))
    monkeypatch.setattr(runs, "TOP", 4)
    run = runs.screen_run(header, lines, [f"file://{tmp_path}/h"])
    picked = select.leaders(run.rows, 4)
    assert picked.count() <= 5 * 13 and "energy_conversion" not in (plan := picked._jdf.queryExecution().executedPlan().toString()) and "expert_gate" not in plan
    want = {name: texts(df) for name, df in runs.report_set(run).items()}
    seen, whole = [], runs.report_set
    monkeypatch.setattr(runs, "report_set", lambda run, best=None: seen.append(best.count()) or whole(run, best))
    out = runs.write_reports(run, f"file://{tmp_path}/reports")
    assert {name: texts(df) for name, df in out.items()} == want and 0 < seen[0] <= 5 * 13
    assert all(len(want[name]) > 0 for name in want)


def test_swept(spark, tmp_path):
    """Shuffle files go as the query ends."""
    own = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    write = lambda n: spark.range(5000).groupBy((F.col("id") % n).alias("k")).count().write.parquet(str(tmp_path / str(n)))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    write(7)
    kept = own()
    with files.swept(spark):
        write(11)
        for _ in range(50):
            if own() <= kept:
                break
            time.sleep(0.2)
    assert 0 < own() <= kept and spark.conf.get(key, None) == before and spark.read.parquet(str(tmp_path / "11")).count() == 11


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], HEADER).write.parquet(str(tmp_path / "h"))
    paths = [f"file://{tmp_path}/h"]
    run = runs.kept_run(spark, paths, lambda: screened(spark.read.parquet(paths[0]), spark.createDataFrame([], LINES)))
    none = runs.kept_run(spark, paths, lambda: screened(spark.createDataFrame([], HEADER), spark.createDataFrame([], LINES)), seed=0)
    assert none.rows.count() == 0 and none.counts().first().n_rows == 0
    assert run.rows.count() == 0 and set(run.counts().first().asDict().values()) == {0}


@pytest.mark.parametrize("whole", [False, True])
def test_terms(spark, whole):
    r = random.Random(4)
    terms = ["AB", "ABC", "B", "CAB", "A.C", "X-Y", "BCA", "CC_", "Z"]
    own = ["".join(r.choice("abcABC .-_xyXYz") for _ in range(r.randrange(0, 12))) for _ in range(600)] + ["", None, "ABC", "xABCx", "A.C", "AxC", "cab", "ab c"]
    df = spark.createDataFrame(list(enumerate(own)), "id int, text string")
    for some in (terms, terms[1:4], ["Z"], BANNED.split()):
        got = {x.id: x.t for x in df.select("id", screen.first_term(F.col("text"), some, whole).alias("t")).collect()}
        for k, text in enumerate(own):
            found = [t for t in some if (re.search(rf"\b{re.escape(t)}\b", (text or "").upper()) if whole else t in (text or "").upper())]
            assert got[k] == min(found, default=None), (text, some)


def test_vectors(spark):
    """Averages and shares of any catalog, against sums by hand."""
    r = random.Random(9)
    rows = [(k, f"C{k}", r.choice(["mineral", "carbon", "meta_engine"]), r.choice(["mineral", "sorbent", "engine", "matrix"]), *(r.random() for _ in PROPERTIES)) for k in range(7)]
    cat = local(spark, rows, "position int, code string, family string, role string, " + ", ".join(f"{p} double" for p in PROPERTIES))
    h = spark.createDataFrame([(k, "STONE", "x", []) for k in range(20)], HEADER)
    lines = [(k, f"C{r.randrange(9)}", float(r.randrange(-1, 5))) for k in range(20) for _ in range(6)]
    book = features.Book(cat)
    got = {x.candidate_id: x for x in features.measured(mixture.packed(h, spark.createDataFrame(lines, LINES), book, default="C3"), book).collect()}
    by = {row[1]: row for row in rows}
    for k in range(20):
        own: dict = {}
        for i, c, a in lines:
            if i == k and a > 0 and c in by:
                own[c] = own.get(c, 0) + a
        own = own or {"C3": 1.0}
        share = {c: a / sum(own.values()) for c, a in own.items()}
        assert got[k].max_share == pytest.approx(max(share.values())) and got[k].n_components == sum(s > 0.008 for s in share.values())
        for j, p in enumerate(PROPERTIES):
            assert got[k][f"w_{p}"] == pytest.approx(sum(s * by[c][4 + j] for c, s in share.items()))
        has = lambda c, x: int(x in by[c][2:4])
        assert got[k].sorbent_like == pytest.approx(sum(s * (has(c, "sorbent") + has(c, "carbon")) for c, s in share.items()))
        assert got[k].mineral_like == pytest.approx(sum(s * has(c, "mineral") for c, s in share.items())) and got[k].s_engine == pytest.approx(sum(s * has(c, "engine") for c, s in share.items()))
    with pytest.raises(ValueError, match="not in the catalog"):
        mixture.packed(h, h.select("candidate_id"), book)
    with pytest.raises(ValueError, match="twice"):
        features.Book(cat.unionByName(cat))


def test_other_catalog_and_profiles(spark):
    """Another catalog lets the hazard rule fire; unknown profiles have the default's weights, other profiles their own."""
    h, lines = mixtures(spark, 130)
    cat = catalog(spark).withColumn("low_hazard", F.col("low_hazard") * 0.5)
    got = screened(h, lines, cat).where("reject_reason = 'hazard_score_too_low'")
    assert got.count() > 0
    own = profiles(spark).where("archetype IN ('UNIVERSAL', 'STONE')").withColumn("w_low_hazard", F.lit(0.5))
    rows = {r.candidate_id: r for r in screened(h, lines, targets=own).where("reject_reason IS NULL").collect()}
    weights = {r.archetype: r for r in own.collect()}
    for r in rows.values():
        of = weights[r.archetype if r.archetype in weights else "UNIVERSAL"]
        if r.archetype not in ("UNIVERSAL", "CANVAS", "STAGEKEEPER", "DEMIURGE", "WORLD_REWRITER"):
            assert r.base_score == pytest.approx(min(1.0, sum(of[f"w_{f}"] * r[f] for f in FEATURES)))
            assert (r.description == "") == (r.archetype not in weights) and r.ordinal == of.ordinal


def test_dated_requests(spark):
    h, lines = mixtures(spark, 40)
    rows = slim(screened(h, lines)).withColumn("day", F.date_add(F.lit(date(2024, 1, 1)), F.col("candidate_id").cast("int")))
    for day, want in ((F.col("day"), None), (date(2023, 5, 6), "20230506"), ("text", "text")):
        own = {r.hash16: r.request_id for r in reports.review_requests(rows, n=1, replicates=1, day=day).collect()}
        days = {r.hash16: r.day.strftime("%Y%m%d") for r in rows.collect()}
        assert own and all(i.split("-")[1] == (want or days[x]) for x, i in own.items())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 48, 63])
def test_draws(spark, n):
    r = random.Random(n)
    weights = [(k, f"C{k}", r.random() + 0.01) for k in range(n)]
    df = spark.createDataFrame(weights, "position int, code string, weight double").withColumn("g", F.lit("a"))
    us = [0.0, 1e-12, 0.5, 1 - 2**-32] + [r.random() for _ in range(200)]
    rows = spark.createDataFrame([("a", u) for u in us], "g string, v double")
    got = {x.v: x.drawn for x in variants.weighted_draw(rows, variants.cumulative(df, ["g"]), ["g"], F.col("v")).collect()}
    ups, total = [], 0.0
    for _, _, w in weights:
        total += w
        ups.append(total)
    assert got == {u: f"C{next(k for k, x in enumerate(ups) if x >= u * total)}" for u in us}


def test_tournament(spark):
    r = random.Random(3)
    rows = [(k, "BIG" if k % 5 else "FEW" if k % 50 else "ONE", f"h{k % 3}", r.randrange(6) / 10) for k in range(700)]
    rows = [x for x in rows if x[1] != "FEW" or x[0] < 40]
    df = spark.createDataFrame(rows, "candidate_id long, archetype string, hash16 string, score double")
    place = {x.candidate_id: x.u for x in df.select("candidate_id", uniform(F.lit(7), "candidate_id", F.lit("ring")).alias("u")).collect()}
    names = {x[1] for x in rows}
    start = {(x.a, x.k): x.u for x in spark.createDataFrame([(a, k) for a in names for k in range(30)], "a string, k int").select("a", "k", uniform(F.lit(7), "a", "k").alias("u")).collect()}
    want, sizes = {}, []
    for a in names:
        own = [x for x in rows if x[1] == a]
        for k in range(30):
            inside = [x for x in own if (place[x[0]] - start[a, k]) % 1.0 < 9 / len(own)]
            sizes.append((a, len(inside)))
            if inside:
                want[a, k] = min(inside, key=lambda x: (-x[3], x[2], x[0]))[0]
    got = {(x.archetype, x.slot): x.candidate_id for x in variants.tournament(df.repartition(5), 30, seed=7).collect()}
    assert got == want and all(s == 7 for a, s in sizes if a == "FEW")
    big = [s for a, s in sizes if a == "BIG"]
    assert 6 < sum(big) / len(big) < 12


def test_fill_makes_what_is_missing(spark):
    """Turns are taken in order, whatever the rounds; rows that are made follow what is missing."""
    names = ["ENERGY", "HEALER", "LIFE", "STONE"]
    header = spark.createDataFrame([(a,) for a in names for _ in range(50)], "archetype string")
    kept = spark.createDataFrame([("ENERGY", "s1"), ("ENERGY", "s2"), ("ENERGY", "s3"), ("HEALER", "s0")], "archetype string, signature string")
    made = []

    def screen(h, lines):
        made.append(h.count())
        assert lines.select("candidate_id").distinct().count() == made[-1]
        turn = F.floor((-F.col("candidate_id") - 1) / 4)
        score = F.when((F.col("archetype") == "LIFE") | (turn % 3 == 0), 0.0).otherwise(0.5)
        return h.select("archetype", F.concat(F.lit("s"), (turn % 7).cast("string")).alias("signature"), score.alias("score"), F.lit("h").alias("hash16"), "candidate_id")

    def want(a, place, have, need, tries):
        out, seen = [], set(have)
        for k in range(tries):
            if len(out) + len(have) < need and k % 3 and a != "LIFE" and f"s{k % 7}" not in seen:
                seen.add(f"s{k % 7}")
                out.append((a, len(out) + 1, -(k * 4 + place) - 1))
        return out

    for need, tries, first, growth in ((3, 40, 2, 4), (5, 40, 1, 2), (9, 25, 3, 5), (3, 1, 2, 4)):
        made.clear()
        got = sorted(tuple(r) for r in variants.fill(kept, header, catalog(spark), screen, need, tries, 1, first, growth).select("archetype", "rank", "candidate_id").collect())
        own = {"ENERGY": ["s1", "s2", "s3"], "HEALER": ["s0"], "LIFE": [], "STONE": []}
        assert got == sorted(x for k, a in enumerate(names) for x in want(a, k, own[a], need, tries))
        assert sum(made) <= 4 * tries
        if need == 3 and tries == 40:
            assert sum(made) - 40 < 40  # beside the profile that can't be filled, at most a few times what is missing
    none = kept.unionByName(spark.createDataFrame([(a, f"t{k}") for a in names for k in range(9)], "archetype string, signature string"))
    assert variants.fill(none, header, catalog(spark), screen, 3, 10).count() == 0
