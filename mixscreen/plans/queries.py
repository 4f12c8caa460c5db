"""Registered queries over the driver's tables.

A mixture is an order: its lines' parts name ingredients (part key modulo the catalog's size), quantities are
amounts, the customer picks the target profile, priority and status give tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evenness, places, tidy, uniform
from ..operators import features, mixture, reports, screen, select, variants
from ..sources import files
from ..sources.catalog import FEATURES, PROPERTIES, banned, catalog, ingredients, phases, target_weights, targets
from ..sources.files import scratch, written
from . import runs
from .screening import rejected, screened, slim, stored, wide_rows

SHARES = ["matrix", "sorbent", "catalyst", "advanced"]
#: Terms that texts have, to be looked for beside the shipped ones.
TERMS = ["LICENSE", "NOT", "THE", "WORTHLESS"]
#: A quarter of one per cent of the orders have a tag with a banned term, one in a hundred an unknown profile.
BAD_TAG, ODD_PROFILE = "LEAD_TEST", "ANY_OTHER"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(a) for a in targets()])
    tags = F.array_compact(F.array(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("LOW_HAZARD_GATE")), F.when(F.col("o_orderstatus") != "P", F.lit("EXPERT_VALIDATION_REQUIRED"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.get(names, (F.col("o_custkey") % 13).cast("int")).alias("archetype"), F.lit("orders").alias("source"), tags.alias("tags"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(r["code"]) for r in ingredients()])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.get(codes, (F.col("l_partkey") % 48).cast("int")).alias("code"), F.col("l_quantity").alias("amount"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.normalize(header(spark, sf_dir), lines(spark, sf_dir), catalog(spark))


def order_run(spark: SparkSession, sf_dir: str) -> runs.Run:
    """The kept screen of all orders, which the reports share."""
    return runs.screen_run(header(spark, sf_dir), lines(spark, sf_dir), [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(header(spark, sf_dir), lines(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_rows(header(spark, sf_dir), lines(spark, sf_dir), catalog(spark))


def six(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *[tidy(c, 6).alias(c) for c in columns])


def texts(components: str = "components_json") -> Column:
    """Components read back from JSON, as text: codes in order with shares to six places."""
    entries = F.array_sort(F.map_entries(F.from_json(components, "map<string,double>")))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), places(e["value"], 6))), " ")


def catalog_profile(spark, sf):
    own = lines(spark, sf).groupBy("candidate_id", "code").agg(F.sum("amount").alias("amount"))
    used = own.groupBy("code").agg(F.count("*").alias("n_mixtures"), F.sum("amount").alias("amount"))
    return catalog(spark).join(used, "code", "left").groupBy("family", "role").agg(F.count("*").alias("n_codes"), F.sum("n_mixtures").alias("n_mixtures"), F.sum("amount").alias("amount"), tidy(F.avg("low_hazard"), 6).alias("low_hazard"))


def target_weight_mass(spark, sf):
    n = header(spark, sf).groupBy("archetype").agg(F.count("*").alias("n"))
    return target_weights(spark).join(n, "archetype").groupBy("feature").agg(tidy(F.sum(F.col("weight") * F.col("n")), 6).alias("mass"), F.count("*").alias("n_profiles"))


def term_screen(spark, sf):
    return table(spark, sf, "documents").select("doc_id", screen.first_term(F.col("text"), [*TERMS, *banned()]).alias("term"))


def csv_roundtrip(spark, sf):
    path = scratch(spark)
    columns = ["candidate_id", "archetype", "process_tags", "note"]
    files.write_csv(header(spark, sf).select("candidate_id", "archetype", F.array_join(F.array_sort("tags"), " ").alias("process_tags")), path, columns)
    return files.read_csv(spark, path, columns).withColumn("candidate_id", F.col("candidate_id").cast("long"))


def json_roundtrip(spark, sf):
    path = scratch(spark)
    h = header(spark, sf).select("candidate_id", "archetype", "tags")
    files.append_json(h.where("candidate_id % 2 = 0"), path)
    files.append_json(h.where("candidate_id % 2 = 1"), path)
    return spark.read.schema(h.schema).json(path).select("candidate_id", "archetype", F.array_join("tags", " ").alias("process_tags"))


def partitioned_output(spark, sf):
    path = scratch(spark)
    files.write_by_profile(header(spark, sf).select("candidate_id", "archetype"), path)
    return spark.read.parquet(path).where("archetype = 'CANVAS'").select("candidate_id", "archetype")


def mixture_normalize(spark, sf):
    return shares(spark, sf).select("candidate_id", "code", tidy("frac", 9).alias("frac"))


def key_column(*names):
    return lambda spark, sf: wide(spark, sf).select("candidate_id", *names)


def diversity_signature(spark, sf):
    return wide(spark, sf).select("candidate_id", "signature")


def weighted_profile(spark: SparkSession, sf: str) -> DataFrame:
    return six(wide(spark, sf).withColumnsRenamed({f"w_{p}": p for p in PROPERTIES}), PROPERTIES, "candidate_id")


def phase_shares(spark, sf):
    return six(wide(spark, sf), [f"{p}_like" for p in phases()], "candidate_id")


def role_share(spark, sf):
    own = shares(spark, sf).join(F.broadcast(catalog(spark).select("code", "family", "role")), "code")
    return own.groupBy("candidate_id").agg(*[tidy(F.sum(F.when((F.col("role") == r) | (F.col("family") == r), F.col("frac")).otherwise(0.0)), 6).alias(r) for r in SHARES])


def featured(spark, sf):
    return features.features(wide(spark, sf))


def mixture_features(spark, sf):
    return six(featured(spark, sf), FEATURES, "candidate_id")


def evenness_bonus(spark, sf):
    w = wide(spark, sf)
    least, even = evenness([F.col(f"w_{f}") for f in features.BALANCED])
    return w.select("candidate_id", tidy(least, 6).alias("least"), tidy(even, 6).alias("evenness"))


def hard_reject(spark, sf):
    """As the whole screen has it, over orders some of which have a tag with a banned term or an unknown profile."""
    h = header(spark, sf)
    tags = F.when(F.col("candidate_id") % 400 == 0, F.array_append("tags", F.lit(BAD_TAG))).otherwise(F.col("tags"))
    h = h.withColumn("tags", tags).withColumn("archetype", F.when(F.col("candidate_id") % 100 == 7, ODD_PROFILE).otherwise(F.col("archetype")))
    w = rejected(wide_rows(h, lines(spark, sf), catalog(spark)))
    return w.select("candidate_id", F.coalesce("reject_reason", F.lit("")).alias("reason"))


def profile_score(spark, sf):
    return rows(spark, sf).select("candidate_id", tidy("base_score", 8).alias("base_score"))


def gate_metrics(spark, sf):
    return six(rows(spark, sf), screen.GATE, "candidate_id")


def final_score(spark, sf):
    return rows(spark, sf).select("candidate_id", "gate_status", "gate_reason", tidy("score", 8).alias("score"))


def gate_inputs(spark, sf):
    """Hash-uniform features for each event, so that every branch of the gate is taken."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("candidate_id"))
    names = F.array(*[F.lit(a) for a in targets()])
    u = lambda f: uniform("candidate_id", F.lit(f))
    tags = F.when(u("tag") < 0.5, F.array(F.lit("EXPERT_VALIDATION_REQUIRED"))).otherwise(F.array().cast("array<string>"))
    return e.select("candidate_id", F.get(names, F.floor(u("archetype") * 13).cast("int")).alias("archetype"), tags.alias("tags"), F.when(u("reject") < 0.05, F.lit("x")).alias("reject_reason"), u("base").alias("base_score"), *[u(f).alias(f) for f in FEATURES])


def gate_status(spark, sf):
    g = screen.gate_status(screen.gate_metrics(gate_inputs(spark, sf)))
    return g.select(F.col("candidate_id").alias("event_id"), "gate_status", "gate_reason")


def reported(f):
    return lambda spark, sf: f(order_run(spark, sf).rows)


def champions(spark, sf):
    return reports.champions(order_run(spark, sf).rows).select("rank", "archetype", "candidate_id", tidy("score", 8).alias("score"))


def archetype_shortlist(spark, sf):
    return reports.shortlist(order_run(spark, sf).rows).select("rank", "archetype", "candidate_id", tidy("score", 8).alias("score"))


def ranks(n, diverse=True):
    def run(spark, sf):
        own = order_run(spark, sf).rows
        return select.top(select.dedup_diverse(own) if diverse else own, n).select("archetype", "rank", "candidate_id", tidy("score", 8).alias("score"))

    return run


def top2_components(spark, sf):
    return wide(spark, sf).select("candidate_id", "top1", "top2")


def nested_rows(spark, sf):
    n = reports.nested(order_run(spark, sf).rows)
    c = F.col("candidate")
    return n.select("candidate_id", c["archetype"].alias("archetype"), c["score"].alias("score"), c["formula_percent"].alias("formula_percent"), F.size(c["components"]).alias("n_components"), c["objectives"]["transformation"].alias("transformation"), c["gate"]["gate_status"].alias("gate_status"), c["gate"]["final_priority"].alias("final_priority"), c["notes"]["rejected"].alias("rejected"), c["notes"]["boundary"].alias("boundary"))


def read_back(df):
    """Rows with components as text, from their JSON."""
    return df.withColumn("components", texts()).drop("components_json")


def top_flat(spark, sf):
    """The flat rows of the best diverse mixtures of each profile, with ranks: what a profile's file of results has."""
    return read_back(reports.flat(select.top(select.dedup_diverse(order_run(spark, sf).rows), 20)))


def review_requests(spark, sf):
    r = read_back(reports.review_requests(order_run(spark, sf).rows))
    values = F.from_json("objectives_json", ", ".join(f"{c} double" for c in [*FEATURES, *screen.GATE]))
    return r.withColumn("objectives", F.concat_ws(" ", *[places(values[c], 6) for c in [*FEATURES, *screen.GATE]])).drop("objectives_json")


def dated_requests(spark, sf):
    """Requests dated by the orders."""
    dated = order_run(spark, sf).rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), "o_orderdate"), "candidate_id")
    return reports.review_requests(dated, n=2, replicates=1, day=F.col("o_orderdate"), prefix="DR").select("request_id", "archetype", "score", "hash16")


def second_catalog(spark, sf, factor: float = 0.55):
    """The orders, some with an unknown profile, screened with another catalog, whose ingredients are more hazardous."""
    cat = catalog(spark).withColumn("low_hazard", F.col("low_hazard") * factor)
    h = header(spark, sf).withColumn("archetype", F.when(F.col("candidate_id") % 100 == 7, ODD_PROFILE).otherwise(F.col("archetype")))
    out = screened(h, lines(spark, sf), cat)
    return out.select("candidate_id", "archetype", "description", F.coalesce("reject_reason", F.lit("")).alias("reason"), tidy("base_score", 8).alias("base_score"), "gate_status", tidy("score", 8).alias("score"))


def archetype_summary(spark, sf):
    s = reports.archetype_summary(order_run(spark, sf).rows)
    return s.select("archetype", "n_rows", "n_passed", F.col("best.candidate_id").alias("best_id"), F.col("best.score").alias("best_score"))


def gate_summary(spark, sf):
    """From the counts that were taken as the rows were written."""
    return order_run(spark, sf).gate_summary()


def report_bundle(spark, sf):
    """All reports of a run, written and read back: rows of each, and the sum of hashes of the mixtures named in them."""
    out = None
    for name, df in runs.write_reports(order_run(spark, sf), scratch(spark)).items():
        ids = F.sum("candidate_id") if "candidate_id" in df.columns else F.sum("best_id") if "best_id" in df.columns else F.lit(None)
        own = df.agg(F.count("*").alias("n_rows"), ids.cast("long").alias("ids")).select(F.lit(name).alias("report"), "n_rows", "ids")
        out = own if out is None else out.unionByName(own)
    return out


def stored_screen(spark, sf):
    """The screen of bucketed tables: no exchange."""
    h, own = stored(header(spark, sf), lines(spark, sf), 2 * spark.sparkContext.defaultParallelism)
    return screened(h, own, dealt=True).select("candidate_id", "gate_status", "gate_reason", tidy("score", 8).alias("score"))


def run_summary(spark, sf):
    s = reports.run_summary(order_run(spark, sf).rows)
    return s.select("n_rows", "rejected_or_review", F.size("champions").alias("n_champions"), F.array_join(F.transform("champions", lambda c: c["archetype"]), ",").alias("profiles"))


def pairs(spark, sf):
    h = header(spark, sf)
    return h.select(F.col("candidate_id").alias("pair_id"), F.col("candidate_id").alias("a"), (F.col("candidate_id") + 1).alias("b")).join(h.select(F.col("candidate_id").alias("b")), "b", "left_semi")


def blend_pairs(spark, sf):
    _, out = variants.blend(pairs(spark, sf), header(spark, sf), shares(spark, sf))
    return out.select("pair_id", "code", tidy("amount", 9).alias("amount"))


def tag_union(spark, sf):
    out, _ = variants.blend(pairs(spark, sf), header(spark, sf), shares(spark, sf))
    return out.select("pair_id", F.array_join("tags", " ").alias("tags"))


def draw_weights(spark, sf):
    n = header(spark, sf).groupBy("archetype").agg(F.count("*").alias("n_mixtures"))
    return variants.draw_weights(catalog(spark)).join(n, "archetype").select("archetype", "code", tidy("weight", 9).alias("weight"), "n_mixtures")


def weighted_draw(spark, sf):
    steps = variants.cumulative(variants.draw_weights(catalog(spark)), ["archetype"])
    return variants.weighted_draw(header(spark, sf), steps, ["archetype"], uniform("candidate_id", F.lit("draw"))).select("candidate_id", "drawn")


def perturb_mixtures(spark, sf):
    _, out = variants.perturb(header(spark, sf), shares(spark, sf), catalog(spark))
    return out.select("candidate_id", "code", tidy("amount", 9).alias("amount"))


def sample_mixtures(spark, sf):
    _, out = variants.sample(header(spark, sf), catalog(spark))
    return out.select("candidate_id", "code", tidy("amount", 9).alias("amount"))


def tournament_pick(spark, sf):
    own = order_run(spark, sf).rows.withColumn("score", tidy("score", 8))
    return variants.tournament(own, 20)


def backfill(spark, sf, need: int = 24, tries: int = 400):
    """Each profile's 20 best diverse mixtures, filled up to `need` with random ones of other signatures."""
    kept = select.top(select.dedup_diverse(order_run(spark, sf).rows), 20)
    screen = lambda h, own: slim(screened(h, own)).withColumn("score", tidy("score", 8))
    return variants.fill(kept, header(spark, sf), catalog(spark), screen, need, tries).select("archetype", "rank", "candidate_id", "score")


def variant_batch(spark, sf, keep: int = 280):
    """A variant for each order, from the pool of its profile's best orders; pool and variants (with negative ids) are united, and the best of each profile kept."""
    old = order_run(spark, sf).rows.withColumn("score", tidy("score", 8))
    pool = written(select.top(old, keep))
    own = pool.select("candidate_id", F.explode(F.map_entries("components")).alias("e")).select("candidate_id", "e.key", "e.value").toDF("candidate_id", "code", "frac")
    trials = header(spark, sf).withColumn("candidate_id", -F.col("candidate_id") - 1)
    new = slim(screened(*variants.batch(trials, pool, own, catalog(spark)))).withColumn("score", tidy("score", 8))
    return select.top(pool.drop("rank").unionByName(new), keep).select("archetype", "rank", "candidate_id", "source", "score")


def queries():
    return {
        "catalog_profile": catalog_profile, "target_weights": target_weight_mass, "term_screen": term_screen, "csv_roundtrip": csv_roundtrip, "json_roundtrip": json_roundtrip, "partitioned_output": partitioned_output,
        "mixture_normalize": mixture_normalize, "mixture_fingerprint": key_column("fingerprint", "hash16"), "formula_string": key_column("formula"), "coarse_key": key_column("coarse_key"), "diversity_signature": diversity_signature,
        "weighted_profile": weighted_profile, "phase_shares": phase_shares, "role_share": role_share, "mixture_features": mixture_features, "evenness_bonus": evenness_bonus, "hard_reject": hard_reject, "profile_score": profile_score,
        "gate_metrics": gate_metrics, "gate_status": gate_status, "final_score": final_score, "dedup_diverse": reported(lambda r: select.dedup_diverse(r).select("archetype", "coarse_key", "signature", "candidate_id")),
        "topk_diverse": ranks(20), "pool_truncate": ranks(280, diverse=False), "champions": champions, "archetype_shortlist": archetype_shortlist, "top2_components": top2_components, "nested_rows": nested_rows,
        "candidate_flat": reported(lambda r: read_back(reports.flat(r))), "top_flat": top_flat, "decision_ledger": reported(lambda r: read_back(reports.ledger(r))), "gate_ledger": reported(lambda r: read_back(reports.ledger(r)).orderBy(F.desc("final_priority"), "candidate_id")), "rejected_ledger": reported(lambda r: read_back(reports.rejected(r))),
        "gate_summary": gate_summary, "archetype_summary": archetype_summary, "run_summary": run_summary, "report_bundle": report_bundle, "stored_screen": stored_screen, "review_requests": review_requests, "dated_requests": dated_requests, "second_catalog": second_catalog,
        "blend_pairs": blend_pairs, "tag_union": tag_union, "draw_weights": draw_weights, "weighted_draw": weighted_draw, "perturb_mixtures": perturb_mixtures, "sample_mixtures": sample_mixtures,
        "tournament_pick": tournament_pick, "diversity_backfill": backfill, "variant_batch": variant_batch,
    }
