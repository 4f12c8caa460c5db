"""Draws, samples and variants of mixtures in bulk. Random numbers are hashes of (seed, row, purpose), so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..sources.catalog import META, biases, local, targets
from ..sources.files import written
from .select import best_by, top

# Ingredients that a recipe always has, that it draws from, and tags; body: the matrices that material profiles start from.
STAGE_ESSENTIALS = ["CLEAN_CANVAS_SURFACE", "SIGNAL_CLARITY_GATE", "SAFE_CONTAINMENT_MATRIX", "REPRODUCIBLE_SCENE_PROTOCOL"]
STAGE_EXTRA = ["ZEOLITE_SAFE", "ACTIVATED_CARBON_SAFE", "BACTERIAL_CELLULOSE_MATRIX", "CLAY_PLATELET_BARRIER", "CHITOSAN_BINDER"]
META_ESSENTIALS = ["GPT_TRANSFORMER_ENGINE", "ACTIVE_LEARNING_AUTOLAB", "SCORING_FUNCTION_MUTATOR", "KNOWLEDGE_GRAPH_MEMORY", "EXPERT_REVIEW_GATE"]
BODY = ["BACTERIAL_CELLULOSE_MATRIX", "CHITOSAN_BINDER", "ALGINATE_HYDROGEL", "PVA_FILM", "GELATIN_COLLAGEN_TOKEN"]
MUTATION_TAGS = ["LAMINATED", "HYDROGEL_NETWORK", "BIOMINERALIZED", "PHOTOCATALYTIC_SURFACE", "ADSORBENT_CORE", "SELF_HEALING_LAYER", "CONDUCTIVE_TRACE", "CLOSED_LOOP", "RULE_REWRITE", "WORLD_MODEL"]

# With what probability a sampled material mixture has a tag: for some profiles, and for the others.
CHANCES = {
    "LAMINATED": (0.45, [], 0.45),
    "HYDROGEL_NETWORK": (0.45, ["HEALER", "LIFE"], 0.20),
    "BIOMINERALIZED": (0.62, ["BIOMINERAL", "LIFE"], 0.22),
    "PHOTOCATALYTIC_SURFACE": (0.62, ["CATALYST", "ENERGY"], 0.18),
    "ADSORBENT_CORE": (0.65, ["PURIFIER", "UNIVERSAL"], 0.30),
    "SELF_HEALING_LAYER": (0.66, ["HEALER"], 0.24),
    "CONDUCTIVE_TRACE": (0.62, ["ENERGY"], 0.14),
    "STONE_BODY": (0.62, ["STONE", "BIOMINERAL"], 0.25),
    "ANIMA_BIO": (0.58, ["LIFE", "BIOMINERAL"], 0.18),
}


def kind(archetype: Column) -> Column:
    return F.when(archetype.isin("CANVAS", "STAGEKEEPER"), "stage").when(archetype.isin("DEMIURGE", "WORLD_REWRITER"), "meta").otherwise("material")


def draw_weights(catalog: DataFrame) -> DataFrame:
    """(archetype, position, code, family, role, weight): the profile's bias of the family times that of the role times a base from hazard, testability and meta features."""
    spark = catalog.sparkSession
    pairs = local(spark, [(a, label, b) for a, own in biases().items() for label, b in own.items()], "archetype string, label string, bias double")
    names = local(spark, [(a,) for a in targets()], "archetype string")
    base = F.lit(0.25) + F.col("low_hazard") + F.col("testability") * 0.25 + sum((F.col(f) for f in META[1:]), F.col(META[0])) * 0.06
    rows = catalog.crossJoin(names)  # the fixed profiles
    for column in ("family", "role"):
        own = pairs.withColumnsRenamed({"label": column, "bias": f"b_{column}"})
        rows = rows.join(own, ["archetype", column], "left")
    return rows.select("archetype", "position", "code", "family", "role", (F.coalesce("b_family", F.lit(1.0)) * F.coalesce("b_role", F.lit(1.0)) * base).alias("weight"))


def cumulative(weights: DataFrame, group: list[str]) -> DataFrame:
    """For each group the cumulative weights in the catalog's order (ups), their codes, the total, and the strides of a binary search in them: at most a few dozen entries."""
    w = Window.partitionBy(*group).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = weights.withColumn("up_to", F.sum("weight").over(w))
    steps = summed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("position", "up_to", "code"))).alias("s"), F.max("up_to").alias("total"))
    strides = "transform(sequence(CAST(log2(size(s)) AS int), 0, -1), k -> shiftleft(1, k)) AS strides"
    return steps.selectExpr(*group, "s.up_to AS ups", "s.code AS codes", "total", strides)


def weighted_draw(rows: DataFrame, steps: DataFrame, group: list[str], u: Column, into: str = "drawn") -> DataFrame:
    """Adds the code whose cumulative interval holds u times the total, by binary search: steps has a row for each group, small enough to be broadcast."""
    joined = rows.withColumn("__u", u).join(steps, group).withColumn("__x", F.col("__u") * F.col("total"))
    below = "aggregate(strides, 0, (p, s) -> if(get(ups, p + s - 1) < __x, p + s, p))"  # entries under x
    return joined.withColumn(into, F.expr(f"get(codes, least({below}, size(codes) - 1))")).drop("ups", "codes", "strides", "total", "__u", "__x")


def perturb(header: DataFrame, shares: DataFrame, catalog: DataFrame, seed: int = 1, rate: float = 0.18) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of a variant of each mixture: some amounts scaled by 0.55 to 1.55, maybe one drawn ingredient and tag more, maybe the smallest of over five components less."""
    s = F.lit(seed)
    code_u = lambda salt: uniform(s, "candidate_id", "code", F.lit(salt))
    own_u = lambda salt: uniform(s, "candidate_id", F.lit(salt))
    scaled = shares.select("candidate_id", "code", F.when(code_u("scale?") < rate, F.col("frac") * (0.55 + code_u("scale"))).otherwise(F.col("frac")).alias("amount"))
    steps = cumulative(draw_weights(catalog), ["archetype"])
    added = weighted_draw(header.where(own_u("add?") < rate), steps, ["archetype"], own_u("add")).select("candidate_id", F.col("drawn").alias("code"), (0.01 + 0.15 * own_u("amount")).alias("amount"))
    lines = scaled.unionByName(added).groupBy("candidate_id", "code").agg(F.sum("amount").alias("amount"))
    smallest = F.row_number().over(Window.partitionBy("candidate_id").orderBy("amount", "code"))
    count = F.count("*").over(Window.partitionBy("candidate_id"))
    lines = lines.withColumns({"__r": smallest, "__n": count}).where(~((F.col("__r") == 1) & (F.col("__n") > 5) & (own_u("drop?") < rate))).drop("__r", "__n")
    tag = F.element_at(F.array(*[F.lit(t) for t in MUTATION_TAGS]), (F.floor(own_u("tag") * len(MUTATION_TAGS)) + 1).cast("int"))
    tags = F.when(own_u("tag?") < rate, F.array_union("tags", F.array(tag))).otherwise(F.col("tags"))
    return header.withColumn("tags", F.array_sort(F.array_distinct(tags))).withColumn("source", F.lit("mutated")), lines


def blend(pairs: DataFrame, header: DataFrame, shares: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of mixtures a and b of each pair (pair_id, a, b), alpha of a and 1 - alpha of b with alpha in 0.25 to 0.75; tags are united."""
    p = pairs.withColumn("alpha", 0.25 + 0.5 * uniform(F.lit(seed), "pair_id", F.lit("alpha")))
    sides = p.select("pair_id", F.col("a").alias("candidate_id"), F.col("alpha").alias("part")).unionByName(p.select("pair_id", F.col("b").alias("candidate_id"), (1 - F.col("alpha")).alias("part")))
    lines = sides.join(shares, "candidate_id").groupBy("pair_id", "code").agg(F.sum(F.col("part") * F.col("frac")).alias("amount"))
    h = header.select("candidate_id", "archetype", "tags")
    named = p.join(h.withColumnsRenamed({"candidate_id": "a", "tags": "tags_a"}), "a").join(h.drop("archetype").withColumnsRenamed({"candidate_id": "b", "tags": "tags_b"}), "b")
    return named.select("pair_id", "archetype", F.lit("crossover").alias("source"), F.array_sort(F.array_union("tags_a", "tags_b")).alias("tags")), lines


def sample(header: DataFrame, catalog: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of a random mixture for each (candidate_id, archetype) by the recipe of the profile's kind; repeated draws add up."""
    s = F.lit(seed)
    u = lambda *salt: uniform(s, "candidate_id", *[F.lit(x) if isinstance(x, str) else x for x in salt])
    rows = header.select("candidate_id", "archetype").withColumn("kind", kind(F.col("archetype")))
    parts = []
    for name, codes in (("stage", STAGE_ESSENTIALS), ("meta", META_ESSENTIALS)):
        own = rows.where(F.col("kind") == name).withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))
        parts.append(own.select("candidate_id", "code", (0.04 + 0.16 * u("essential", F.col("code"))).alias("amount")))
    weights = draw_weights(catalog)
    pools = {
        "stage": (F.col("family") == "canvas_layer") | F.col("code").isin(STAGE_EXTRA), "meta": F.col("family") == "meta_engine",
        "body": F.col("code").isin(BODY), "material": F.col("family") != "meta_engine",
    }
    single = F.col("archetype").isin("CATALYST", "ENERGY")
    counts = {"stage": 2 + F.floor(u("n") * 4), "meta": 2 + F.floor(u("n") * 4), "body": F.when(single, 1).otherwise(1 + F.floor(u("n body") * 3)), "material": 3 + F.floor(u("n") * 6)}
    ranges = {"stage": (0.02, 0.16), "meta": (0.02, 0.16), "body": (0.04, 0.21), "material": (0.01, 0.21)}
    for pool, which in pools.items():
        own = rows.where(F.col("kind") == ("material" if pool == "body" else pool)).withColumn("k", F.explode(F.sequence(F.lit(1), counts[pool].cast("int"))))
        drawn = weighted_draw(own, cumulative(weights.where(which), ["archetype"]), ["archetype"], u(pool, F.col("k")))
        low, wide = ranges[pool]
        parts.append(drawn.select("candidate_id", F.col("drawn").alias("code"), (low + wide * u(pool + " amount", F.col("k"))).alias("amount")))
    lines = parts[0]
    for x in parts[1:]:
        lines = lines.unionByName(x)
    lines = lines.groupBy("candidate_id", "code").agg(F.sum("amount").alias("amount"))
    aided = rows.where((F.col("kind") == "material") & (u("aid?") < 0.25)).select("candidate_id", F.lit("ACTIVE_LEARNING_AUTOLAB").alias("code"), (0.01 + 0.04 * u("aid")).alias("amount"))
    tags = F.when(F.col("kind") == "stage", F.array(*map(F.lit, ["CLEAN_CANVAS", "LOW_NOISE_FIELD", "SAFE_STAGE"]))).when(F.col("kind") == "meta", F.array(*map(F.lit, ["CLOSED_LOOP", "RULE_REWRITE", "DEMIURGE_LAYER"]))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.col("archetype") == "STAGEKEEPER", F.array(F.lit("SAFE_CONTAINMENT"), F.lit("REPRODUCIBLE_SCENE"))).when(F.col("archetype") == "WORLD_REWRITER", F.array(F.lit("WORLD_MODEL"), F.lit("SEARCH_SPACE_EDITOR"))).otherwise(F.array().cast("array<string>"))
    by_chance = F.array_compact(F.array(*[F.when((F.col("kind") == "material") & (u("tag", F.lit(t)) < F.when(F.col("archetype").isin(special), p).otherwise(q)), F.lit(t)) for t, (p, special, q) in CHANCES.items()]))
    both = F.concat(F.array(F.lit("LOW_HAZARD_GATE"), F.lit("EXPERT_VALIDATION_REQUIRED")), tags, more, by_chance)
    out = rows.select("candidate_id", "archetype", F.lit("random").alias("source"), F.array_sort(F.array_distinct(both)).alias("tags"))
    return out, lines.unionByName(aided.join(lines.select("candidate_id", "code"), ["candidate_id", "code"], "left_anti"))


def tournament(rows: DataFrame, slots: int, entrants: int = 9, seed: int = 1, score: str = "score") -> DataFrame:
    """(archetype, slot, candidate_id): the best of about `entrants` random rows of a profile for each slot; a row may enter several.

    A row has one place in a ring, by a hash; a slot's entrants are the rows in an arc of it, of random start, that
    holds `entrants` of n rows on average (all rows of a profile with fewer). Rows find the arcs of their part of the
    ring by a hash join, so a row costs one hash, whatever the number of slots. A slot whose arc is empty has no row.
    """
    n = rows.groupBy("archetype").agg(F.count("*").alias("n")).withColumns({"wide": F.lit(float(entrants)) / F.col("n"), "cells": F.greatest(F.lit(1), F.floor(F.col("n") / entrants))})
    arcs = n.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("start", uniform(F.lit(seed), "archetype", "slot")).withColumn("cell", F.floor(F.col("start") * F.col("cells")))
    arcs = arcs.withColumn("cell", F.explode(F.array_distinct(F.array("cell", (F.col("cell") + 1) % F.col("cells"))))).select("archetype", "slot", "start", "wide", "cell")
    own = rows.select("archetype", "candidate_id", "hash16", score, uniform(F.lit(seed), "candidate_id", F.lit("ring")).alias("place")).join(n.select("archetype", "cells"), "archetype")
    own = own.withColumn("cell", F.floor(F.col("place") * F.col("cells")))
    entered = own.join(arcs, ["archetype", "cell"]).where("place - start + if(place < start, 1, 0) < wide")
    return entered.groupBy("archetype", "slot").agg(F.min_by("candidate_id", F.struct((-F.col(score)).alias("s"), "hash16", "candidate_id")).alias("candidate_id"))


def missing(kept: DataFrame, header: DataFrame, need: int) -> DataFrame:
    """(archetype, missing): how many rows each profile of the header lacks of `need`."""
    have = kept.groupBy("archetype").agg(F.count("*").alias("have"))
    return header.select("archetype").distinct().join(have, "archetype", "left").withColumn("missing", F.lit(need) - F.coalesce("have", F.lit(0))).where("missing > 0").select("archetype", "missing")


def backfill(kept: DataFrame, header: DataFrame, sampled: DataFrame, need: int = 3, by: str = "score") -> DataFrame:
    """Of the sampled rows those that fill each profile of the header up to `need` rows, beside those kept of it.

    Only positive rows with a signature that no kept row of the profile has, one for each signature, the best first
    (by the largest `by`). kept, sampled: archetype, signature, score, hash16, candidate_id.
    """
    new = sampled.where("score > 0").join(missing(kept, header, need), "archetype").join(kept.select("archetype", "signature").distinct(), ["archetype", "signature"], "left_anti")
    return top(best_by(new, ["archetype", "signature"], by), need, score=by).where("rank <= missing").drop("missing")


def fill(kept: DataFrame, header: DataFrame, catalog: DataFrame, screen: Callable[[DataFrame, DataFrame], DataFrame], need: int = 3, tries: int = 8000, seed: int = 1, first: int = 2, growth: int = 4) -> DataFrame:
    """Random mixtures that fill each profile of the header up to `need` rows, as backfill() takes them, in the order of their turns.

    Turn k of a profile is one mixture, the same whatever is asked for: candidate_id is -(k * profiles + place) - 1,
    place that of the profile among all names in order. The first positive ones with a new signature are taken, at
    most `tries` turns. Turns are made round by round, at first `first` for each missing row, `growth` times as many each further
    round and only for profiles that still lack rows: what is screened follows what is missing.
    screen: gives archetype, signature, score, hash16 and candidate_id of (header, lines).
    """
    names = header.agg(F.array_sort(F.collect_set("archetype")).alias("names")).select(F.posexplode("names").alias("place", "archetype"), F.size("names").alias("profiles"))
    short = written(missing(kept, header, need).join(names, "archetype"))
    lacking, pool, after, upto = short, None, 0, first
    while True:
        bounds = [F.least(F.lit(k) * F.col("missing"), F.lit(tries)) for k in (after, upto)]
        turns = lacking.withColumns({"a": bounds[0], "b": bounds[1]}).where("a < b").withColumn("turn", F.explode(F.sequence("a", F.col("b") - 1)))
        ids = turns.select((-(F.col("turn") * F.col("profiles") + F.col("place")) - 1).cast("long").alias("candidate_id"), "archetype")
        made = screen(*sample(written(ids), catalog, seed)).select("archetype", "signature", "score", "hash16", "candidate_id")
        new = written(made.join(short.select("archetype", "profiles"), "archetype").withColumn("turn_order", -F.floor((-F.col("candidate_id") - 1) / F.col("profiles")).cast("double")).drop("profiles"))
        pool = new if pool is None else pool.unionByName(new)
        taken = backfill(kept, header, pool, need, "turn_order")
        after, upto = upto, upto * growth
        lacking = written(short.join(taken.groupBy("archetype").agg(F.count("*").alias("got")), "archetype", "left").where(f"coalesce(got, 0) < missing AND {after} * missing < {tries}").drop("got"))
        if lacking.isEmpty():
            return taken.drop("turn_order")


def batch(header: DataFrame, pool: DataFrame, pool_shares: DataFrame, catalog: DataFrame, seed: int = 1, entrants: int = 9) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of a variant for each (candidate_id, archetype): .55 perturb the best of `entrants` random pool rows of the profile, .27 blend two of them, the rest are sampled anew.

    pool: candidate_id, archetype, rank (1 for a profile's best, without gaps), tags; pool_shares: candidate_id, code,
    frac. With ranks, the best of random entrants is the least of their ranks: nothing is multiplied or sorted.
    Profiles with fewer than two pool rows sample where they would blend, with none where they would perturb.
    """
    s = F.lit(seed)
    u = lambda *salt: uniform(s, "candidate_id", *[F.lit(x) for x in salt])
    sizes = pool.groupBy("archetype").agg(F.count("*").alias("n"))
    rows = header.select("candidate_id", "archetype").join(sizes, "archetype", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    draw = lambda k: F.floor(u("entrant", k) * F.col("n"))
    first, second = F.floor(u("first") * F.col("n")), F.floor(u("second") * (F.col("n") - 1))
    way = F.when((u("route") < 0.55) & (F.col("n") > 0), "perturb").when((u("route") >= 0.55) & (u("route") < 0.82) & (F.col("n") > 1), "blend").otherwise("sample")
    rows = rows.withColumns({"way": way, "parent": F.least(*[draw(k) for k in range(entrants)]) + 1, "first": first + 1, "second": (first + 1 + second) % F.col("n") + 1})
    known = pool.select("archetype", "rank", F.col("candidate_id").alias("of"), "tags")
    parts = pool_shares.withColumnRenamed("candidate_id", "of")

    mutants = rows.where("way = 'perturb'").withColumnRenamed("parent", "rank").join(known, ["archetype", "rank"])
    h1, l1 = perturb(mutants.select("candidate_id", "archetype", "tags"), mutants.select("candidate_id", "of").join(parts, "of").select("candidate_id", "code", "frac"), catalog, seed)
    crossed = rows.where("way = 'blend'")
    for side in ("first", "second"):
        crossed = crossed.withColumnRenamed(side, "rank").join(known.withColumnsRenamed({"of": f"of_{side}", "tags": f"tags_{side}"}), ["archetype", "rank"]).drop("rank")
    alpha = 0.25 + 0.5 * u("alpha")
    h2 = crossed.select("candidate_id", "archetype", F.lit("crossover").alias("source"), F.array_sort(F.array_union("tags_first", "tags_second")).alias("tags"))
    sides = crossed.select("candidate_id", F.col("of_first").alias("of"), alpha.alias("part")).unionAll(crossed.select("candidate_id", "of_second", 1 - alpha))
    l2 = sides.join(parts, "of").groupBy("candidate_id", "code").agg(F.sum(F.col("part") * F.col("frac")).alias("amount"))
    h3, l3 = sample(rows.where("way = 'sample'"), catalog, seed)
    return h1.unionByName(h2).unionByName(h3), l1.unionByName(l2).unionByName(l3)
