"""Report tables over screened rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tidy
from ..sources.catalog import FEATURES, INTERPRETATION, interpretations, phases
from .screen import GATE, META_PROFILES, STAGE_PROFILES
from .select import best_by, dedup_diverse, top

# Texts of the exchange rows.
BOUNDARY = "Research vector only, not a synthesis protocol."
CLAIMS = ["literal_transmutation_claim", "elixir_claim", "hazardous_synthesis_protocol", "certified_material_claim", "dangerous_chemistry_instructions"]
CLAIM_BOUNDARY = "No literal transmutation claim. No elixir claim. No hazardous synthesis protocol. No certified material claim. No instructions for dangerous chemistry. Computational research vector and expert-review request only."
STATUS = "REQUEST_FOR_EXPERT_REVIEW_NOT_MEASURED_RESULTS"

# Tests that a review request asks for, those of all profiles first.
TESTS = ["EXPERT_IDENTITY_REVIEW", "SAFETY_BOUNDARY_REVIEW", "FUNCTIONAL_SCREENING_FOR_ARCHETYPE", "NO_HAZARDOUS_SYNTHESIS_WITHOUT_QUALIFIED_LAB"]
OWN_TESTS = [
    (["CATALYST", "ENERGY"], ["SAFE_CATALYTIC_OR_PHOTO_ELECTROCHEMICAL_MODEL_SCREENING"]),
    (["PURIFIER"], ["ADSORPTION_OR_SEPARATION_SCREENING"]),
    (["HEALER"], ["SELF_HEALING_OR_DAMAGE_RECOVERY_SCREENING"]),
    (["STONE", "BIOMINERAL"], ["STRUCTURE_MECHANICAL_OR_BIOMINERAL_REVIEW"]),
    (STAGE_PROFILES, ["LOW_NOISE_SCENE_REVIEW", "REPRODUCIBILITY_AND_CONTAINMENT_REVIEW", "SURFACE_READINESS_REVIEW"]),
    (META_PROFILES, ["CLOSED_LOOP_DISCOVERY_REVIEW", "SEARCH_SPACE_REWRITE_REVIEW", "REPRODUCIBILITY_AND_HUMAN_GATE_REVIEW"]),
]


def champions(rows: DataFrame) -> DataFrame:
    """The best row of each profile, ranked in the order of the profiles."""
    return ranked(best_by(rows, ["archetype"]), "ordinal")


def shortlist(rows: DataFrame, n: int = 4) -> DataFrame:
    """The n best diverse rows of each profile, in the order of the profiles; the rank runs on."""
    return ranked(top(dedup_diverse(rows), n).withColumnRenamed("rank", "rank_in_profile"), "ordinal", "rank_in_profile")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds rank over all rows: for results already reduced to a few rows for each profile."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _notes() -> Column:
    """The notes of a row, as a struct in the order of the exchange form."""
    audit = [F.lit(False).alias(c) for c in CLAIMS] + [F.col("archetype").isin(META_PROFILES).alias("demiurge_layer"), F.lit(True).alias("birth_gate_layer")]
    return F.struct("archetype", F.col("description").alias("archetype_description"), F.col("reject_reason").isNotNull().alias("rejected"), F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), F.lit(BOUNDARY).alias("boundary"), *audit, "gate_status", "gate_reason")


def flat(rows: DataFrame) -> DataFrame:
    """The flat exchange row: rank (where rows have one), rounded scores and metrics, tags joined by spaces, audit columns, components and notes as JSON."""
    six = [tidy(c, 6).alias(c) for c in [*FEATURES, *GATE]] + [tidy("w_density", 6).alias("raw_density")] + [tidy(f"{p}_like", 6).alias(f"{p}_like") for p in phases()]
    audit = [F.lit(False).alias(c) for c in CLAIMS] + [F.lit(BOUNDARY).alias("boundary"), F.col("archetype").isin(META_PROFILES).alias("demiurge_layer"), F.lit(True).alias("birth_gate_layer")]
    rank = ["rank"] if "rank" in rows.columns else []
    return rows.select(*rank, "candidate_id", "archetype", tidy("score", 8).alias("score"), "hash16", "formula", "source", F.array_join(F.array_sort("tags"), " ").alias("process_tags"), *six, "gate_status", "gate_reason", *audit, F.to_json("components").alias("components_json"), F.to_json(_notes()).alias("notes_json"))


def nested(rows: DataFrame) -> DataFrame:
    """candidate_id and a struct of maps, arrays and structs, as the exchange form has it; rank is null where rows have none."""
    objectives = F.map_from_entries(F.array(*[F.struct(F.lit(f), tidy(f, 6)) for f in FEATURES]))
    gate = F.struct("gate_status", "gate_reason", *[tidy(c, 6).alias(c) for c in GATE])
    rank = F.col("rank") if "rank" in rows.columns else F.lit(None).cast("int").alias("rank")
    return rows.select("candidate_id", F.struct(rank, "archetype", tidy("score", 8).alias("score"), "hash16", F.col("formula").alias("formula_percent"), "components", F.array_sort("tags").alias("process_tags"), "source", objectives.alias("objectives"), gate.alias("gate"), _notes().alias("notes")).alias("candidate"))


def ledger(rows: DataFrame) -> DataFrame:
    six = ["material_score", "canvas_score", "stagekeeper_score", "demiurge_score", "scene_viability", "birth_readiness", "containment_integrity", "hypothesis_visibility", "expert_gate", "final_priority", "creative_potential", "safe_containment", "signal_clarity"]
    return rows.select("candidate_id", "archetype", "hash16", tidy("score", 8).alias("score_final"), "formula", "source", "gate_status", "gate_reason", *[tidy(c, 6).alias(c) for c in six], F.array_join(F.array_sort("tags"), " ").alias("process_tags"), F.to_json("components").alias("components_json"))


def rejected(rows: DataFrame) -> DataFrame:
    return ledger(stopped(rows))


def stopped(rows: DataFrame) -> DataFrame:
    """The rows, of a ledger or of a screen, that are rejected or to be reviewed."""
    return rows.where(F.col("gate_status").isin("REJECTED", "REVIEW"))


def gate_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("gate_status").isin("REJECTED", "REVIEW")).alias("rejected_or_review"))


def archetype_summary(rows: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("candidate_id", "hash16", tidy("score", 8).alias("score")), F.struct((-F.col("score")).alias("s"), "hash16", "candidate_id"))
    return rows.groupBy("archetype").agg(F.count("*").alias("n_rows"), F.count_if(F.col("gate_status") == "PASSED").alias("n_passed"), best.alias("best"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: counts, and the champions nested in the order of the profiles (as many as there are profiles)."""
    best = champions(rows).agg(F.array_sort(F.collect_list(F.struct("ordinal", "archetype", "hash16", tidy("score", 8).alias("score")))).alias("champions"))
    return gate_summary(rows).crossJoin(best)  # one row each


def review_requests(rows: DataFrame, n: int = 3, replicates: int = 2, day: str | date | Column = "20260101", prefix: str = "RQ") -> DataFrame:
    """Requests for the n best diverse rows of each profile, `replicates` of each, dated `day` (a date, a column of dates, or text as it stands)."""
    best = top(dedup_diverse(rows), n).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    tests = F.concat(F.array(*map(F.lit, TESTS)), *[F.when(F.col("archetype").isin(who), F.array(*map(F.lit, what))).otherwise(F.array().cast("array<string>")) for who, what in OWN_TESTS])
    when = F.lit(day) if isinstance(day, str) else F.date_format(F.lit(day), "yyyyMMdd")
    request = F.concat_ws("-", F.lit(prefix), when, "archetype", F.lpad(F.col("rank").cast("string"), 2, "0"), F.concat(F.lit("R"), F.col("replicate").cast("string")))
    why = F.coalesce(F.create_map(*[F.lit(x) for pair in interpretations().items() for x in pair])[F.col("archetype")], F.lit(INTERPRETATION))
    objectives = F.to_json(F.struct(*[tidy(c, 6).alias(c) for c in [*FEATURES, *GATE]]))
    return best.select(request.alias("request_id"), "archetype", F.col("description").alias("archetype_description"), F.col("rank").alias("rank_within_archetype"), tidy("score", 8).alias("score"), "hash16", "formula", F.array_join(F.array_sort("tags"), " ").alias("process_tags"), why.alias("why"), F.array_join(tests, " | ").alias("requested_tests"), F.lit(STATUS).alias("data_status"), F.lit(CLAIM_BOUNDARY).alias("claim_boundary"), F.to_json("components").alias("components_json"), objectives.alias("objectives_json"))
