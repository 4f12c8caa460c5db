"""Reject rules, scores, gate metrics and gate status: projections of the wide row, without a shuffle. Formulas are SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import average, clipped
from ..sources.catalog import DEFAULT_PROFILE, FEATURES, banned

META_PROFILES, STAGE_PROFILES = ["DEMIURGE", "WORLD_REWRITER"], ["CANVAS", "STAGEKEEPER"]
GATE = ["material_score", "canvas_score", "stagekeeper_score", "demiurge_score", "scene_viability", "birth_readiness", "containment_integrity", "hypothesis_visibility", "expert_gate", "final_priority"]
JOINT = ["scene_viability", "birth_readiness", "final_priority"]

# Profile: feature < threshold times factor.
PENALTIES = """
CANVAS: surface_readiness .42 .78, signal_clarity .40 .82, scene_preparation .40 .82
STAGEKEEPER: safe_containment .48 .76, scene_preparation .44 .82
DEMIURGE: closed_loop_learning .35 .78, rule_rewriting .30 .82, generativity .35 .82
WORLD_REWRITER: rule_rewriting .42 .76, world_modeling .35 .82
UNIVERSAL: transformation .25 .88, purification .25 .88, closed_loop_learning .20 .93
"""


def alternatives(words: list[str]) -> str:
    """A pattern for the alphabetically first of the words that begin at a place: words share their beginnings, and where one ends none that goes on is looked for."""
    if "" in words:
        return ""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    own = [re.escape(c) + alternatives(tails[c]) for c in sorted(tails)]
    return own[0] if len(own) == 1 else f"(?:{'|'.join(own)})"


def first_term(text: Column, terms: list[str] | None = None, whole_words: bool = False) -> Column:
    """The alphabetically first of the terms in the upper-cased text, else null; as part of a word too, unless whole_words.

    One pattern reads the text once: at each place it takes the first term that begins there, without moving on, so
    that terms within others count; the smallest of these is the result.
    """
    words = sorted(terms or banned())
    if whole_words:
        pattern = rf"\b(?=({'|'.join(map(re.escape, words))})\b)"
    else:
        pattern = f"(?=[{re.escape(''.join(sorted({w[0] for w in words})))}])(?=({alternatives(words)}))"
    return F.array_min(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(1)))


def among(column: str, names: list[str]) -> str:
    return f"{column} IN ({', '.join(map(repr, names))})"


META, STAGE = among("archetype", META_PROFILES), among("archetype", STAGE_PROFILES)

# For which profiles a rule holds, when a mixture breaks it, and the reason; the first broken rule counts.
REJECTS = [
    ("true", f"max_share > if({META}, 0.56D, 0.62D)", "concat('single_component_collapse:', CAST(CAST(round(max_share, 3) AS decimal(9,3)) AS string))"),
    ("true", f"n_components < if({META}, 5, 3)", "'not_enough_components'"),
    (STAGE, "canvas_like < 0.24D", "'canvas_layer_floor'"),
    (STAGE, "w_surface_readiness < 0.25D", "'canvas_surface_floor'"),
    (STAGE, "w_signal_clarity < 0.25D", "'canvas_signal_floor'"),
    ("archetype = 'STAGEKEEPER'", "w_safe_containment < 0.38D", "'stagekeeper_containment_floor'"),
    (META, "engine_like < 0.25D", "'demiurge_engine_floor'"),
    (META, "w_rule_rewriting < if(archetype = 'WORLD_REWRITER', 0.32D, 0.20D)", "'demiurge_rule_rewriting_floor'"),
    (META, "w_closed_loop_learning < if(archetype = 'WORLD_REWRITER', 0.22D, 0.30D)", "'demiurge_closed_loop_floor'"),
    (META, "safety_gate_like < 0.03D", "'demiurge_requires_safety_gate'"),
    (f"NOT ({META} OR {STAGE} OR {among('archetype', ['CATALYST', 'ENERGY'])})", "matrix_like < 0.04D", "'not_enough_body_matrix'"),
    (f"NOT ({META} OR {STAGE})", "catalyst_like > 0.68D", "'too_much_catalyst_phase'"),
    (f"NOT ({META} OR {STAGE})", "s_advanced > 0.32D", "'too_much_expert_only_advanced_phase'"),
    (f"NOT ({META} OR {STAGE})", "w_low_hazard < 0.43D", "'hazard_score_too_low'"),
]


def reject_reason(term: Column) -> Column:
    """The first rule that a row of measured() (with archetype) breaks, else null. Thresholds hold for plain weighted averages."""
    rules = F.expr("CASE " + " ".join(f"WHEN ({who}) AND {broken} THEN {reason}" for who, broken, reason in REJECTS) + " END")
    return F.when(term.isNotNull(), F.concat(F.lit("banned_token:"), term)).otherwise(rules)


def score(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds base_score (the profile's dot product times penalties, 0 if rejected), ordinal and description; unknown profiles have the weights of DEFAULT_PROFILE, which must be one, but not its penalties."""
    weights = F.array(*[f"w_{f}" for f in FEATURES])
    known = profiles.select(F.col("archetype").alias("__k"), "ordinal", F.col("description"), weights.alias("__own"))
    rest = profiles.where(F.col("archetype") == DEFAULT_PROFILE).select(F.col("ordinal").alias("__o"), weights.alias("__rest"))
    out = rows.join(known, F.col("archetype") == F.col("__k"), "left").join(F.broadcast(rest))  # one row
    factors: dict[str, list[str]] = {}
    for line in PENALTIES.split("\n"):
        if line:
            name, rules = line.split(": ")
            factors[name] = [f"if({f} < {below}D, {factor}D, 1D)" for f, below, factor in (r.split() for r in rules.split(", "))]
    penalty = "CASE archetype " + " ".join(f"WHEN '{name}' THEN {' * '.join(own)}" for name, own in factors.items()) + " ELSE 1D END"
    dot = " + ".join(f"{f} * __w[{k}]" for k, f in enumerate(FEATURES))
    keep = [*rows.columns, "coalesce(ordinal, __o) AS ordinal", "coalesce(description, '') AS description"]
    out = out.selectExpr(*keep, "coalesce(__own, __rest) AS __w")
    return out.selectExpr(*rows.columns, "ordinal", "description", f"if(reject_reason IS NOT NULL, 0D, {clipped(f'({dot}) * {penalty}')}) AS base_score")


def gate_metrics(rows: DataFrame) -> DataFrame:
    """Adds the ten gate metrics to rows with the features, base_score, tags and archetype."""
    mean = lambda *xs: average(list(xs))
    out = rows.selectExpr(
        "*", f"{clipped('base_score')} AS material_score",
        f"{mean('noise_removal', 'surface_readiness', 'signal_clarity', 'scene_preparation')} AS canvas_score",
        f"{mean('safe_containment', 'scene_preparation', 'signal_clarity', 'low_hazard', 'testability')} AS stagekeeper_score",
        f"{mean('rule_rewriting', 'closed_loop_learning', 'generativity', 'programmability', 'world_modeling', 'feedback_gain')} AS demiurge_score",
        f"{mean('signal_clarity', 'surface_readiness', 'testability', 'noise_removal')} AS hypothesis_visibility",
        f"{mean('safe_containment', 'low_hazard', 'bio_safety', 'durability', 'testability')} AS containment_integrity",
    )
    expert = "if(array_contains(tags, 'EXPERT_VALIDATION_REQUIRED'), 1D, 0.72D)"
    return joint_metrics(out.selectExpr("*", f"{mean('testability', 'low_hazard', 'containment_integrity', expert)} AS expert_gate"))


def joint_metrics(rows: DataFrame) -> DataFrame:
    """Adds the gate metrics that are made of the seven others alone (JOINT)."""
    mean = lambda *xs: average(list(xs))
    out = rows.selectExpr("*", f"{mean('canvas_score', 'stagekeeper_score', 'hypothesis_visibility', 'containment_integrity')} AS scene_viability")
    floor = lambda x, f: f"greatest({f}D, {x})"
    final = f"""CASE WHEN {META} THEN {mean('material_score', 'demiurge_score')} * {floor('expert_gate', 0.10)} * {floor('hypothesis_visibility', 0.10)}
        WHEN {STAGE} THEN {mean('material_score', 'canvas_score', 'stagekeeper_score')} * {floor('expert_gate', 0.10)}
        ELSE material_score * {' * '.join(floor(x, 0.08) for x in ('scene_viability', 'containment_integrity', 'hypothesis_visibility', 'expert_gate'))} END AS final_priority"""
    return out.selectExpr("*", f"{mean('scene_viability', 'containment_integrity', 'hypothesis_visibility', 'expert_gate', '0.55D * demiurge_score + 0.45D * canvas_score')} AS birth_readiness", final)


# What speaks against a mixture, and the reasons given, in order.
GATES = [
    ("creative_potential > 0.80D AND safe_containment < 0.30D", "'UNSTABLE_BIRTH: creative_potential_high_but_safe_containment_low'"),
    ("containment_integrity < 0.35D", "'CONTAINMENT_INTEGRITY_LOW'"),
    ("hypothesis_visibility < 0.32D", "'HYPOTHESIS_VISIBILITY_LOW'"),
    ("scene_viability < 0.32D", "'SCENE_VIABILITY_LOW'"),
    ("expert_gate < 0.40D", "'EXPERT_GATE_LOW'"),
    ("reject_reason IS NOT NULL", "concat('HARD_REJECT:', reject_reason)"),
    (f"{META} AND demiurge_score < 0.38D", "'DEMIURGE_SCORE_LOW'"),
    (f"{STAGE} AND canvas_score < 0.38D", "'CANVAS_SCORE_LOW'"),
]


def gate_status(rows: DataFrame) -> DataFrame:
    """Adds gate_status and gate_reason: REJECTED, REVIEW or PASSED, and all reasons in order, or OK."""
    out = rows.selectExpr("*", *[f"{check} AS __g{k + 1}" for k, (check, _) in enumerate(GATES)])
    status = "CASE WHEN __g5 OR __g6 OR ((__g1 OR __g2) AND NOT __g3) THEN 'REJECTED' WHEN __g3 OR __g4 OR __g7 OR __g8 THEN 'REVIEW' ELSE 'PASSED' END AS gate_status"
    reasons = f"coalesce(nullif(concat_ws('; ', {', '.join(f'if(__g{k + 1}, {why}, NULL)' for k, (_, why) in enumerate(GATES))}), ''), 'OK') AS gate_reason"
    return out.selectExpr(*rows.columns, status, reasons)


def final_score(rows: DataFrame) -> DataFrame:
    """Adds score: the final priority, less for rejected rows and those to review."""
    return rows.selectExpr("*", clipped("final_priority * CASE gate_status WHEN 'REJECTED' THEN 0.20D WHEN 'REVIEW' THEN 0.62D ELSE 1D END") + " AS score")
