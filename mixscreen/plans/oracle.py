"""DuckDB SQL that gives the rows of the registered queries. Formulas are written out here on their own; only fixed tables are shared."""

from __future__ import annotations

from ..sources.catalog import BANNED, BIASES, FEATURES, INTERPRETATIONS, META, PROPERTIES, TARGETS, descriptions, ingredients

STAGE, ENGINE = "('CANVAS', 'STAGEKEEPER')", "('DEMIURGE', 'WORLD_REWRITER')"


def _values(rows: list[tuple], name: str, columns: list[str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def _targets() -> list[tuple]:
    out = []
    for k, line in enumerate(x for x in TARGETS.split("\n") if x):
        name, *own = line.split()
        weights = dict(w.split("=") for w in own)
        out.append((k, name, descriptions().get(name, ""), *(float(weights.get(f, 0)) for f in FEATURES)))
    return out


CATALOG = _values([(k, *r.values()) for k, r in enumerate(ingredients())], "cat", ["position", "code", "family", "role", *PROPERTIES])
#: The same ingredients, more hazardous.
SECOND = CATALOG.replace("cat(", "cat0(", 1) + ", cat AS (SELECT * REPLACE (low_hazard * 0.55 AS low_hazard) FROM cat0)"
TARGET = _values(_targets(), "tgt", ["ordinal", "name", "description", *(f"t_{f}" for f in FEATURES)])
BIAS = _values([(line.split()[0], w.split("=")[0], float(w.split("=")[1])) for line in BIASES.split("\n") if line for w in line.split()[1:]], "bias", ["name", "label", "b"])

HEADER = """
hdr AS (
    SELECT o_orderkey AS candidate_id, (SELECT name FROM tgt WHERE ordinal = o_custkey % 13) AS archetype, 'orders' AS source,
           list_filter([CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'LOW_HAZARD_GATE' END, CASE WHEN o_orderstatus <> 'P' THEN 'EXPERT_VALIDATION_REQUIRED' END], lambda x: x IS NOT NULL) AS tags
    FROM orders
),
lin AS (
    SELECT l_orderkey AS candidate_id, code, sum(l_quantity) AS amount FROM lineitem JOIN cat ON position = l_partkey % 48 WHERE l_quantity > 0 GROUP BY ALL
),
shr AS (
    SELECT candidate_id, coalesce(code, 'BACTERIAL_CELLULOSE_MATRIX') AS code, coalesce(amount / sum(amount) OVER (PARTITION BY candidate_id), 1.0) AS frac
    FROM hdr LEFT JOIN lin USING (candidate_id)
)"""


def _is(*labels: str) -> str:
    return "sum(frac * (" + " + ".join(f"(role = '{x}' OR family = '{x}')::INT" for x in labels) + "))"


WIDE = f"""
wide AS (
    SELECT candidate_id, {', '.join(f'sum(frac * {p}) AS w_{p}' for p in PROPERTIES)},
        {_is('matrix', 'binder', 'hydrogel', 'crosslinker', 'adhesion', 'weak_acid', 'plasticizer')} AS ma, {_is('mineral', 'biomineral', 'platelet')} AS mi, {_is('sorbent', 'carbon')} AS so,
        {_is('catalyst', 'photocatalyst', 'redox_catalyst', 'biocatalyst', 'catalyst_support', 'enzyme')} AS ca, {_is('energy', 'conductive_polymer', 'advanced')} AS en, {_is('bio_process')} AS bp,
        {_is('meta_engine')} AS eg, {_is('memory')} AS me, {_is('engine', 'interpreter')} AS ge, {_is('rule_editor')} AS re, {_is('closed_loop', 'optimizer')} AS cl, {_is('safety_gate')} AS sg,
        {_is('canvas_layer')} AS cv, {_is('surface', 'clarity_gate')} AS su, {_is('containment', 'stage_protocol')} AS co, {_is('stage_protocol', 'memory_field', 'creative_seed')} AS sp,
        {_is('hydrogel')} AS s_hydrogel, {_is('binder')} AS s_binder, {_is('adhesion')} AS s_adhesion, {_is('plasticizer')} AS s_plasticizer, {_is('crosslinker')} AS s_crosslinker,
        sum(CASE WHEN role = 'biomineral' OR family = 'biomineral' THEN frac ELSE 0 END) AS s_biomineral, sum(CASE WHEN role = 'engine' OR family = 'engine' THEN frac ELSE 0 END) AS s_engine,
        {_is('world_model')} AS s_world_model, sum(CASE WHEN role = 'advanced' OR family = 'advanced' THEN frac ELSE 0 END) AS s_advanced,
        max(frac) AS max_share, count(*) FILTER (frac > 0.008) AS n_components
    FROM shr JOIN cat USING (code) GROUP BY candidate_id
)"""
PHASE_NAMES = dict(zip("matrix mineral sorbent catalyst energy bio_process engine memory generator rule_editor closed_loop safety_gate canvas surface containment scene_protocol".split(), "ma mi so ca en bp eg me ge re cl sg cv su co sp".split(), strict=True))

KEYS = """
srt AS (
    SELECT candidate_id, list({'n': -frac, 'code': code, 'frac': frac} ORDER BY frac DESC, code) AS s, list({'code': code, 'frac': frac} ORDER BY code) AS c FROM shr GROUP BY candidate_id
),
keyed AS (
    SELECT candidate_id, archetype, archetype || ' ' || list_aggregate(list_transform(c, lambda x: x.code || ':' || printf('%.6f', x.frac)), 'string_agg', ' ') || ' ' || coalesce(array_to_string(list_sort(tags), ' '), '') AS fingerprint,
           coalesce(array_to_string(list_transform(list_filter(c, lambda x: x.frac > 0.055), lambda x: x.code), '|'), '') AS coarse_key,
           array_to_string(list_transform(c, lambda x: x.code || ':' || printf('%.6f', x.frac)), ' ') AS components, len(c)::INT AS n_of,
           coalesce(s[1].code, 'NONE') AS top1, coalesce(s[2].code, 'NONE') AS top2, s
    FROM hdr JOIN srt USING (candidate_id)
)"""

SCREEN = f"""
raw AS (
    SELECT w.*, archetype, source, tags,
        w_transformation + 0.18 * least(ca, ma + mi + so) + 0.08 * least(bp, ma) AS a1, w_purification + 0.2 * least(so + mi, ma + ca + so) AS a2,
        w_self_healing + 0.2 * least(s_hydrogel + s_binder + s_adhesion + s_plasticizer, ma + bp) AS a3, w_structure_strength + 0.2 * least(ma, mi + so) + 0.08 * least(s_crosslinker + s_adhesion, ma) AS a4,
        w_durability + 0.16 * least(mi + so, ma + ca) + CASE WHEN list_contains(tags, 'LOW_HAZARD_GATE') THEN 0.05 ELSE 0 END AS a5, w_bio_safety AS a6,
        w_energy_conversion + 0.18 * least(en + ca, ma + mi + so) AS a7, w_biomineralization + 0.25 * least(s_biomineral + bp, ma + mi) AS a8,
        w_rule_rewriting + 0.16 * least(re + ge, me + cl) AS b1, w_autocatalysis + 0.14 * least(cl, eg) AS b2, w_closed_loop_learning + 0.18 * least(cl + me, sg + eg) AS b3, w_generativity + 0.18 * least(ge + s_engine, eg) AS b4,
        w_programmability + 0.1 * least(re + eg, me + cl) AS b5, w_world_modeling + 0.14 * least(s_world_model + me, cl + eg) AS b6, w_agency + 0.12 * least(re + cl, sg + eg) AS b7, w_feedback_gain + 0.18 * least(cl + sg, me + eg) AS b8
    FROM wide w JOIN hdr USING (candidate_id)
),
bon AS (
    SELECT *, 0.05 * list_min(x) + 0.03 * (1 - list_stddev_pop(x)) AS u, 0.06 * list_min(y) + 0.035 * (1 - list_stddev_pop(y)) AS d FROM (
        SELECT *, list_transform([a1, a2, a3, a4, a5, a6, a7, a8], lambda v: greatest(0, least(1, v))) AS x, list_transform([b1, b2, b3, b4, b5, b6, b7, b8], lambda v: greatest(0, least(1, v))) AS y FROM raw)
),
cl0 AS (
    SELECT *, a1 + u AS f1, a2 + .5 * u AS f2, a3 + .5 * u AS f3, a4 + .4 * u AS f4, a5 + .4 * u AS f5, a6 AS f6, a7 + .5 * u AS f7, a8 + .5 * u AS f8, w_accessibility AS f9, w_testability AS f10, w_low_hazard AS f11,
        b1 + d AS f12, b2 + .5 * d AS f13, b3 + .7 * d AS f14, b4 + .7 * d AS f15, b5 + .5 * d AS f16, b6 + .6 * d AS f17, b7 + .5 * d AS f18, b8 + .7 * d AS f19,
        w_noise_removal + .16 * least(so + su + cv, co + ma + eg) AS f20, w_surface_readiness + .18 * least(su + cv, co + sp + ma) AS f21, w_signal_clarity + .16 * least(su + me + cv, sp) AS f22,
        w_safe_containment + .18 * least(co + sg + cv, ma + eg + sp) AS f23, w_scene_preparation + .2 * least(cv + sp + ma, so + eg + co) AS f24, w_creative_potential + .16 * least(cv + ge + sp, su + cl) AS f25
    FROM bon
),
feat AS (SELECT * EXCLUDE (f1, f2, f3, f4, f5, f6, f7, f8, f9, f10, f11, f12, f13, f14, f15, f16, f17, f18, f19, f20, f21, f22, f23, f24, f25, x, y, u, d), {', '.join(f'greatest(0, least(1, f{k + 1})) AS {f}' for k, f in enumerate(FEATURES))} FROM cl0),
rej AS (
    SELECT *, CASE
        WHEN max_share > CASE WHEN archetype IN {ENGINE} THEN 0.56 ELSE 0.62 END THEN 'single_component_collapse:' || round(max_share, 3)::DECIMAL(9, 3)
        WHEN n_components < CASE WHEN archetype IN {ENGINE} THEN 5 ELSE 3 END THEN 'not_enough_components'
        WHEN archetype IN {STAGE} AND cv < 0.24 THEN 'canvas_layer_floor'
        WHEN archetype IN {STAGE} AND w_surface_readiness < 0.25 THEN 'canvas_surface_floor'
        WHEN archetype IN {STAGE} AND w_signal_clarity < 0.25 THEN 'canvas_signal_floor'
        WHEN archetype = 'STAGEKEEPER' AND w_safe_containment < 0.38 THEN 'stagekeeper_containment_floor'
        WHEN archetype IN {ENGINE} AND eg < 0.25 THEN 'demiurge_engine_floor'
        WHEN archetype IN {ENGINE} AND w_rule_rewriting < CASE archetype WHEN 'WORLD_REWRITER' THEN 0.32 ELSE 0.2 END THEN 'demiurge_rule_rewriting_floor'
        WHEN archetype IN {ENGINE} AND w_closed_loop_learning < CASE archetype WHEN 'WORLD_REWRITER' THEN 0.22 ELSE 0.3 END THEN 'demiurge_closed_loop_floor'
        WHEN archetype IN {ENGINE} AND sg < 0.03 THEN 'demiurge_requires_safety_gate'
        WHEN archetype IN {STAGE} OR archetype IN {ENGINE} THEN NULL
        WHEN archetype NOT IN ('CATALYST', 'ENERGY') AND ma < 0.04 THEN 'not_enough_body_matrix'
        WHEN ca > 0.68 THEN 'too_much_catalyst_phase'
        WHEN s_advanced > 0.32 THEN 'too_much_expert_only_advanced_phase'
        WHEN w_low_hazard < 0.43 THEN 'hazard_score_too_low' END AS reason
    FROM feat
),
sco AS (
    SELECT rej.*, ordinal, CASE WHEN known IS NULL THEN '' ELSE description END AS description, CASE WHEN reason IS NOT NULL THEN 0 ELSE greatest(0, least(1, ({' + '.join(f'{f} * t_{f}' for f in FEATURES)}) * CASE archetype
        WHEN 'CANVAS' THEN (CASE WHEN surface_readiness < .42 THEN .78 ELSE 1 END) * (CASE WHEN signal_clarity < .4 THEN .82 ELSE 1 END) * (CASE WHEN scene_preparation < .4 THEN .82 ELSE 1 END)
        WHEN 'STAGEKEEPER' THEN (CASE WHEN safe_containment < .48 THEN .76 ELSE 1 END) * (CASE WHEN scene_preparation < .44 THEN .82 ELSE 1 END)
        WHEN 'DEMIURGE' THEN (CASE WHEN closed_loop_learning < .35 THEN .78 ELSE 1 END) * (CASE WHEN rule_rewriting < .3 THEN .82 ELSE 1 END) * (CASE WHEN generativity < .35 THEN .82 ELSE 1 END)
        WHEN 'WORLD_REWRITER' THEN (CASE WHEN rule_rewriting < .42 THEN .76 ELSE 1 END) * (CASE WHEN world_modeling < .35 THEN .82 ELSE 1 END)
        WHEN 'UNIVERSAL' THEN (CASE WHEN transformation < .25 THEN .88 ELSE 1 END) * (CASE WHEN purification < .25 THEN .88 ELSE 1 END) * (CASE WHEN closed_loop_learning < .2 THEN .93 ELSE 1 END)
        ELSE 1 END)) END AS base_score
    FROM rej LEFT JOIN (SELECT name AS known FROM tgt) k ON known = archetype JOIN tgt ON name = coalesce(known, 'UNIVERSAL')
)"""


def _gate(source: str) -> str:
    return f"""
g1 AS (
    SELECT *, greatest(0, least(1, base_score)) AS material_score, (noise_removal + surface_readiness + signal_clarity + scene_preparation) / 4 AS canvas_score,
        (safe_containment + scene_preparation + signal_clarity + low_hazard + testability) / 5 AS stagekeeper_score, (rule_rewriting + closed_loop_learning + generativity + programmability + world_modeling + feedback_gain) / 6 AS demiurge_score,
        (signal_clarity + surface_readiness + testability + noise_removal) / 4 AS hypothesis_visibility, (safe_containment + low_hazard + bio_safety + durability + testability) / 5 AS containment_integrity
    FROM {source}
),
g2 AS (
    SELECT *, (canvas_score + stagekeeper_score + hypothesis_visibility + containment_integrity) / 4 AS scene_viability,
        (testability + low_hazard + containment_integrity + CASE WHEN list_contains(tags, 'EXPERT_VALIDATION_REQUIRED') THEN 1.0 ELSE 0.72 END) / 4 AS expert_gate
    FROM g1
),
g3 AS (
    SELECT *, (scene_viability + containment_integrity + hypothesis_visibility + expert_gate + .55 * demiurge_score + .45 * canvas_score) / 5 AS birth_readiness,
        CASE WHEN archetype IN {ENGINE} THEN (material_score + demiurge_score) / 2 * greatest(.1, expert_gate) * greatest(.1, hypothesis_visibility)
             WHEN archetype IN {STAGE} THEN (material_score + canvas_score + stagekeeper_score) / 3 * greatest(.1, expert_gate)
             ELSE material_score * greatest(.08, scene_viability) * greatest(.08, containment_integrity) * greatest(.08, hypothesis_visibility) * greatest(.08, expert_gate) END AS final_priority,
        creative_potential > .8 AND safe_containment < .3 AS c1, containment_integrity < .35 AS c2, hypothesis_visibility < .32 AS c3, scene_viability < .32 AS c4, expert_gate < .4 AS c5, reason IS NOT NULL AS c6,
        archetype IN {ENGINE} AND demiurge_score < .38 AS c7, archetype IN {STAGE} AND canvas_score < .38 AS c8
    FROM g2
),
gat AS (
    SELECT *, CASE WHEN c5 OR c6 THEN 'REJECTED' WHEN c3 THEN 'REVIEW' WHEN c1 OR c2 THEN 'REJECTED' WHEN c4 OR c7 OR c8 THEN 'REVIEW' ELSE 'PASSED' END AS gate_status,
        CASE WHEN NOT (c1 OR c2 OR c3 OR c4 OR c5 OR c6 OR c7 OR c8) THEN 'OK' ELSE concat_ws('; ', CASE WHEN c1 THEN 'UNSTABLE_BIRTH: creative_potential_high_but_safe_containment_low' END, CASE WHEN c2 THEN 'CONTAINMENT_INTEGRITY_LOW' END,
            CASE WHEN c3 THEN 'HYPOTHESIS_VISIBILITY_LOW' END, CASE WHEN c4 THEN 'SCENE_VIABILITY_LOW' END, CASE WHEN c5 THEN 'EXPERT_GATE_LOW' END, CASE WHEN c6 THEN 'HARD_REJECT:' || reason END,
            CASE WHEN c7 THEN 'DEMIURGE_SCORE_LOW' END, CASE WHEN c8 THEN 'CANVAS_SCORE_LOW' END) END AS gate_reason
    FROM g3
),
fin AS (SELECT *, greatest(0, least(1, final_priority * CASE gate_status WHEN 'REJECTED' THEN .2 WHEN 'REVIEW' THEN .62 ELSE 1 END)) AS score FROM gat)"""


ALL = f"""
one AS (
    SELECT fin.*, fingerprint, substr(sha256(fingerprint), 1, 16) AS hash16, coarse_key, s, components, n_of, top1 || '|' || top2 || '|' || ['matrix', 'mineral', 'sorbent', 'catalyst', 'energy', 'bio_process', 'engine', 'closed_loop'][list_position(list_transform([ma, mi, so, ca, en, bp, eg, cl], lambda v: round(v, 9)), list_max(list_transform([ma, mi, so, ca, en, bp, eg, cl], lambda v: round(v, 9))))] AS signature,
        array_to_string(list_sort(tags), ' ') AS process_tags, array_to_string(list_transform(s, lambda x: x.code || '=' || regexp_replace(printf('%.2f', x.frac * 100), '0$', '') || '%'), '; ') AS formula
    FROM fin JOIN keyed USING (candidate_id, archetype)
),
ddp AS (SELECT * FROM one WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY archetype, coarse_key, signature ORDER BY score DESC, hash16, candidate_id) = 1),
rnk AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) AS rank FROM ddp)"""

GATES = ["material_score", "canvas_score", "stagekeeper_score", "demiurge_score", "scene_viability", "birth_readiness", "containment_integrity", "hypothesis_visibility", "expert_gate", "final_priority"]


def _u(*key: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(key) + "), 1, 8))::UBIGINT / 4294967296.0)"


def _r(columns: list[str]) -> str:
    return ", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in columns)


TERMS = sorted(BANNED.split())


def _first_term(text: str, terms: list[str]) -> str:
    return f"list_filter({sorted(terms)!r}, lambda t: contains(upper({text}), t))[1]"


NOTES = (
    """'{"archetype":"' || archetype || '","archetype_description":"' || description || '","rejected":' || (reason IS NOT NULL) || ',"reject_reason":"' || coalesce(reason, '') || '","boundary":"Research vector only, not a synthesis protocol.","""
    f""""literal_transmutation_claim":false,"elixir_claim":false,"hazardous_synthesis_protocol":false,"certified_material_claim":false,"dangerous_chemistry_instructions":false,"demiurge_layer":' || (archetype IN {ENGINE}) || ',"birth_gate_layer":true,"""
    """"gate_status":"' || gate_status || '","gate_reason":"' || gate_reason || '"}'"""
)
FLAT = f"candidate_id, archetype, round(score + 1e-12, 8) AS score, hash16, formula, source, process_tags, {_r([*FEATURES, *GATES])}, round(w_density + 1e-10, 6) AS raw_density, {', '.join(f'round({c} + 1e-10, 6) AS {p}_like' for p, c in PHASE_NAMES.items())}, gate_status, gate_reason, false AS literal_transmutation_claim, false AS elixir_claim, false AS hazardous_synthesis_protocol, false AS certified_material_claim, false AS dangerous_chemistry_instructions, 'Research vector only, not a synthesis protocol.' AS boundary, archetype IN {ENGINE} AS demiurge_layer, true AS birth_gate_layer, components, {NOTES} AS notes_json"

DRAW = f"drw AS (SELECT t.name AS archetype, position, code, family, role, coalesce(f.b, 1) * coalesce(r.b, 1) * (0.25 + low_hazard + testability * 0.25 + ({' + '.join(META[1:] + META[:1])}) * 0.06) AS weight FROM cat CROSS JOIN tgt t LEFT JOIN bias f ON f.name = t.name AND f.label = family LEFT JOIN bias r ON r.name = t.name AND r.label = role)"
CDF = "cdf AS (SELECT *, max(up_to) OVER (PARTITION BY archetype) AS total FROM (SELECT *, sum(weight) OVER (PARTITION BY archetype ORDER BY position ROWS UNBOUNDED PRECEDING) AS up_to FROM drw))"
STARTED = "['CLEAN_CANVAS_SURFACE', 'SIGNAL_CLARITY_GATE', 'SAFE_CONTAINMENT_MATRIX', 'REPRODUCIBLE_SCENE_PROTOCOL']", "['GPT_TRANSFORMER_ENGINE', 'ACTIVE_LEARNING_AUTOLAB', 'SCORING_FUNCTION_MUTATOR', 'KNOWLEDGE_GRAPH_MEMORY', 'EXPERT_REVIEW_GATE']"
POOLS = {
    "stage": "family = 'canvas_layer' OR code IN ('ZEOLITE_SAFE', 'ACTIVATED_CARBON_SAFE', 'BACTERIAL_CELLULOSE_MATRIX', 'CLAY_PLATELET_BARRIER', 'CHITOSAN_BINDER')",
    "meta": "family = 'meta_engine'",
    "body": "code IN ('BACTERIAL_CELLULOSE_MATRIX', 'CHITOSAN_BINDER', 'ALGINATE_HYDROGEL', 'PVA_FILM', 'GELATIN_COLLAGEN_TOKEN')",
    "material": "family <> 'meta_engine'",
}
MUTATIONS = "['LAMINATED', 'HYDROGEL_NETWORK', 'BIOMINERALIZED', 'PHOTOCATALYTIC_SURFACE', 'ADSORBENT_CORE', 'SELF_HEALING_LAYER', 'CONDUCTIVE_TRACE', 'CLOSED_LOOP', 'RULE_REWRITE', 'WORLD_MODEL']"


def _perturbed(h: str, parts: str) -> str:
    """CTEs ph (candidate_id, archetype, source, tags) and pl (candidate_id, code, amount) of variants of the mixtures in h and parts."""
    u = lambda salt: _u("1", "candidate_id", f"'{salt}'")
    v = lambda salt: _u("1", "candidate_id", "code", f"'{salt}'")
    return f"""
pa AS (SELECT candidate_id, archetype, {u('add')} AS x FROM {h} WHERE {u('add?')} < 0.18),
pb AS (
    SELECT candidate_id, code, CASE WHEN {v('scale?')} < 0.18 THEN frac * (0.55 + {v('scale')}) ELSE frac END AS amount FROM {parts}
    UNION ALL
    SELECT candidate_id, min_by(code, position), any_value(0.01 + 0.15 * {u('amount')}) FROM pa JOIN cdf USING (archetype) WHERE up_to >= x * total GROUP BY candidate_id
),
pc AS (SELECT candidate_id, code, sum(amount) AS amount FROM pb GROUP BY ALL),
pl AS (SELECT candidate_id, code, amount FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY amount, code) AS r, count(*) OVER (PARTITION BY candidate_id) AS n FROM pc) WHERE NOT (r = 1 AND n > 5 AND {u('drop?')} < 0.18)),
ph AS (SELECT candidate_id, archetype, 'mutated' AS source, list_sort(list_distinct(CASE WHEN {u('tag?')} < 0.18 THEN list_append(tags, {MUTATIONS}[1 + floor({u('tag')} * 10)::INT]) ELSE tags END)) AS tags FROM {h})"""


def _sampled(h: str) -> str:
    """CTEs sh and sl of a random mixture for each candidate_id and archetype in h."""
    u = lambda *salt: _u("1", "candidate_id", *(f"'{x}'" if x != "k" and x != "code" else x for x in salt))
    pools = " UNION ALL ".join(f"SELECT '{p}' AS pool, archetype, position, code, weight FROM drw WHERE {w}" for p, w in POOLS.items())
    counts = {"stage": f"2 + floor({u('n')} * 4)", "meta": f"2 + floor({u('n')} * 4)", "body": f"CASE WHEN archetype IN ('CATALYST', 'ENERGY') THEN 1 ELSE 1 + floor({u('n body')} * 3) END", "material": f"3 + floor({u('n')} * 6)"}
    amount = {"stage": "0.02 + 0.16", "meta": "0.02 + 0.16", "body": "0.04 + 0.21", "material": "0.01 + 0.21"}
    draws = " UNION ALL ".join(f"SELECT candidate_id, archetype, '{p}' AS pool, k, {u(p, 'k')} AS x, {amount[p]} * {u(p + ' amount', 'k')} AS amount FROM (SELECT candidate_id, archetype, unnest(range(1, ({n})::BIGINT + 1)) AS k FROM sr WHERE kind = '{'material' if p == 'body' else p}')" for p, n in counts.items())
    essentials = " UNION ALL ".join(f"SELECT candidate_id, code, 0.04 + 0.16 * {u('essential', 'code')} AS amount FROM (SELECT candidate_id, unnest({codes}) AS code FROM sr WHERE kind = '{kind}')" for kind, codes in zip(("stage", "meta"), STARTED, strict=True))
    chances = [("LAMINATED", .45, "", .45), ("HYDROGEL_NETWORK", .45, "'HEALER', 'LIFE'", .2), ("BIOMINERALIZED", .62, "'BIOMINERAL', 'LIFE'", .22), ("PHOTOCATALYTIC_SURFACE", .62, "'CATALYST', 'ENERGY'", .18), ("ADSORBENT_CORE", .65, "'PURIFIER', 'UNIVERSAL'", .3), ("SELF_HEALING_LAYER", .66, "'HEALER'", .24), ("CONDUCTIVE_TRACE", .62, "'ENERGY'", .14), ("STONE_BODY", .62, "'STONE', 'BIOMINERAL'", .25), ("ANIMA_BIO", .58, "'LIFE', 'BIOMINERAL'", .18)]
    tags = ", ".join(f"CASE WHEN kind = 'material' AND {u('tag', t)} < " + (f"CASE WHEN archetype IN ({who}) THEN {p} ELSE {q} END" if who else f"{q}") + f" THEN '{t}' END" for t, p, who, q in chances)
    return f"""
sr AS (SELECT candidate_id, archetype, CASE WHEN archetype IN {STAGE} THEN 'stage' WHEN archetype IN {ENGINE} THEN 'meta' ELSE 'material' END AS kind FROM {h}),
sc AS (SELECT *, max(up_to) OVER (PARTITION BY pool, archetype) AS total FROM (SELECT *, sum(weight) OVER (PARTITION BY pool, archetype ORDER BY position ROWS UNBOUNDED PRECEDING) AS up_to FROM ({pools}))),
sd AS ({draws}),
se AS (
    {essentials}
    UNION ALL SELECT candidate_id, code, amount FROM (SELECT candidate_id, pool, k, min_by(code, position) AS code, any_value(amount) AS amount FROM sd JOIN sc USING (pool, archetype) WHERE up_to >= x * total GROUP BY candidate_id, pool, k)
    UNION ALL SELECT candidate_id, 'ACTIVE_LEARNING_AUTOLAB', 0.01 + 0.04 * {u('aid')} FROM sr WHERE kind = 'material' AND {u('aid?')} < 0.25
),
sl AS (SELECT candidate_id, code, sum(amount) AS amount FROM se GROUP BY ALL),
sh AS (SELECT candidate_id, archetype, 'random' AS source, list_sort(list_distinct(list_filter(list_concat(['LOW_HAZARD_GATE', 'EXPERT_VALIDATION_REQUIRED'],
        CASE kind WHEN 'stage' THEN ['CLEAN_CANVAS', 'LOW_NOISE_FIELD', 'SAFE_STAGE'] WHEN 'meta' THEN ['CLOSED_LOOP', 'RULE_REWRITE', 'DEMIURGE_LAYER'] ELSE []::VARCHAR[] END,
        CASE archetype WHEN 'STAGEKEEPER' THEN ['SAFE_CONTAINMENT', 'REPRODUCIBLE_SCENE'] WHEN 'WORLD_REWRITER' THEN ['WORLD_MODEL', 'SEARCH_SPACE_EDITOR'] ELSE []::VARCHAR[] END, [{tags}]), lambda t: t IS NOT NULL))) AS tags FROM sr)"""


def _scored(name: str, h: str, parts: str) -> str:
    return f"{name} AS (WITH hdr AS (SELECT * FROM {h}), shr AS (SELECT candidate_id, code, amount / sum(amount) OVER (PARTITION BY candidate_id) AS frac FROM {parts}), {WIDE}, {SCREEN}, {_gate('sco')}, {KEYS}, {ALL} SELECT candidate_id, archetype, source, hash16, signature, round(score + 1e-12, 8) AS score FROM one)"


def _batched() -> str:
    """CTEs vh and vl of the variants of a batch, from pool and the header's profiles."""
    u = lambda *salt: _u("1", "candidate_id", *(f"'{x}'" if isinstance(x, str) else str(x) for x in salt))
    return f"""
pool AS (SELECT candidate_id, archetype, source, tags, s, hash16, score, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) AS rank FROM (SELECT * REPLACE (round(score + 1e-12, 8) AS score) FROM one) QUALIFY rank <= 280),
share AS (SELECT candidate_id AS parent, x.code AS code, x.frac AS frac FROM (SELECT candidate_id, unnest(s) AS x FROM pool)),
trial AS (SELECT *, {u('route')} AS route, 1 + least({', '.join(f"floor({u('entrant', k)} * n)" for k in range(9))})::BIGINT AS best, floor({u('first')} * n)::BIGINT AS f, floor({u('second')} * (n - 1))::BIGINT AS g
    FROM (SELECT -candidate_id - 1 AS candidate_id, archetype, coalesce(n, 0) AS n FROM hdr LEFT JOIN (SELECT archetype, count(*) AS n FROM pool GROUP BY archetype) USING (archetype))),
mu AS (SELECT t.candidate_id, t.archetype, p.tags, p.candidate_id AS parent FROM trial t JOIN pool p ON p.archetype = t.archetype AND p.rank = best WHERE route < 0.55),
mp AS (SELECT mu.candidate_id, code, frac FROM mu JOIN share USING (parent)),
{_perturbed('mu', 'mp')},
xo AS (SELECT t.candidate_id, t.archetype, a.tags AS ta, b.tags AS tb, a.candidate_id AS pa, b.candidate_id AS pb, 0.25 + 0.5 * {_u('1', 't.candidate_id', "'alpha'")} AS alpha
    FROM trial t JOIN pool a ON a.archetype = t.archetype AND a.rank = f + 1 JOIN pool b ON b.archetype = t.archetype AND b.rank = (f + 1 + g) % n + 1 WHERE route >= 0.55 AND route < 0.82 AND n > 1),
xl AS (SELECT candidate_id, code, sum(w * frac) AS amount FROM (SELECT candidate_id, pa AS parent, alpha AS w FROM xo UNION ALL SELECT candidate_id, pb, 1 - alpha FROM xo) JOIN share USING (parent) GROUP BY ALL),
xh AS (SELECT candidate_id, archetype, 'crossover' AS source, list_sort(list_distinct(list_concat(ta, tb))) AS tags FROM xo),
rest AS (SELECT candidate_id, archetype FROM trial WHERE NOT (route < 0.55 AND n > 0) AND NOT (route >= 0.55 AND route < 0.82 AND n > 1)),
{_sampled('rest')},
vh AS (SELECT * FROM ph UNION ALL SELECT * FROM xh UNION ALL SELECT * FROM sh),
vl AS (SELECT * FROM pl UNION ALL SELECT * FROM xl UNION ALL SELECT * FROM sl)"""


def oracle_sql() -> dict[str, str]:
    base, wide = f"WITH {CATALOG}, {TARGET}, {HEADER}", f"WITH {CATALOG}, {TARGET}, {HEADER}, {WIDE}"
    keyed, feat, fin = f"{base}, {KEYS}", f"{wide}, {SCREEN}", f"{wide}, {SCREEN}, {_gate('sco')}"
    every = f"{fin}, {KEYS}, {ALL}"
    ledger = "candidate_id, archetype, hash16, round(score + 1e-12, 8) AS score_final, formula, source, gate_status, gate_reason, " + _r([*GATES, "creative_potential", "safe_containment", "signal_clarity"]) + ", process_tags, components"
    drawn = f"{BIAS}, {DRAW}, {CDF}"
    odd = "hd2 AS (SELECT candidate_id, CASE WHEN candidate_id % 100 = 7 THEN 'ANY_OTHER' ELSE archetype END AS archetype, source, CASE WHEN candidate_id % 400 = 0 THEN list_append(tags, 'LEAD_TEST') ELSE tags END AS tags FROM hdr)"
    objectives = " || ' ' || ".join(f"printf('%.6f', round({c} + 1e-10, 6))" for c in [*FEATURES, *GATES])
    why = "CASE archetype " + " ".join(f"WHEN '{line.split(': ', 1)[0]}' THEN '{line.split(': ', 1)[1]}'" for line in INTERPRETATIONS.split("\n") if line) + " ELSE 'modern research vector' END"
    bound = "'No literal transmutation claim. No elixir claim. No hazardous synthesis protocol. No certified material claim. No instructions for dangerous chemistry. Computational research vector and expert-review request only.'"
    inputs = f"""inp AS (SELECT event_id AS candidate_id, (SELECT name FROM tgt WHERE ordinal = floor({_u("event_id", "'archetype'")} * 13)) AS archetype, CASE WHEN {_u("event_id", "'tag'")} < 0.5 THEN ['EXPERT_VALIDATION_REQUIRED'] ELSE []::VARCHAR[] END AS tags,
        CASE WHEN {_u("event_id", "'reject'")} < 0.05 THEN 'x' END AS reason, {_u("event_id", "'base'")} AS base_score, {', '.join(f"{_u('event_id', repr(f))} AS {f}" for f in FEATURES)} FROM events)"""
    prs = "prs AS (SELECT h.candidate_id AS pair_id, h.candidate_id AS a, h.candidate_id + 1 AS b, h.tags AS ta, k.tags AS tb, 0.25 + 0.5 * " + _u("1", "h.candidate_id", "'alpha'") + " AS alpha FROM hdr h JOIN hdr k ON k.candidate_id = h.candidate_id + 1)"
    tests = "'EXPERT_IDENTITY_REVIEW | SAFETY_BOUNDARY_REVIEW | FUNCTIONAL_SCREENING_FOR_ARCHETYPE | NO_HAZARDOUS_SYNTHESIS_WITHOUT_QUALIFIED_LAB' || CASE WHEN archetype IN ('CATALYST', 'ENERGY') THEN ' | SAFE_CATALYTIC_OR_PHOTO_ELECTROCHEMICAL_MODEL_SCREENING' WHEN archetype = 'PURIFIER' THEN ' | ADSORPTION_OR_SEPARATION_SCREENING' WHEN archetype = 'HEALER' THEN ' | SELF_HEALING_OR_DAMAGE_RECOVERY_SCREENING' WHEN archetype IN ('STONE', 'BIOMINERAL') THEN ' | STRUCTURE_MECHANICAL_OR_BIOMINERAL_REVIEW' WHEN archetype IN ('CANVAS', 'STAGEKEEPER') THEN ' | LOW_NOISE_SCENE_REVIEW | REPRODUCIBILITY_AND_CONTAINMENT_REVIEW | SURFACE_READINESS_REVIEW' WHEN archetype IN ('DEMIURGE', 'WORLD_REWRITER') THEN ' | CLOSED_LOOP_DISCOVERY_REVIEW | SEARCH_SPACE_REWRITE_REVIEW | REPRODUCIBILITY_AND_HUMAN_GATE_REVIEW' ELSE '' END"
    tags = "coalesce(array_to_string(list_sort(tags), ' '), '')"
    return {
        "catalog_profile": f"{base}, use AS (SELECT code, count(*) AS n, sum(amount) AS amount FROM lin GROUP BY code) SELECT family, role, count(*) AS n_codes, sum(n)::BIGINT AS n_mixtures, sum(amount) AS amount, round(avg(low_hazard) + 1e-10, 6) AS low_hazard FROM cat LEFT JOIN use USING (code) GROUP BY family, role",
        "target_weights": f"{base}, n AS (SELECT archetype, count(*) AS n FROM hdr GROUP BY archetype) SELECT feature, round(sum(weight * n) + 1e-10, 6) AS mass, count(*) AS n_profiles FROM (UNPIVOT (SELECT name, {', '.join(f't_{f} AS {f}' for f in FEATURES)} FROM tgt) ON {', '.join(FEATURES)} INTO NAME feature VALUE weight) JOIN n ON archetype = name WHERE weight > 0 GROUP BY feature",
        "term_screen": f"SELECT doc_id, {_first_term("coalesce(text, '')", [*TERMS, 'LICENSE', 'NOT', 'THE', 'WORTHLESS'])} AS term FROM documents",
        "csv_roundtrip": f"{base} SELECT candidate_id, archetype, {tags} AS process_tags, '' AS note FROM hdr",
        "json_roundtrip": f"{base} SELECT candidate_id, archetype, coalesce(array_to_string(tags, ' '), '') AS process_tags FROM hdr",
        "partitioned_output": f"{base} SELECT candidate_id, archetype FROM hdr WHERE archetype = 'CANVAS'",
        "mixture_normalize": f"{base} SELECT candidate_id, code, round(frac + 1e-13, 9) AS frac FROM shr",
        "mixture_fingerprint": f"{keyed} SELECT candidate_id, fingerprint, substr(sha256(fingerprint), 1, 16) AS hash16 FROM keyed",
        "formula_string": f"{keyed} SELECT candidate_id, array_to_string(list_transform(s, lambda x: x.code || '=' || regexp_replace(printf('%.2f', x.frac * 100), '0$', '') || '%'), '; ') AS formula FROM keyed",
        "coarse_key": f"{keyed} SELECT candidate_id, coarse_key FROM keyed",
        "top2_components": f"{keyed} SELECT candidate_id, top1, top2 FROM keyed",
        "diversity_signature": f"{every} SELECT candidate_id, signature FROM one",
        "weighted_profile": f"{wide} SELECT candidate_id, {', '.join(f'round(w_{p} + 1e-10, 6) AS {p}' for p in PROPERTIES)} FROM wide",
        "phase_shares": f"{wide} SELECT candidate_id, {', '.join(f'round({c} + 1e-10, 6) AS {p}_like' for p, c in PHASE_NAMES.items())} FROM wide",
        "role_share": f"{base} SELECT candidate_id, {', '.join(f'''round(sum(CASE WHEN role = '{r}' OR family = '{r}' THEN frac ELSE 0 END) + 1e-10, 6) AS {r}''' for r in ('matrix', 'sorbent', 'catalyst', 'advanced'))} FROM shr JOIN cat USING (code) GROUP BY candidate_id",
        "mixture_features": f"{feat} SELECT candidate_id, {_r(FEATURES)} FROM feat",
        "evenness_bonus": f"{wide} SELECT candidate_id, round(list_min(x) + 1e-10, 6) AS least, round(1 - list_stddev_pop(x) + 1e-10, 6) AS evenness FROM (SELECT candidate_id, [{', '.join(f'w_{f}' for f in FEATURES[:8])}] AS x FROM wide)",
        "hard_reject": f"{wide}, {odd}, {SCREEN.replace('JOIN hdr USING', 'JOIN hd2 USING')}, cod AS (SELECT candidate_id, string_agg(code, ' ') AS codes FROM lin GROUP BY ALL), trm AS (SELECT rej.*, {_first_term("source || ' ' || archetype || ' ' || array_to_string(tags, ' ') || ' ' || coalesce(codes, '')", TERMS)} AS term FROM rej LEFT JOIN cod USING (candidate_id)) SELECT candidate_id, coalesce('banned_token:' || term, reason, '') AS reason FROM trm",
        "profile_score": f"{feat} SELECT candidate_id, round(base_score + 1e-12, 8) AS base_score FROM sco",
        "gate_metrics": f"{fin} SELECT candidate_id, {_r(GATES)} FROM fin",
        "gate_status": f"WITH {TARGET}, {inputs}, {_gate('inp')} SELECT candidate_id AS event_id, gate_status, gate_reason FROM fin",
        "final_score": f"{fin} SELECT candidate_id, gate_status, gate_reason, round(score + 1e-12, 8) AS score FROM fin",
        "dedup_diverse": f"{every} SELECT archetype, coarse_key, signature, candidate_id FROM ddp",
        "topk_diverse": f"{every} SELECT archetype, rank, candidate_id, round(score + 1e-12, 8) AS score FROM rnk WHERE rank <= 20",
        "pool_truncate": f"{every} SELECT archetype, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) AS rank, candidate_id, round(score + 1e-12, 8) AS score FROM one QUALIFY rank <= 280",
        "champions": f"{every}, b AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) = 1) SELECT row_number() OVER (ORDER BY ordinal) AS rank, archetype, candidate_id, round(score + 1e-12, 8) AS score FROM b",
        "archetype_shortlist": f"{every} SELECT row_number() OVER (ORDER BY ordinal, rank) AS rank, archetype, candidate_id, round(score + 1e-12, 8) AS score FROM (SELECT * FROM rnk WHERE rank <= 4)",
        "nested_rows": f"{every} SELECT candidate_id, archetype, round(score + 1e-12, 8) AS score, formula AS formula_percent, n_of AS n_components, round(transformation + 1e-10, 6) AS transformation, gate_status, round(final_priority + 1e-10, 6) AS final_priority, reason IS NOT NULL AS rejected, 'Research vector only, not a synthesis protocol.' AS boundary FROM one",
        "candidate_flat": f"{every} SELECT {FLAT} FROM one",
        "top_flat": f"{every} SELECT rank, {FLAT} FROM rnk WHERE rank <= 20",
        "decision_ledger": f"{every} SELECT {ledger} FROM one",
        "gate_ledger": f"{every} SELECT {ledger} FROM one ORDER BY final_priority DESC, candidate_id",
        "rejected_ledger": f"{every} SELECT {ledger} FROM one WHERE gate_status <> 'PASSED'",
        "gate_summary": f"{fin} SELECT count(*) AS n_rows, count(*) FILTER (gate_status <> 'PASSED') AS rejected_or_review FROM fin",
        "archetype_summary": f"{every} SELECT archetype, count(*) AS n_rows, count(*) FILTER (gate_status = 'PASSED') AS n_passed, first(candidate_id ORDER BY score DESC, hash16, candidate_id) AS best_id, round(max(score) + 1e-12, 8) AS best_score FROM one GROUP BY archetype",
        "stored_screen": f"{fin} SELECT candidate_id, gate_status, gate_reason, round(score + 1e-12, 8) AS score FROM fin",
        "second_catalog": f"WITH {SECOND}, {TARGET}, {HEADER.replace('hdr AS', 'hd0 AS', 1).replace('FROM hdr LEFT', 'FROM hd0 LEFT')}, hdr AS (SELECT * REPLACE (CASE WHEN candidate_id % 100 = 7 THEN 'ANY_OTHER' ELSE archetype END AS archetype) FROM hd0), {WIDE}, {SCREEN}, {_gate('sco')} SELECT candidate_id, archetype, description, coalesce(reason, '') AS reason, round(base_score + 1e-12, 8) AS base_score, gate_status, round(score + 1e-12, 8) AS score FROM fin",
        "dated_requests": f"{every} SELECT 'DR-' || strftime(o_orderdate, '%Y%m%d') || '-' || archetype || '-' || lpad(rank::VARCHAR, 2, '0') || '-R1' AS request_id, archetype, round(score + 1e-12, 8) AS score, hash16 FROM rnk JOIN orders ON o_orderkey = candidate_id WHERE rank <= 2",
        "report_bundle": f"{every}, best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) = 1) SELECT 'champions' AS report, count(*) AS n_rows, sum(candidate_id)::BIGINT AS ids FROM best UNION ALL SELECT 'profiles', count(*), sum(candidate_id)::BIGINT FROM best UNION ALL SELECT 'shortlist', count(*), sum(candidate_id)::BIGINT FROM rnk WHERE rank <= 4 UNION ALL SELECT 'top', count(*), sum(candidate_id)::BIGINT FROM rnk WHERE rank <= 20 UNION ALL SELECT 'decisions', count(*), sum(candidate_id)::BIGINT FROM one UNION ALL SELECT 'rejected', count(*), sum(candidate_id)::BIGINT FROM one WHERE gate_status <> 'PASSED' UNION ALL SELECT 'requests', 2 * count(*), NULL FROM rnk WHERE rank <= 3 UNION ALL SELECT 'gate', 1, NULL",
        "run_summary": f"{fin} SELECT count(*) AS n_rows, count(*) FILTER (gate_status <> 'PASSED') AS rejected_or_review, count(DISTINCT archetype)::INT AS n_champions, (SELECT string_agg(name, ',' ORDER BY ordinal) FROM tgt WHERE name IN (SELECT archetype FROM hdr)) AS profiles FROM fin",
        "review_requests": f"{every} SELECT 'RQ-20260101-' || archetype || '-' || lpad(rank::VARCHAR, 2, '0') || '-R' || r AS request_id, archetype, description AS archetype_description, rank AS rank_within_archetype, round(score + 1e-12, 8) AS score, hash16, formula, process_tags, {tests} AS requested_tests, 'REQUEST_FOR_EXPERT_REVIEW_NOT_MEASURED_RESULTS' AS data_status, {why} AS why, {bound} AS claim_boundary, components, {objectives} AS objectives FROM rnk, (VALUES (1), (2)) AS v(r) WHERE rank <= 3",
        "blend_pairs": f"{base}, {prs} SELECT pair_id, code, round(sum(p * frac) + 1e-13, 9) AS amount FROM (SELECT pair_id, a AS candidate_id, alpha AS p FROM prs UNION ALL SELECT pair_id, b, 1 - alpha FROM prs) JOIN shr USING (candidate_id) GROUP BY pair_id, code",
        "tag_union": f"{base}, {prs} SELECT pair_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(ta, tb))), ' '), '') AS tags FROM prs",
        "draw_weights": f"{base}, {BIAS}, {DRAW} SELECT archetype, code, round(weight + 1e-13, 9) AS weight, n_mixtures FROM drw JOIN (SELECT archetype, count(*) AS n_mixtures FROM hdr GROUP BY archetype) USING (archetype)",
        "weighted_draw": f"{base}, {drawn}, r AS (SELECT candidate_id, archetype, {_u('candidate_id', chr(39) + 'draw' + chr(39))} AS u FROM hdr) SELECT candidate_id, min_by(code, position) AS drawn FROM r JOIN cdf USING (archetype) WHERE up_to >= u * total GROUP BY candidate_id",
        "perturb_mixtures": f"{base}, {drawn}, {_perturbed('hdr', 'shr')} SELECT candidate_id, code, round(amount + 1e-13, 9) AS amount FROM pl",
        "sample_mixtures": f"{base}, {drawn}, {_sampled('hdr')} SELECT candidate_id, code, round(amount + 1e-13, 9) AS amount FROM sl",
        "diversity_backfill": f"{every}, kept AS (SELECT archetype, signature FROM rnk WHERE rank <= 20), short AS (SELECT archetype, 24 - coalesce(n, 0) AS missing FROM (SELECT DISTINCT archetype FROM hdr) LEFT JOIN (SELECT archetype, count(*) AS n FROM kept GROUP BY archetype) USING (archetype)), names AS (SELECT archetype, row_number() OVER (ORDER BY archetype) - 1 AS place, count(*) OVER () AS profiles FROM (SELECT DISTINCT archetype FROM hdr)), turns AS (SELECT -(k * profiles + place) - 1 AS candidate_id, archetype FROM names, range(400) AS t(k)), {drawn}, {_sampled('turns')}, {_scored('fresh', 'sh', 'sl')}, best AS (SELECT * FROM fresh WHERE score > 0 AND (archetype, signature) NOT IN (SELECT (archetype, signature) FROM kept) QUALIFY row_number() OVER (PARTITION BY archetype, signature ORDER BY candidate_id DESC) = 1) SELECT archetype, row_number() OVER (PARTITION BY archetype ORDER BY candidate_id DESC) AS rank, candidate_id, score FROM best JOIN short USING (archetype) QUALIFY rank <= missing",
        "variant_batch": f"{every}, {drawn}, {_batched()}, {_scored('fresh', 'vh', 'vl')} SELECT archetype, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, hash16, candidate_id) AS rank, candidate_id, source, score FROM (SELECT candidate_id, archetype, source, hash16, score FROM pool UNION ALL SELECT candidate_id, archetype, source, hash16, score FROM fresh) QUALIFY rank <= 280",
        "tournament_pick": f"{every}, n AS (SELECT archetype, count(*) AS n FROM one GROUP BY archetype), ring AS (SELECT archetype, slot, candidate_id, hash16, score, 9.0::DOUBLE / n AS wide, {_u('1', 'candidate_id', "'ring'")} AS place, {_u('1', 'archetype', 'slot')} AS start FROM one JOIN n USING (archetype), range(20) AS t(slot)) SELECT archetype, slot::INT AS slot, first(candidate_id ORDER BY round(score + 1e-12, 8) DESC, hash16, candidate_id) AS candidate_id FROM ring WHERE place - start + (place < start)::INT < wide GROUP BY archetype, slot",
    }
