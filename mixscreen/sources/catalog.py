"""The ingredient catalog, target profiles and term list, as text and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATERIAL = "transformation purification self_healing structure_strength durability bio_safety energy_conversion biomineralization accessibility testability low_hazard".split()
META = "rule_rewriting autocatalysis closed_loop_learning generativity programmability world_modeling agency feedback_gain".split()
CANVAS = "noise_removal surface_readiness signal_clarity safe_containment scene_preparation creative_potential".split()
FEATURES = MATERIAL + META + CANVAS
PROPERTIES = [*FEATURES, "density"]

# Code, family, role, then the properties in the order of PROPERTIES.
INGREDIENTS = """
BACTERIAL_CELLULOSE_MATRIX biopolymer matrix 0.20 0.25 0.45 0.70 0.45 0.95 0.08 0.35 0.78 0.72 0.95 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.35
CHITOSAN_BINDER biopolymer binder 0.22 0.58 0.45 0.55 0.48 0.86 0.06 0.20 0.65 0.72 0.88 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.42
ALGINATE_HYDROGEL biopolymer hydrogel 0.15 0.28 0.70 0.36 0.35 0.92 0.03 0.26 0.72 0.75 0.90 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.60
PVA_FILM polymer binder 0.12 0.18 0.62 0.45 0.42 0.80 0.03 0.04 0.82 0.75 0.82 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.19
GELATIN_COLLAGEN_TOKEN biopolymer binder 0.12 0.18 0.66 0.40 0.35 0.82 0.02 0.18 0.70 0.70 0.82 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.30
TANNIC_ACID_POLYPHENOL bioactive crosslinker 0.36 0.48 0.48 0.36 0.42 0.78 0.08 0.08 0.60 0.62 0.78 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.50
CITRIC_ACID_SAFE_TOKEN modifier weak_acid 0.25 0.18 0.28 0.22 0.32 0.90 0.02 0.06 0.95 0.78 0.92 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.66
GLYCEROL_SAFE_TOKEN modifier plasticizer 0.08 0.12 0.50 0.05 0.20 0.92 0.01 0.02 0.95 0.80 0.92 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.26
SILICA_BIOSILICA_SAFE mineral mineral 0.18 0.28 0.08 0.78 0.86 0.84 0.03 0.22 0.86 0.72 0.86 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2.20
CLAY_PLATELET_BARRIER mineral platelet 0.16 0.56 0.12 0.62 0.76 0.82 0.04 0.06 0.92 0.76 0.84 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2.35
ZEOLITE_SAFE mineral sorbent 0.46 0.82 0.05 0.52 0.74 0.80 0.08 0.02 0.78 0.78 0.82 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2.10
HYDROXYAPATITE_SAFE biomineral biomineral 0.20 0.46 0.16 0.58 0.70 0.88 0.03 0.72 0.68 0.75 0.88 0 0 0 0 0 0 0 0 0 0 0 0 0 0 3.10
CALCIUM_CARBONATE_BIOMINERAL biomineral biomineral 0.16 0.30 0.12 0.56 0.66 0.88 0.02 0.82 0.90 0.78 0.90 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2.70
MAGNESIUM_PHOSPHATE_SAFE biomineral biomineral 0.18 0.34 0.10 0.60 0.72 0.84 0.02 0.70 0.68 0.70 0.84 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2.70
BIOCHAR_SAFE carbon sorbent 0.42 0.78 0.06 0.45 0.64 0.72 0.22 0.04 0.85 0.75 0.75 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.80
ACTIVATED_CARBON_SAFE carbon sorbent 0.42 0.88 0.04 0.42 0.62 0.76 0.20 0.02 0.88 0.80 0.78 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.80
BIOBASED_ION_EXCHANGE_TOKEN sorbent sorbent 0.38 0.80 0.08 0.28 0.46 0.74 0.05 0.04 0.48 0.62 0.70 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.25
TITANIUM_DIOXIDE_SAFE_TOKEN photocatalyst catalyst 0.78 0.56 0.02 0.52 0.82 0.70 0.70 0.02 0.70 0.78 0.72 0 0 0 0 0 0 0 0 0 0 0 0 0 0 4.20
IRON_OXIDE_SAFE_TOKEN oxide catalyst_support 0.54 0.42 0.02 0.56 0.72 0.72 0.36 0.04 0.82 0.78 0.76 0 0 0 0 0 0 0 0 0 0 0 0 0 0 5.20
ZINC_OXIDE_SAFE_TOKEN oxide catalyst 0.62 0.42 0.02 0.50 0.74 0.62 0.55 0.02 0.70 0.72 0.62 0 0 0 0 0 0 0 0 0 0 0 0 0 0 5.60
MANGANESE_DIOXIDE_SAFE_TOKEN oxide redox_catalyst 0.70 0.48 0.01 0.48 0.72 0.58 0.42 0.02 0.55 0.70 0.62 0 0 0 0 0 0 0 0 0 0 0 0 0 0 5.00
ENZYME_LACCASE_TOKEN enzyme biocatalyst 0.82 0.64 0.10 0.08 0.25 0.80 0.08 0.14 0.45 0.62 0.86 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.30
ENZYME_CATALASE_TOKEN enzyme biocatalyst 0.72 0.44 0.06 0.06 0.24 0.82 0.06 0.08 0.45 0.62 0.86 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.30
ENZYME_CELLULASE_TOKEN enzyme biocatalyst 0.60 0.30 0.08 0.04 0.18 0.78 0.04 0.08 0.42 0.55 0.82 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.30
PEDOT_PSS_SAFE_TOKEN conductive_polymer energy 0.44 0.18 0.28 0.30 0.45 0.58 0.72 0.02 0.42 0.62 0.60 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.10
CARBON_BLACK_SAFE_TOKEN carbon energy 0.36 0.40 0.02 0.42 0.64 0.50 0.68 0.01 0.70 0.68 0.55 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.85
GRAPHENE_OXIDE_SAFE_TOKEN carbon advanced 0.50 0.48 0.18 0.70 0.70 0.46 0.62 0.02 0.28 0.55 0.48 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.90
POLYDOPAMINE_SAFE_TOKEN bioinspired adhesion 0.38 0.42 0.56 0.42 0.50 0.66 0.22 0.08 0.36 0.54 0.62 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.30
BIOMINERALIZATION_MICROBE_TOKEN bio_process process 0.45 0.50 0.42 0.50 0.52 0.70 0.06 0.92 0.36 0.48 0.68 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.20
MYCELIUM_BINDER_TOKEN bio_process binder 0.28 0.36 0.58 0.42 0.44 0.74 0.04 0.68 0.42 0.50 0.72 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0.80
KOMBUCHA_FERMENTATION_TOKEN bio_process process 0.25 0.28 0.45 0.52 0.34 0.88 0.03 0.58 0.68 0.55 0.88 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.10
DIATOM_BIOSILICA_TOKEN bio_process biomineral 0.22 0.38 0.18 0.58 0.70 0.80 0.08 0.88 0.28 0.42 0.76 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1.70
CLEAN_CANVAS_SURFACE canvas_layer surface 0 0.62 0 0 0.50 0.86 0 0 0.72 0.86 0.88 0 0 0 0 0 0 0 0 0.82 0.94 0.82 0.54 0.88 0.66 1.20
SIGNAL_CLARITY_GATE canvas_layer clarity_gate 0 0.58 0 0 0.42 0.84 0 0 0.66 0.92 0.88 0 0 0 0 0 0 0 0 0.74 0.72 0.96 0.50 0.78 0.58 1.10
SAFE_CONTAINMENT_MATRIX canvas_layer containment 0 0.42 0 0 0.76 0.92 0 0 0.70 0.88 0.94 0 0 0 0 0 0 0 0 0.50 0.62 0.66 0.96 0.88 0.54 1.40
REPRODUCIBLE_SCENE_PROTOCOL canvas_layer stage_protocol 0 0.50 0 0 0.58 0.88 0 0 0.82 0.96 0.94 0 0 0 0 0 0 0 0 0.68 0.84 0.86 0.82 0.94 0.62 1.00
LOW_NOISE_MEMORY_FIELD canvas_layer memory_field 0 0.46 0 0 0.48 0.90 0 0 0.72 0.84 0.94 0 0 0.48 0 0 0.40 0 0 0.86 0.68 0.88 0.66 0.82 0.72 1.00
CREATIVE_POTENTIAL_SEED canvas_layer creative_seed 0 0.34 0 0 0.42 0.86 0 0 0.74 0.74 0.92 0 0 0 0.36 0 0 0 0 0.46 0.76 0.70 0.60 0.88 0.98 1.00
GPT_TRANSFORMER_ENGINE meta_engine engine 0 0 0 0 0 0 0 0 0 0.78 0.92 0.72 0.40 0.55 0.95 0.88 0.74 0.52 0.60 0 0 0 0 0 0 1
EVOLUTIONARY_SEARCH_LOOP meta_engine optimizer 0 0 0 0 0 0 0 0 0 0.82 0.92 0.60 0.72 0.55 0.74 0.78 0.48 0.55 0.66 0 0 0 0 0 0 1
BAYESIAN_OPTIMIZER meta_engine optimizer 0 0 0 0 0 0 0 0 0 0.80 0.92 0.55 0.62 0.78 0.58 0.74 0.72 0.48 0.74 0 0 0 0 0 0 1
ACTIVE_LEARNING_AUTOLAB meta_engine closed_loop 0 0 0 0 0 0 0 0 0 0.76 0.90 0.66 0.72 0.95 0.62 0.72 0.76 0.62 0.92 0 0 0 0 0 0 1
KNOWLEDGE_GRAPH_MEMORY meta_engine memory 0 0 0 0 0 0 0 0 0 0.84 0.95 0.52 0.42 0.78 0.45 0.70 0.88 0.38 0.70 0 0 0 0 0 0 1
SCORING_FUNCTION_MUTATOR meta_engine rule_editor 0 0 0 0 0 0 0 0 0 0.70 0.92 0.95 0.70 0.66 0.68 0.84 0.62 0.74 0.72 0 0 0 0 0 0 1
SIMULATION_SURROGATE_MODEL meta_engine world_model 0 0 0 0 0 0 0 0 0 0.72 0.94 0.45 0.55 0.70 0.40 0.78 0.94 0.36 0.68 0 0 0 0 0 0 1
EXPERT_REVIEW_GATE meta_engine safety_gate 0 0 0 0 0 0 0 0 0 0.95 0.98 0.38 0.20 0.50 0.20 0.60 0.58 0.25 0.82 0 0 0 0 0 0 1
REPOSITORY_PUBLICATION_LOOP meta_engine publication 0 0 0 0 0 0 0 0 0 0.90 0.96 0.50 0.66 0.62 0.48 0.54 0.45 0.46 0.78 0 0 0 0 0 0 1
SYMBOLIC_INTERPRETER meta_engine interpreter 0 0 0 0 0 0 0 0 0 0.66 0.94 0.84 0.52 0.50 0.82 0.72 0.70 0.72 0.56 0 0 0 0 0 0 1
"""

# Weights of each target profile; each line adds up to 1.
TARGETS = """
UNIVERSAL transformation=0.14 purification=0.13 self_healing=0.11 structure_strength=0.10 durability=0.10 bio_safety=0.08 energy_conversion=0.07 biomineralization=0.05 rule_rewriting=0.06 closed_loop_learning=0.06 generativity=0.04 accessibility=0.02 testability=0.02 low_hazard=0.02
CATALYST transformation=0.32 energy_conversion=0.17 purification=0.13 durability=0.09 bio_safety=0.07 testability=0.06 structure_strength=0.04 accessibility=0.03 low_hazard=0.04 generativity=0.03 feedback_gain=0.02
PURIFIER purification=0.34 transformation=0.14 durability=0.10 bio_safety=0.10 structure_strength=0.08 testability=0.06 accessibility=0.05 low_hazard=0.04 self_healing=0.03 energy_conversion=0.02 closed_loop_learning=0.04
HEALER self_healing=0.31 bio_safety=0.17 durability=0.11 structure_strength=0.10 purification=0.07 biomineralization=0.07 testability=0.05 accessibility=0.04 closed_loop_learning=0.04 low_hazard=0.02 feedback_gain=0.02
STONE structure_strength=0.25 durability=0.20 purification=0.10 transformation=0.08 bio_safety=0.07 low_hazard=0.06 testability=0.05 accessibility=0.04 biomineralization=0.05 self_healing=0.03 world_modeling=0.04 rule_rewriting=0.03
LIFE bio_safety=0.22 self_healing=0.17 biomineralization=0.14 purification=0.10 durability=0.08 structure_strength=0.07 transformation=0.05 testability=0.04 closed_loop_learning=0.05 feedback_gain=0.04 accessibility=0.03 low_hazard=0.01
ENERGY energy_conversion=0.32 transformation=0.20 durability=0.09 purification=0.08 structure_strength=0.06 testability=0.06 bio_safety=0.05 accessibility=0.04 generativity=0.04 feedback_gain=0.03 low_hazard=0.02 self_healing=0.01
BIOMINERAL biomineralization=0.28 structure_strength=0.15 durability=0.13 bio_safety=0.12 self_healing=0.08 purification=0.07 transformation=0.04 testability=0.03 world_modeling=0.04 closed_loop_learning=0.03 accessibility=0.02 low_hazard=0.01
LOWHAZARD low_hazard=0.20 bio_safety=0.17 accessibility=0.11 testability=0.10 purification=0.09 durability=0.08 structure_strength=0.06 self_healing=0.05 closed_loop_learning=0.05 world_modeling=0.04 transformation=0.03 biomineralization=0.02
CANVAS noise_removal=0.18 surface_readiness=0.17 signal_clarity=0.15 safe_containment=0.14 scene_preparation=0.14 creative_potential=0.09 purification=0.05 durability=0.03 low_hazard=0.03 testability=0.02
STAGEKEEPER safe_containment=0.20 scene_preparation=0.18 surface_readiness=0.14 signal_clarity=0.12 noise_removal=0.12 durability=0.08 low_hazard=0.07 testability=0.04 creative_potential=0.03 closed_loop_learning=0.02
DEMIURGE rule_rewriting=0.18 closed_loop_learning=0.17 generativity=0.15 programmability=0.13 world_modeling=0.12 agency=0.10 feedback_gain=0.08 autocatalysis=0.05 testability=0.02
WORLD_REWRITER rule_rewriting=0.25 agency=0.15 world_modeling=0.15 generativity=0.13 closed_loop_learning=0.12 programmability=0.10 feedback_gain=0.06 autocatalysis=0.03 testability=0.01
"""

# Terms that reject a mixture.
BANNED = """
MERCURY
QUICKSILVER
LEAD
ARSENIC
CADMIUM
THALLIUM
URANIUM
PLUTONIUM
AQUA_REGIA
AQUA_FORTIS
CYANIDE
DICHROMATE
CHROMATE
PERCHLORATE
AZIDE
HYDROFLUORIC_ACID
CONCENTRATED_NITRIC_ACID
PHOSGENE
MUSTARD
TOXIC_GAS
EXPLOSIVE
ENERGETIC_MATERIAL
RADIOACTIVE_SOURCE
AMALGAM
DIMETHYLMERCURY
PIRANHA_SOLUTION
WHITE_PHOSPHORUS
CHLORINE_GAS
FLUORINE_GAS
"""

# What each profile stands for.
DESCRIPTIONS = """
UNIVERSAL: balanced modern philosopher-stone analogue
CATALYST: stone as transformer: catalysis/resource conversion
PURIFIER: stone as purifier: adsorption/separation/detox
HEALER: stone as healer: self-repair/damage recovery/biocompatibility
STONE: stone as body: durable structured matter
LIFE: stone as life-compatible matter: biological interface
ENERGY: stone as spiritus: light/charge/energy conversion
BIOMINERAL: stone grown from life: biomineral/living fabrication
LOWHAZARD: stone as safe path: non-toxic, accessible, testable
CANVAS: stone as clean canvas: purified surface and low-noise field where new order can appear
STAGEKEEPER: stone as stagekeeper: safe containment and stable scene preparation
DEMIURGE: stone as engine: self-improving discovery loop that changes the search space
WORLD_REWRITER: stone as world-rewriter: rule-editing generative system, not a passive material
"""

# How a review request words each profile, and any other.
INTERPRETATIONS = """
UNIVERSAL: balanced map of many functions
CATALYST: modern transmutation as catalysis/resource conversion, not magical metal transmutation
PURIFIER: matter purification through adsorption/separation/detox
HEALER: repair through self-healing, damage recovery, biocompatible restoration
STONE: corpus: stable durable structured matter
LIFE: anima: life-compatible interface and biological fabrication
ENERGY: spiritus: light/charge/energy conversion
BIOMINERAL: living stone: biomineralization and biological mineral architecture
LOWHAZARD: safe path: accessible, non-toxic, testable candidate space
CANVAS: clean canvas: purified, low-noise surface where a new game can appear
STAGEKEEPER: stagekeeper: safe, stable, reproducible scene preparation
DEMIURGE: discovery engine: closed-loop transformer/search/review system
WORLD_REWRITER: rule editor: system that changes the search space itself
"""
INTERPRETATION = "modern research vector"

# Labels (roles or families) whose shares add up to a phase; an ingredient counts once for each label it has.
PHASES = """
matrix: matrix binder hydrogel crosslinker adhesion weak_acid plasticizer
mineral: mineral biomineral platelet
sorbent: sorbent carbon
catalyst: catalyst photocatalyst redox_catalyst biocatalyst catalyst_support enzyme
energy: energy conductive_polymer advanced
bio_process: bio_process
engine: meta_engine
memory: memory
generator: engine interpreter
rule_editor: rule_editor
closed_loop: closed_loop optimizer
safety_gate: safety_gate
canvas: canvas_layer
surface: surface clarity_gate
containment: containment stage_protocol
scene_protocol: stage_protocol memory_field creative_seed
"""

# By how much a profile prefers a family or a role in draws (1 where none is given).
BIASES = """
CATALYST photocatalyst=3.2 oxide=2.6 enzyme=2.2 catalyst=2.4 biocatalyst=2.2 carbon=1.4
PURIFIER carbon=3.2 sorbent=3.2 mineral=2.1 biopolymer=1.3
HEALER biopolymer=3.0 polymer=2.3 hydrogel=2.5 bioactive=2.0 bioinspired=2.0 binder=2.0
STONE mineral=3.0 biomineral=2.8 biopolymer=1.6 carbon=1.4 matrix=1.7
LIFE biopolymer=2.6 bio_process=2.8 enzyme=2.0 biomineral=1.8 bioactive=1.6
ENERGY conductive_polymer=3.2 photocatalyst=2.8 oxide=2.2 carbon=2.3 energy=2.8
BIOMINERAL biomineral=3.5 bio_process=3.2 mineral=2.0 biopolymer=1.8
LOWHAZARD biopolymer=2.5 mineral=1.8 biomineral=1.8 enzyme=1.4 modifier=1.5
CANVAS canvas_layer=4.0 surface=3.2 clarity_gate=3.2 containment=3.4 stage_protocol=3.4 memory_field=2.4 creative_seed=2.5 sorbent=2.0 mineral=1.6 biopolymer=1.4
STAGEKEEPER canvas_layer=4.0 surface=3.2 clarity_gate=3.2 containment=4.5 stage_protocol=4.0 memory_field=2.4 creative_seed=2.5 sorbent=2.0 mineral=1.6 biopolymer=1.4 safety_gate=2.4
DEMIURGE meta_engine=4.0 engine=3.0 optimizer=3.0 closed_loop=3.4 memory=2.7 rule_editor=3.5 world_model=3.0 safety_gate=2.6 publication=2.0 interpreter=2.6
WORLD_REWRITER meta_engine=4.0 engine=3.2 optimizer=3.0 closed_loop=3.4 memory=2.7 rule_editor=4.5 world_model=3.6 safety_gate=2.6 publication=2.0 interpreter=3.4
"""

#: What a mixture without a valid component becomes, and the profile whose weights hold for unknown ones.
DEFAULT_CODE, DEFAULT_PROFILE = "BACTERIAL_CELLULOSE_MATRIX", "UNIVERSAL"


def ingredients() -> list[dict]:
    rows = [line.split() for line in INGREDIENTS.split("\n") if line]
    return [dict(zip(["code", "family", "role"], r[:3], strict=True)) | {p: float(x) for p, x in zip(PROPERTIES, r[3:], strict=True)} for r in rows]


def targets() -> dict[str, dict[str, float]]:
    lines = (line.split() for line in TARGETS.split("\n") if line)
    return {name: {k: float(v) for k, v in (w.split("=") for w in weights)} for name, *weights in lines}


def phases() -> dict[str, list[str]]:
    return {name: labels.split() for name, labels in (line.split(": ") for line in PHASES.split("\n") if line)}


def biases() -> dict[str, dict[str, float]]:
    lines = (line.split() for line in BIASES.split("\n") if line)
    return {name: {k: float(v) for k, v in (w.split("=") for w in own)} for name, *own in lines}


def banned() -> list[str]:
    return sorted(BANNED.split())


def descriptions() -> dict[str, str]:
    return dict(line.split(": ", 1) for line in DESCRIPTIONS.split("\n") if line)


def interpretations() -> dict[str, str]:
    return dict(line.split(": ", 1) for line in INTERPRETATIONS.split("\n") if line)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan: no job reads them, and the optimizer knows their size."""

    def text(x) -> str:
        return "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)

    columns = [c.strip().split(" ") for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({c} AS {kind}) AS {c}' for c, kind in columns)} FROM VALUES {values} AS t({', '.join(c for c, _ in columns)})")


def catalog(spark: SparkSession) -> DataFrame:
    """position, code, family, role and the properties of the shipped ingredients; any table with these columns can take its place."""
    schema = "position int, code string, family string, role string, " + ", ".join(f"{p} double" for p in PROPERTIES)
    return local(spark, [(k, *r.values()) for k, r in enumerate(ingredients())], schema)


def target_weights(spark: SparkSession) -> DataFrame:
    """(ordinal, archetype, feature, weight), long form."""
    rows = [(k, a, f, w) for k, (a, own) in enumerate(targets().items()) for f, w in own.items()]
    return local(spark, rows, "ordinal int, archetype string, feature string, weight double")


def profiles(spark: SparkSession) -> DataFrame:
    """A row for each profile: ordinal, archetype, description and a weight column w_FEATURE for each feature."""
    text = descriptions()
    rows = [(k, a, text.get(a, ""), *(own.get(f, 0.0) for f in FEATURES)) for k, (a, own) in enumerate(targets().items())]
    return local(spark, rows, "ordinal int, archetype string, description string, " + ", ".join(f"w_{f} double" for f in FEATURES))
