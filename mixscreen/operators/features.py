"""Wide rows: weighted properties, phase shares and interaction features of each mixture.

A mixture is a row with parts (array of code, frac and at, its ingredient's place in the book): all its averages and
shares are one vector, the sum of its ingredients' vectors by share, so the plan stays small whatever their number.
Formulas are SQL text over named columns.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clipped
from ..sources.catalog import FEATURES, META, PROPERTIES, local, phases

#: Roles or families whose share is needed beside the phases.
ROLES = ["hydrogel", "binder", "adhesion", "plasticizer", "crosslinker", "biomineral", "engine", "world_model", "advanced"]
BALANCED = FEATURES[:8]
#: What the entries of an ingredient's vector are: properties, how many of a phase's labels it has, whether it has a role or family.
VECTOR = [*(f"w_{p}" for p in PROPERTIES), *(f"{p}_like" for p in phases()), *(f"s_{r}" for r in ROLES)]
#: Most ingredients of a catalog: their vectors are literals of the plan.
MOST_CODES = 5000


class Book:
    """A catalog's codes, in order, and their vectors."""

    def __init__(self, catalog: DataFrame) -> None:
        rows = catalog.select("code", "family", "role", *PROPERTIES).limit(MOST_CODES + 1).collect()
        if len(rows) > MOST_CODES:
            raise ValueError(f"a catalog has at most {MOST_CODES} ingredients")
        rows.sort(key=lambda r: r.code)
        self.codes = [r.code for r in rows]
        if len(set(self.codes)) < len(self.codes):
            raise ValueError("a code is in the catalog twice")
        self.spark = catalog.sparkSession
        labels = phases().values()
        self.vectors = [[*((r[p] or 0.0) for p in PROPERTIES), *(float(sum(x in (r.role, r.family) for x in own)) for own in labels), *(float(x in (r.role, r.family)) for x in ROLES)] for r in rows]

    @classmethod
    def of(cls, spark: SparkSession, codes: list[str], vectors: list[list[float]]) -> Book:
        """The book of these codes, in order, and their vectors."""
        book = cls.__new__(cls)
        book.spark, book.codes, book.vectors = spark, codes, vectors
        return book

    def places(self) -> DataFrame:
        """(code, at)"""
        return local(self.spark, [(c, k) for k, c in enumerate(self.codes)], "code string, at int") if self.codes else self.spark.createDataFrame([], "code string, at int")

    def vector(self) -> Column:
        """The sum of the vectors of parts by their shares."""
        vectors = F.from_json(F.lit(json.dumps(self.vectors)), "array<array<double>>")
        add = lambda acc, p: F.zip_with(acc, F.get(vectors, p["at"]), lambda a, v: a + p["frac"] * v)
        return F.aggregate("parts", F.lit([0.0] * len(VECTOR)), add)


def measured(rows: DataFrame, book: Book) -> DataFrame:
    """rows with VECTOR, the largest share and the number of components over 0.008."""
    out = rows.withColumns({"__v": book.vector(), "max_share": F.expr("array_max(transform(parts, p -> p.frac))"), "n_components": F.expr("size(filter(parts, p -> p.frac > 0.008D))")})
    return out.selectExpr(*[c for c in out.columns if c != "__v"], *[f"__v[{k}] AS {c}" for k, c in enumerate(VECTOR)])


# What a feature gains from phases (by name) and role shares (s_ROLE).
GAINS = """
transformation: 0.18 * least(catalyst, matrix + mineral + sorbent) + 0.08 * least(bio_process, matrix)
purification: 0.20 * least(sorbent + mineral, matrix + catalyst + sorbent)
self_healing: 0.20 * least(s_hydrogel + s_binder + s_adhesion + s_plasticizer, matrix + bio_process)
structure_strength: 0.20 * least(matrix, mineral + sorbent) + 0.08 * least(s_crosslinker + s_adhesion, matrix)
durability: 0.16 * least(mineral + sorbent, matrix + catalyst) + if(array_contains(tags, 'LOW_HAZARD_GATE'), 0.05, 0.0)
energy_conversion: 0.18 * least(energy + catalyst, matrix + mineral + sorbent)
biomineralization: 0.25 * least(s_biomineral + bio_process, matrix + mineral)
rule_rewriting: 0.16 * least(rule_editor + generator, memory + closed_loop)
autocatalysis: 0.14 * least(closed_loop, engine)
closed_loop_learning: 0.18 * least(memory + closed_loop, safety_gate + engine)
generativity: 0.18 * least(generator + s_engine, engine)
programmability: 0.10 * least(rule_editor + engine, memory + closed_loop)
world_modeling: 0.14 * least(s_world_model + memory, closed_loop + engine)
agency: 0.12 * least(rule_editor + closed_loop, safety_gate + engine)
feedback_gain: 0.18 * least(closed_loop + safety_gate, memory + engine)
noise_removal: 0.16 * least(sorbent + surface + canvas, containment + matrix + engine)
surface_readiness: 0.18 * least(surface + canvas, containment + scene_protocol + matrix)
signal_clarity: 0.16 * least(surface + memory + canvas, scene_protocol)
safe_containment: 0.18 * least(containment + safety_gate + canvas, matrix + engine + scene_protocol)
scene_preparation: 0.20 * least(canvas + scene_protocol + matrix, sorbent + engine + containment)
creative_potential: 0.16 * least(canvas + generator + scene_protocol, surface + closed_loop)
"""
#: How much of its group's evenness bonus a feature gets.
BONUS = {"transformation": 1.0, "purification": 0.5, "self_healing": 0.5, "structure_strength": 0.4, "durability": 0.4, "energy_conversion": 0.5, "biomineralization": 0.5}
META_BONUS = {"rule_rewriting": 1.0, "autocatalysis": 0.5, "closed_loop_learning": 0.7, "generativity": 0.7, "programmability": 0.5, "world_modeling": 0.6, "agency": 0.5, "feedback_gain": 0.7}


def raw() -> dict[str, str]:
    """SQL of each feature before its bonus: the weighted average and what it gains."""
    gains = dict(line.split(": ", 1) for line in GAINS.split("\n") if line)
    named = {f: re.sub(r"\b(" + "|".join(phases()) + r")\b", r"\1_like", g) for f, g in gains.items()}
    return {f: f"w_{f} + {named[f]}" if f in named else f"w_{f}" for f in FEATURES}


def even(array: str, least: float, spread: float) -> str:
    """SQL of the evenness bonus of an array: least times its smallest value, and spread times 1 less its standard deviation."""
    squares = f"aggregate({array}, 0D, (a, x) -> a + (x - {array}_mean) * (x - {array}_mean)) / size({array})"
    return f"{least} * array_min({array}) + {spread} * (1 - sqrt({squares}))"


def features(wide: DataFrame) -> DataFrame:
    """Rows of measured() that have tags, with the 25 features in place of averages and role shares; even mixtures get a bonus. w_density stays."""
    own, rest = raw(), [c for c in wide.columns if c not in VECTOR or c == "w_density" or c.endswith("_like")]
    clip = lambda group: f"array({', '.join(clipped(own[f]) for f in group)})"
    mean = lambda array: f"aggregate({array}, 0D, (a, x) -> a + x) / size({array}) AS {array}_mean"
    out = wide.selectExpr(*rest, *[f"{own[f]} AS __{f}" for f in FEATURES], f"{clip(BALANCED)} AS __own", f"{clip(META)} AS __meta")
    out = out.selectExpr("*", mean("__own"), mean("__meta"))
    out = out.selectExpr(*rest, *[f"__{f}" for f in FEATURES], f"{even('__own', 0.05, 0.03)} AS __u", f"{even('__meta', 0.06, 0.035)} AS __d")
    bonus = {f: f"__u * {b}" for f, b in BONUS.items()} | {f: f"__d * {b}" for f, b in META_BONUS.items()}
    return out.selectExpr(*rest, *[clipped(f"__{f} + {bonus[f]}" if f in bonus else f"__{f}") + f" AS {f}" for f in FEATURES])


def restored(rows: DataFrame, book: Book) -> DataFrame:
    """rows (components, tags) with the features they lack, phase shares and w_density, computed again from components, which make the same values but for the order of sums."""
    kept = {f: f"__kept_{f}" for f in FEATURES if f in rows.columns}
    codes = json.dumps(book.codes).replace("\\", "\\\\").replace("'", "\\'")
    parts = f"transform(map_entries(components), e -> struct(e.value AS frac, CAST(array_position(from_json('{codes}', 'array<string>'), e.key) - 1 AS int) AS at)) AS parts"
    wide = measured(rows.withColumnsRenamed(kept).selectExpr("*", parts), book)
    out = features(wide.drop("parts", "max_share", "n_components")).drop(*kept)
    return out.withColumnsRenamed({name: f for f, name in kept.items()})
