"""Mixtures: normalised shares, packed or in long form, and keys made of them.

Lines: candidate_id, code, amount. Headers: candidate_id, archetype, source, tags (array<string>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import DEFAULT_CODE
from .features import Book
from .screen import first_term

#: The classes of a diversity signature; the first of equal ones wins.
DOMINANT = ["matrix", "mineral", "sorbent", "catalyst", "energy", "bio_process", "engine", "closed_loop"]


def packed(header: DataFrame, lines: DataFrame, book: Book, default: str = DEFAULT_CODE, dealt: bool = False) -> DataFrame:
    """header with parts (array of code, frac and at) and code_term, the first banned term in its raw codes.

    Unknown codes and amounts that aren't positive count for terms alone; the rest adds up to 1, and a mixture left
    empty is the default ingredient. Lines are dealt out once, by candidate_id, unless they are dealt out so already
    (a table bucketed by it, or repartitioned); header and lines are then read once and joined without another exchange.
    """
    if default not in book.codes:
        raise ValueError(f"{default} is not in the catalog")
    own = lines if dealt else lines.repartition("candidate_id")
    places = book.places().withColumn("term", first_term(F.col("code")))
    # a book has MOST_CODES codes at most
    term = F.when(F.col("at").isNull(), first_term(F.col("code"))).otherwise(F.col("term"))
    own = own.join(F.broadcast(places), "code", "left").select("candidate_id", F.expr("if(at IS NULL, NULL, code) AS code"), "at", term.alias("term"), "amount")
    merged = own.groupBy("candidate_id", "code", "at", "term").agg(F.expr("sum(if(amount > 0, amount, NULL)) AS amount"))
    counted = F.col("at").isNotNull() & F.col("amount").isNotNull()
    lists = merged.groupBy("candidate_id").agg(F.collect_list(F.when(counted, F.struct("code", "amount", "at"))).alias("own"), F.sum(F.when(counted, F.col("amount"))).alias("total"), F.min("term").alias("code_term"))
    filled = f"if(size(own) > 0, transform(own, p -> struct(p.code AS code, p.amount / total AS frac, p.at AS at)), array(struct({default!r} AS code, 1D AS frac, {book.codes.index(default)} AS at))) AS parts"
    return header.join(lists, "candidate_id", "left").selectExpr(*header.columns, filled, "code_term")


def normalize(header: DataFrame, lines: DataFrame, catalog: DataFrame, default: str = DEFAULT_CODE) -> DataFrame:
    """(candidate_id, code, frac) of packed()."""
    return packed(header, lines, Book(catalog), default).select("candidate_id", F.inline("parts")).drop("at")


def keys(header: DataFrame, shares: DataFrame, prefix: str = "") -> DataFrame:
    """candidate_id with fingerprint, hash16, formula, coarse_key, top1, top2, components: one aggregate by mixture."""
    own = shares.groupBy("candidate_id").agg(F.collect_list(F.struct("code", "frac")).alias("parts"))
    return with_keys(header.join(own, "candidate_id"), prefix).select("candidate_id", "archetype", *KEYS)


#: SQL of parts in falling order of their shares, and of keys made of these (__s) and of parts in the order of codes (__c).
BY_SHARE = "array_sort(transform(parts, x -> struct(-x.frac AS n, x.code AS code, x.frac AS frac))) AS __s"
SHOWN = [
    "array_join(transform(__s, x -> concat(x.code, '=', regexp_replace(format_number(x.frac * 100, 2), '0$', ''), '%')), '; ') AS formula",
    "array_join(transform(filter(__c, x -> x.frac > 0.055D), x -> x.code), '|') AS coarse_key",
]
KEYS = ["fingerprint", "hash16", "formula", "coarse_key", "top1", "top2", "components"]


def with_keys(rows: DataFrame, prefix: str = "") -> DataFrame:
    """rows (archetype, tags, parts: array of code and frac) with KEYS in place of parts.

    The fingerprint is the canonical text, with shares to six places; the prefix stands before the archetype's name
    in it. Formulas have per cent to two places, as short as they are. Ties of shares go to the code that sorts first.
    """
    rest = [c for c in rows.columns if c != "parts"]
    out = rows.selectExpr(*rest, BY_SHARE, "array_sort(transform(parts, x -> struct(x.code AS code, x.frac AS frac))) AS __c")
    text = "array_join(transform(__c, x -> concat(x.code, ':', format_number(x.frac, 6))), ' ')"
    tags = "array_join(array_sort(coalesce(tags, CAST(array() AS array<string>))), ' ')"
    out = out.withColumn("fingerprint", F.concat_ws(" ", F.concat(F.lit(prefix), "archetype"), F.expr(text), F.expr(tags)))
    return out.selectExpr(
        *rest, "fingerprint", "substring(sha2(fingerprint, 256), 1, 16) AS hash16",
        *SHOWN,
        "coalesce(get(__s, 0).code, 'NONE') AS top1", "coalesce(get(__s, 1).code, 'NONE') AS top2", "map_from_entries(__c) AS components",
    )


def with_shown(rows: DataFrame) -> DataFrame:
    """rows of with_keys() that have components, with formula and coarse_key again: the same values."""
    parts = rows.selectExpr("*", "transform(map_entries(components), e -> struct(e.key AS code, e.value AS frac)) AS parts")
    return parts.selectExpr(*rows.columns, BY_SHARE, "parts AS __c").selectExpr(*rows.columns, *SHOWN)


def signature(wide: DataFrame) -> DataFrame:
    """Adds dominant (the largest of the eight phases) and signature (top1, top2, dominant)."""
    like = f"array({', '.join(f'round({p}_like, 9)' for p in DOMINANT)})"
    names = f"array({', '.join(repr(p) for p in DOMINANT)})"
    out = wide.withColumn("dominant", F.expr(f"element_at({names}, CAST(array_position({like}, array_max({like})) AS int))"))
    return out.withColumn("signature", F.concat_ws("|", "top1", "top2", "dominant"))
