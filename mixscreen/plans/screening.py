"""The whole screen: mixtures in, scored and gated rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import features, mixture, screen
from ..operators.features import Book
from ..sources.catalog import DEFAULT_CODE, FEATURES, catalog, phases, profiles
from ..sources.files import bucketed


def wide_rows(header: DataFrame, lines: DataFrame, cat: DataFrame, default: str = DEFAULT_CODE, dealt: bool = False) -> DataFrame:
    """header with averages, phase and role shares, KEYS and signature of each mixture, and code_term, the first banned term in its raw codes: see mixture.packed(). All but the packing is projections."""
    book = Book(cat)
    return mixture.signature(mixture.with_keys(features.measured(mixture.packed(header, lines, book, default, dealt), book)))


def found_term() -> Column:
    """The alphabetically first banned term in source, archetype, tags and raw codes (code_term)."""
    return F.expr("array_min(array_compact(array(__own, code_term)))")


def screened(header: DataFrame, lines: DataFrame, cat: DataFrame | None = None, targets: DataFrame | None = None, default: str = DEFAULT_CODE, dealt: bool = False) -> DataFrame:
    """A row for each mixture with its keys, features, phases, gate metrics, status and score.

    cat: another catalog of ingredients, with the columns of the shipped one; targets: other profiles, as profiles()
    has them; default: the ingredient that a mixture without any becomes.
    """
    spark = header.sparkSession
    wide = wide_rows(header, lines, catalog(spark) if cat is None else cat, default, dealt)
    keep = ["candidate_id", "archetype", "source", "tags", "hash16", "formula", "coarse_key", "signature", "components", "reject_reason", *FEATURES, "w_density", *[f"{p}_like" for p in phases()]]
    rows = features.features(rejected(wide)).select(*keep)
    rows = screen.score(rows, profiles(spark) if targets is None else targets)
    return screen.final_score(screen.gate_status(screen.gate_metrics(rows)))


def stored(header: DataFrame, lines: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """header and lines as tables bucketed by candidate_id, for screened(..., dealt=True): a screen of them, by any catalog and profiles, has no exchange.

    Equal codes of a mixture are added up on the way, before rows are dealt out, so that one mixture may have any share of all lines.
    """
    own = lines.groupBy("candidate_id", "code").agg(F.expr("sum(if(amount > 0, amount, NULL)) AS amount"))
    return bucketed(header, "candidate_id", buckets), bucketed(own, "candidate_id", buckets)


def rejected(wide: DataFrame) -> DataFrame:
    """wide_rows() with reject_reason."""
    own = screen.first_term(F.concat_ws(" ", "source", "archetype", F.array_join("tags", " ")))
    return wide.withColumn("__own", own).withColumn("reject_reason", screen.reject_reason(found_term())).drop("__own")


#: Columns of slim() that with_shown() and joint_metrics() make again of the others, those that restored() makes by the catalog, and of these the few that ledgers have.
DERIVED = ["formula", "coarse_key", *screen.JOINT]
LEDGER = ["creative_potential", "safe_containment", "signal_clarity"]
BY_CATALOG = [c for c in [*FEATURES, "w_density", *[f"{p}_like" for p in phases()]] if c not in LEDGER]


def narrow(rows: DataFrame, by_catalog: bool) -> DataFrame:
    """Rows of slim() without what widened() makes again; by_catalog: also by the catalog."""
    return rows.drop(*DERIVED, *(BY_CATALOG if by_catalog else []))


def widened(rows: DataFrame, book: Book | None) -> DataFrame:
    """Rows of narrow() with all columns of slim(): projections, of which Spark computes those that are used."""
    out = screen.joint_metrics(mixture.with_shown(rows))
    return slim(features.restored(out, book) if book else out)


def slim(rows: DataFrame) -> DataFrame:
    """What selections and reports need."""
    keep = ["candidate_id", "ordinal", "archetype", "description", "source", "tags", "score", "hash16", "formula", "coarse_key", "signature", "components", "reject_reason", *FEATURES, *screen.GATE, "gate_status", "gate_reason", "w_density", *[f"{p}_like" for p in phases()]]
    return rows.select(*keep)
