"""Best rows by group, without shuffling all rows by profile: partial aggregates and group limits come first. Ties go to the smaller hash16, then candidate_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(score: str):
    return F.struct((-F.col(score)).alias("n"), "hash16", "candidate_id")


def best_by(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The best row of each key. candidate_id tells rows apart: keys are reduced to the best one's first, and only it is looked up again (rows should be cheap to read twice, such as a written table)."""
    best = rows.groupBy(*keys).agg(F.min(_order(score)).alias("b")).select(F.col("b.candidate_id").alias("candidate_id"))
    return rows.join(best, "candidate_id", "left_semi")


def dedup_diverse(rows: DataFrame) -> DataFrame:
    """The best positive row for each archetype, coarse key and signature."""
    return best_by(rows.where("score > 0"), ["archetype", "coarse_key", "signature"])


def leaders(rows: DataFrame, n: int) -> DataFrame:
    """candidate_id of the best row of each archetype and of its n best diverse ones: champions, dedup_diverse and top up to n of these rows alone are those of all. Only keys, scores and hashes are dealt out."""
    first = rows.groupBy("archetype").agg(F.min(_order("score")).alias("b")).select("b.candidate_id")
    best = rows.where("score > 0").groupBy("archetype", "coarse_key", "signature").agg(F.min(_order("score")).alias("b"))
    best = top(best.select("archetype", (-F.col("b.n")).alias("score"), "b.hash16", "b.candidate_id"), n)
    return first.unionByName(best.select("candidate_id")).distinct()


def top(rows: DataFrame, n: int, by: str = "archetype", score: str = "score") -> DataFrame:
    """The n best rows of each value of `by`, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "hash16", "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
