"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, hard_negatives, jaccard_join, language_id, language_model, line_dedup, media, mixing, packing, toxicity, warc, whitening

MODULES = (mixing, jaccard_join, language_model, warc, language_id, media, line_dedup, exact_dedup, toxicity, packing, whitening, byte_bpe, hard_negatives)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
