"""All queries of the library but those of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import oracle
from .plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
