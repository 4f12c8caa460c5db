"""Helpers that the text operators share: scratch tables, splits, hashing and checked broadcasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.files import scratch, written

__all__ = ["BROADCAST_ROWS", "hashed", "mix", "partitions", "read", "remainder", "scratch", "shingles", "small_side", "unique_sorted", "unused", "whole_numbers", "written"]

#: Largest number of rows of 8 to 40 bytes that a join side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return files.small_side(df, most)


def unused(name: str, columns: list[str]) -> str:
    """The name, changed until no column has it (case doesn't count)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def remainder(col: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; -1 for null."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % divisor, F.lit(-1))


def whole_numbers(rows: DataFrame, *keep: str | Column, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """keep and x: the vector's entries times scale, rounded down (beyond 64 bits: the nearest such number). Rows go whose vector is null or has null or non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~odd).select(*keep, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(words: list) -> np.ndarray:
    """64-bit hashes of str or bytes values."""
    if not words:
        return np.zeros(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def unique_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate(([True], new))]


def shingles(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of `size` lower-cased words (one run if it has fewer; none if it has no word)."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    h = hashed([w for s in split for w in s])
    out, at = [], 0
    for n in counts:
        own = h[at : at + n]
        at += n
        m = max(1, n - size + 1) if n else 0
        x = np.full(m, np.uint64(min(n, size)))
        for k in range(min(n, size)):
            x = mix(x ^ own[k : k + m])
        out.append(unique_sorted(x))
    return out
