"""Exact dedup with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

#: Counters of a Misra-Gries summary: digests with over 2/(COUNTERS+1) of all rows are found for certain.
COUNTERS = 1024


def _summaries(counters: int):
    """Misra-Gries summaries of digests, one for each partition; the row with a null digest holds its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            n += batch.num_rows
            found = pc.value_counts(batch.column(0))
            for x, k in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                held[x] = held.get(x, 0) + k
            if len(held) > counters:  # the merge rule of mergeable summaries: take away the (counters+1)-th largest count
                cut = int(np.partition(np.fromiter(held.values(), np.int64), -counters - 1)[-counters - 1])
                held = {x: k - cut for x, k in held.items() if k > cut}
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.binary()), pa.array([n, *held.values()], pa.int64())], ["digest", "n"])

    return run


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest) of at most `counters` digests, among them each with over 2/(counters+1) of the rows."""
    found = written(rows.select("digest").mapInArrow(_summaries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")))
    total = found.where("digest is null").agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("digest").isNotNull() & (F.col("n") > total / (counters + 1))).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): each row of docs with the row of equal text that stays.

    The row with the largest doc_id stays. Texts are compared as they are; null counts as empty, and so empty texts
    form one group. Rows that repeat a doc_id with the same text share their decision. Null doc_ids lose to any
    other; a group of null ids alone keeps them all. Other columns of docs don't matter. No rows give no rows.

    Frequent digests (Misra-Gries candidates, then counted exactly by a map-side aggregate) never get shuffled by
    row: their winners, at most `counters` rows, are broadcast. Only the other rows, of which no digest has more
    than 2/(counters+1), are dealt out by digest.
    """
    rows = written(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")))
    heavy = F.broadcast(heavy_hitters(rows, counters))
    best = rows.join(heavy, "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    marked = rows.join(F.broadcast(best), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where("group_size is null").select("digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
    out = marked.where("group_size is not null").select("digest", "doc_id", "keep_id", "group_size").unionAll(rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
}
