"""A training corpus from `documents`: rejects toxic texts, drops copied lines and near copies, mixes sources, packs tokens.

STAGES names the stages; each function takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscreen.llm.common import partitions, read, remainder, small_side, unused, written
from mixscreen.llm.jaccard_join import jaccard_join
from mixscreen.llm.line_dedup import line_dedup
from mixscreen.llm.mixing import WEIGHTS, mix_sources
from mixscreen.llm.packing import pack
from mixscreen.llm.toxicity import THRESHOLD, score_toxicity, train


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is under the threshold; the classifier learns from the labels that op9 learns from."""
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 3) != 1))
    score = unused("toxicity", docs.columns)
    return score_toxicity(docs, model, into=score).where(F.col(score) < THRESHOLD).drop(score)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that copy an earlier line; n_chars follows where lines went. No document goes: one without lines left has an empty text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("removed_lines").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest doc_id (null ids last), then digest of the text.

    A row is its doc_id and text, so a clean text stays whatever other rows have its doc_id. Of rows that repeat both,
    that with the smallest other columns stays.
    """
    members, _ = jaccard_join(docs, whole=False)
    # written before it is grouped: the join by digest can then be split where many rows have one text
    rows = written(written(members.select("root", "doc_id", "digest")).groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    firsts = rows.groupBy("root").agg(first.alias("first"), F.count("*").alias("k")).where("k > 1").select("root", "first")
    gone = rows.join(small_side(written(firsts), 500_000), "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))))
    i, g, d = (unused(x, docs.columns) for x in ("id_", "gone_", "digest_"))
    gone = written(gone.select(F.col("doc_id").alias(i), F.col("digest").alias(g)))

    own = docs.withColumn(d, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(d) == F.col(g))
    left = own.join(gone.hint("shuffle_hash"), same, "left_anti")
    twice = written(rows.where("n > 1").select(F.col("doc_id").alias(i), F.col("digest").alias(g)))
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    twice = small_side(twice, 500_000)
    one = left.join(twice, same, "left_semi").groupBy("doc_id", d).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(twice, same, "left_anti").select(*docs.columns).unionAll(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of the sources' target weights: files, and rows in them, follow each other in that order."""
    out = mix_sources(docs, WEIGHTS)
    return out.repartitionByRange(partitions(spark), "mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def in_file_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, read from Parquet files, with __order: the row's number by the number of the task that wrote its file, then by its place in the file. Spark reads files in another order."""
    path = F.col("_metadata.file_path")
    sizes = docs.groupBy(path.alias("path")).count().collect()
    sizes.sort(key=lambda r: (int(m[1]) if (m := re.search(r"part-(\d+)[^/]*$", r["path"])) else -1, r["path"]))
    starts = list(accumulate((r["count"] for r in sizes), initial=0))
    table = spark.createDataFrame([(r["path"], n) for r, n in zip(sizes, starts[:-1], strict=True)], "__path string, __start long")
    placed = docs.select("doc_id", "text", path.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(F.broadcast(table), F.col("__file") == F.col("__path")).withColumn("__order", F.col("__start") + F.col("__row"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit) and a checksum of these. Sequence ids follow the order of the mix."""
    return pack(in_file_order(spark, docs), order=F.col("__order")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_copied_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("pfair_mix", mix),
    ("packing", pack_tokens),
]

#: A classifier, fuzzy matching and a tokenizer can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
