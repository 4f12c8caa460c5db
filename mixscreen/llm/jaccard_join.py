"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shingles, small_side, written
from .minhash import TOLERANCE, band_keys, chained, members, minima, shared, tiles, verified
from .unionfind import components

#: Words in an n-gram; Jaccard similarity of a link; bands and rows of the candidate search: a pair at the threshold is missed with probability (1 - 0.8^5)^20 < 0.0004.
WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5


def _keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys of sets, none of them empty."""
    return band_keys(minima(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])]), bands * rows), bands, rows)


def _signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = shingles(part.column(1).to_pylist(), words)
                full = np.array([len(s) > 0 for s in sets], bool)
                keys = np.zeros((len(sets), bands), np.uint64)
                if full.any():
                    keys[full] = _keys([s for s in sets if len(s)], bands, rows)
                offsets = pa.array(np.arange(len(sets) + 1) * bands, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(full), lists], ["digest", "full", "bands"])

    return run


def _sets(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = shingles(part.column(1).to_pylist(), words)
                keys = _keys(sets, bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sets, keys))], ["id", "item", "keys"])

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, whole: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(members, links).

    members: doc_id, text_class (smallest doc_id of the same text), class_id (smallest doc_id that chains of links
    lead to), n_links (links of its text), digest (SHA-256 of the text), root (a number of the class, also where ids are null), for each row of docs. links: a, b, similarity; pairs of text classes whose sets of `words`-word n-grams
    (lower-cased, between white space) have a Jaccard similarity of at least `threshold`, each once; copies of a text are
    not expanded. A group of k texts that are all similar has k(k-1)/2 links: they are all verified, counted where
    they are found, and only become rows where `links` is used. Without `whole`, for callers that need classes alone, links (then None) are looked for
    only between ids that aren't in one class yet, and there is no n_links.

    Null counts as empty. Texts without a word have no n-gram and link to nothing, but equal ones are one text class.
    A text with fewer words has one n-gram. Rows with a null doc_id have the classes of their text, which are null if
    no row of the text, or of its class, has a doc_id. Rows that repeat share their classes. Other columns don't matter.
    Texts are told apart by SHA-256 and numbered by its first 64 bits, so results don't depend on partitions.

    Texts that share a band key of their MinHash values meet in tiles of bounded size. There, values are compared
    STEP at a time, and a pair goes when the posterior probability that it reaches the threshold falls below the
    tolerance; what is left is verified on the whole sets. A copy never meets its copies: texts are merged first.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", digest)
    number = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    narrow = written(texts.select("doc_id", "digest"))
    once = written(narrow.groupBy("digest").agg(F.min("doc_id").alias("text_class")).withColumn("id", number))
    signed = texts.select("digest", "text").mapInArrow(_signed(words, bands, rows), "digest binary, full boolean, bands array<long>").where("full")
    found = shared(signed.groupBy("digest").agg(F.first("bands").alias("bands")).select(number.alias("id"), "bands"))

    def items(ids: DataFrame) -> DataFrame:
        needed = once.join(ids, "id", "left_semi").select("id", F.col("digest").alias("d"), "text_class")
        own = texts.join(small_side(written(needed)), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("text_class")))
        return own.select("id", "text").mapInArrow(_sets(words, bands, rows), "id long, item binary, keys binary").dropDuplicates(["id"])

    links, counts = None, None
    if whole:
        met = written(tiles(members(found)))
        own = items(met.select("id").distinct())
        tallied = written(verified(met, own, threshold, tolerance=tolerance, mode="counts"))
        roots = components(tallied.where("b is not null"))
        counts = tallied.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
        named = once.select("id", "text_class")
        links = verified(met, own, threshold, tolerance=tolerance).join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
        links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    else:
        roots = chained(found, items, threshold, tolerance=tolerance)
    rooted = once.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if counts is not None:
        rooted = rooted.join(counts, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    rooted = written(rooted)
    least = written(rooted.groupBy("root").agg(F.min("text_class").alias("class_id")))
    classes = rooted.join(least, "root").drop("id")
    return narrow.join(classes, "digest", "left"), links


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class, its text's representative, and the number of links that its text has to other texts."""
    found, _ = jaccard_join(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "text_class", "n_links")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
#: All pairs of texts that share an n-gram. (The candidate search misses a pair at the threshold with probability under 0.0004: none in the test tables.)
ORACLE = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE t AS (
            SELECT min(doc_id) AS text_class, coalesce(text, '') AS body, string_split_regex(trim(lower(coalesce(text, '')), E' \t\n\r\f\v'), '\s+') AS w FROM documents GROUP BY ALL
        ), g AS (
            SELECT DISTINCT text_class, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM t WHERE w <> ['']
        ), n AS (
            SELECT text_class, count(*) AS n FROM g GROUP BY text_class
        ), c AS (
            SELECT x.text_class AS a, y.text_class AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.text_class <> y.text_class GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN n m ON m.text_class = a JOIN n o ON o.text_class = b WHERE k >= 0.8 * (m.n + o.n - k) - 1e-9
        ), reach AS (
            SELECT text_class AS a, text_class AS b FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
        ), cls AS (
            SELECT a AS text_class, min(b) AS class_id FROM reach GROUP BY a
        ), deg AS (
            SELECT a AS text_class, count(*) AS n_links FROM l GROUP BY a
        )
        SELECT doc_id, class_id, text_class, coalesce(n_links, 0) AS n_links
        FROM documents d JOIN t ON t.body = coalesce(d.text, '') JOIN cls USING (text_class) LEFT JOIN deg USING (text_class)
    """
}
