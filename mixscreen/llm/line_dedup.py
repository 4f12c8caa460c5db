"""Fuzzy line dedup by MinHash of character shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read, small_side, unique_sorted, unused, written
from .minhash import band_keys, binned, chained, filled, shared

#: Characters in a shingle; Jaccard similarity of copies; bands and rows: a pair at the threshold is missed with probability (1 - 0.8^4)^12 < 0.002.
SHINGLE, THRESHOLD, BANDS, ROWS = 7, 0.8, 12, 4
GAP = "\0" * SHINGLE
LAST = (1 << 63) - 1
#: Characters whose shingles are made together, in 8 bytes each.
TOGETHER = 1 << 14
ODD = np.uint64(0x9E3779B97F4A7C15)
SQUARE = np.uint64(pow(int(ODD), 2, 1 << 64))
#: What no plain line has, nor ends or begins with: in ASCII, and beyond.
UNPLAIN = ["  ", " \n", "\n ", *(x for x in map(chr, range(128)) if x.isspace() and x not in " \n")]
BEYOND = UNPLAIN + [x for x in map(chr, range(128, 0x3001)) if x.isspace()]
#: Values of lines hardly repeat: dictionaries would be built in vain.
PLAIN = {"parquet.enable.dictionary": "false"}
LINES = "digest binary, id long, line string, n int, places array<struct<doc:long,key:long,line:int>>, bands binary"


def plain(line: str) -> str:
    """What is compared: lower case, single spaces."""
    return " ".join(line.lower().split())


def plain_lines(text: str) -> list[str]:
    """plain() of each line."""
    low = text.lower()
    if low[:1] == " " or low[-1:] == " " or any(x in low for x in (UNPLAIN if low.isascii() else BEYOND)):
        return [" ".join(x.split()) for x in low.split("\n")]
    return low.split("\n")


def _runs(lines: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every few lines, as many as the processor's cache holds: (the first one's number, 64-bit hashes of the runs of SHINGLE characters that begin at each place of
    the lines, of which GAP follows each; each line's characters; its number of shingles, which begin with it: a shorter line is one)."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size == 0 or size < TOGETHER):
            size += len(lines[end])
            end += 1
        text = GAP.join(lines[at:end]) + GAP
        c = (np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.uint64)
        two = c[:-1] * ODD + c[1:]
        runs = two[:-4] * SQUARE + two[2:-2]
        runs = (runs * SQUARE + two[4:])[:-1] * ODD + c[6:]
        sizes = np.array([len(x) for x in lines[at:end]], np.int64)
        yield at, mix(runs), sizes, np.maximum(1, sizes - SHINGLE + 1)
        at = end


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    out = []
    for _, values, sizes, counts in _runs(lines):
        begins = np.cumsum(sizes + SHINGLE) - sizes - SHINGLE
        out += [unique_sorted(values[i:j]) for i, j in zip(begins.tolist(), (begins + counts).tolist(), strict=True)]
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys, a row for each line."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    for at, values, sizes, counts in _runs(lines):
        # runs that begin behind a line's last shingle go to a row of their own
        n = len(sizes)
        rows = np.repeat(np.stack((np.arange(n), np.full(n, n)), axis=1).ravel(), np.stack((counts, sizes + SHINGLE - counts), axis=1).ravel())
        values >>= np.uint64(32)
        out[at : at + n] = binned(values, rows[: len(values)], n + 1, BANDS * ROWS)[:n]
    return band_keys(filled(out), BANDS, ROWS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines of every few hundred documents: digest, number, text, occurrences (their number, and each in order), band keys."""
    place = pa.struct([("doc", pa.int64()), ("key", pa.int64()), ("line", pa.int32())])
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            every = [plain_lines(text) for text in part.column(2).to_pylist()]
            seen = {"": 0}
            which = np.array([seen.setdefault(p, len(seen)) for lines in every for p in lines])
            if len(seen) == 1:
                continue
            lines, sizes = list(seen)[1:], [len(x) for x in every]
            row = np.repeat(np.arange(len(every)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hold = which > 0
            which, row, at = which[hold] - 1, row[hold], at[hold]
            digests = [hashlib.blake2b(p.encode(), digest_size=16).digest() for p in lines]
            bands = pa.array(np.ascontiguousarray(signatures(lines)).view(f"V{8 * BANDS}").ravel().tolist(), pa.binary())
            doc, key = (part.column(k).to_numpy()[row] for k in range(2))
            found = np.stack((which, doc, key, at))[:, np.lexsort((at, key, doc, which))]
            found = found[:, np.append(True, (found[:, 1:] != found[:, :-1]).any(axis=0))]
            counts = np.bincount(found[0])
            places = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(found[1:], (pa.int64(), pa.int64(), pa.int32()), strict=True)], fields=list(place))
            places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), places)
            ids = pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), ids, pa.array(lines, pa.string()), pa.array(counts, pa.int32()), places, bands], ["digest", "id", "line", "n", "places", "bands"])


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without lines that copy another line, and with removed_lines (array<int>, numbers from 0; null if none).

    Lines are compared in lower case with single spaces, by the Jaccard similarity of their character 7-grams (a
    shorter line is one shingle). Lines that a chain of pairs with at least `threshold` joins are one component; of all its
    occurrences the first stays: that of the smallest doc_id, then of the smallest line number. Blank lines stay.
    Null texts stay null. Null doc_ids come last. Rows with null or repeated doc_ids are told apart by a hash of their
    text, and come in its order; only rows that repeat the doc_id and the text share their decisions. Columns of docs stay as they are (but for removed_lines).

    Each task merges equal lines before anything moves, and writes lines with their band keys; lines that share a key
    are compared with those that stand for the key's lines (see chained()), and components come from distributed
    union-find. Lines are numbered by 64 bits of their digest.
    """
    me = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(me.alias("doc"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lines = written(texts.mapInArrow(_signed, LINES), options=PLAIN)

    def items(ids: DataFrame) -> DataFrame:
        return lines.select("id", F.col("line").alias("item")).join(small_side(ids), "id", "left_semi").groupBy("id").agg(F.first("item").alias("item"))

    roots = chained(shared(lines.select("id", "bands")), items, threshold, line_sets, hashes=0, keep=True)
    # a component is named by its root, and else by the digest of its line
    named = lines.join(small_side(written(roots)), "id", "left")
    named = named.select(F.coalesce(F.col("root").cast("string").cast("binary"), F.col("digest")).alias("component"), "n", "places")
    # few components have copies: only their places are ordered
    copied = written(named.groupBy("component").agg(F.sum("n").alias("n")).where("n > 1").select("component"))
    copies = written(named.join(small_side(copied), "component", "left_semi").select("component", "places"))
    stays = written(copies.groupBy("component").agg(F.min(F.col("places")[0]).alias("stays")))
    gone = copies.join(small_side(stays), "component").select(F.explode("places").alias("p"), "stays").where("p != stays")
    d, k = unused("__doc", docs.columns), unused("__key", docs.columns)
    removed = gone.groupBy(F.col("p.doc").alias(d), F.col("p.key").alias(k)).agg(F.array_sort(F.collect_set("p.line")).alias("removed_lines"))
    out = docs.drop("removed_lines").join(removed.hint("shuffle_hash"), (me == F.col(d)) & (key == F.col(k)), "left").drop(d, k)
    left = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(removed_lines, i)), '\\n')")
    return out.withColumn("text", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(left))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    out = line_dedup(docs)
    removed = F.when(F.col("removed_lines").isNull(), 0).otherwise(F.size("removed_lines"))
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
#: All pairs of lines that share a shingle. (The candidate search misses a pair at the threshold with probability under 0.002: none in the test tables.)
ORACLE = {
    "op7_line_dedup": r"""
        WITH RECURSIVE u AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents
        ), p AS (
            SELECT *, array_to_string(string_split_regex(trim(lower(line), E' \t\n\r\f\v'), '\s+'), ' ') AS plain FROM u
        ), d AS (
            SELECT plain, row_number() OVER (ORDER BY plain) AS id FROM (SELECT DISTINCT plain FROM p WHERE plain <> '')
        ), g AS (
            SELECT DISTINCT id, unnest(list_transform(range(1, greatest(2, length(plain) - 5)), lambda i: substr(plain, i, 7))) AS gram FROM d
        ), n AS (
            SELECT id, count(*) AS n FROM g GROUP BY id
        ), c AS (
            SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL
        ), h AS (
            SELECT a, b FROM c JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE k >= 0.8 * (m.n + o.n - k) - 1e-9
        ), l AS (
            SELECT a, b FROM h UNION ALL SELECT b, a FROM h
        ), reach AS (
            SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
        ), r AS (
            SELECT id, least(id, coalesce(min(b), id)) AS root FROM d LEFT JOIN reach ON a = id GROUP BY id
        ), o AS (
            SELECT p.*, plain <> '' AND row_number() OVER (PARTITION BY CASE WHEN plain = '' THEN -1 ELSE root END ORDER BY doc_id, k) > 1 AS gone FROM p LEFT JOIN d USING (plain) LEFT JOIN r USING (id)
        ), t AS (
            SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS body FROM o GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, octet_length(encode(body)) AS kept_bytes, sha256(body) AS text_sha256 FROM t
    """
}
