"""WARC archives, and their index merged from sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, scratch, small_side, written

#: Payloads of fewer bytes are stored again each time; records and, beyond the largest record's, bytes that a file has at most; bytes of a gzip member's content.
REVISIT_BYTES, FILE_RECORDS, FILE_BYTES, MEMBER_BYTES = 100, 2000, 1 << 29, (1 << 24) - 1
#: Entries of a run that are read at a time; runs that are merged at a time.
BLOCK, FAN = 512, 64
#: Entries that are sampled for each bound between two ranges of the index.
SAMPLED = 64
ENTRY = "url_key string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, offset long, length long, file string"
TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
NAMES = [x.strip().split(" ")[0] for x in ENTRY.split(",")]


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels in reverse, ")", then path and query; scheme, user, port, "www." and fragment don't count, nor does case."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(u, "^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1), "^www[.]", "")
    rest = F.regexp_replace(u, "^[a-z][a-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type and refers_to.

    The first of equal payloads (the smallest page_id) is the response; if several rows have that page_id, all of them are.
    Digests that occur more than once are counted by a map-side aggregate, and joined back by broadcast up to a
    checked size; beyond it both sides are read tables, whose hot keys adaptive execution splits.
    """
    p = pages.withColumn("payload", F.coalesce("html", F.lit(""))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    again = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("payload_digest"))
    seen = written(p.select(again.alias("again"), "page_id").where("again IS NOT NULL").groupBy("again").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("again", "first"))
    p = p.join(small_side(seen), F.col("payload_digest") == F.col("again"), "left").drop("again")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return p.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (header, block) as gzip members, each without its last byte, which is zero: the highest of its length, under 2^24."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            out = []
            for header, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = header.encode() + block.encode() + b"\r\n\r\n"
                members = [gzip.compress(raw[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(raw), MEMBER_BYTES)]
                out.append(b"".join(members)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of with_revisits(pages), and url and timestamp, into WARC files below path.

    A file is gzip members one after another, nothing between them, so that any gzip reader gives all records and a
    reader can begin with any of them. A record is a member; one over 16 MB is several. Files are written by Spark's text writer,
    with its commits: a line is a record's members but for their last byte, always zero, which is the line's end.
    A revisit has no block; its headers name the response's record and the payload's digest. Files have FILE_RECORDS
    records at most, and so few that they stay under FILE_BYTES, or one record.
    """
    crlf = F.lit("\r\n")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", crlf, F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: "), "timestamp", crlf,
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "), crlf, F.lit("WARC-Payload-Digest: sha256:"), "payload_digest", crlf, F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), crlf, F.lit("X-Url-Key: "), F.regexp_replace("url_key", "[\r\n]", " "), crlf,
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), crlf, crlf,
    )
    longest = pages.agg(F.max("payload_bytes")).first()[0] or 0
    members = pages.select(header.alias("header"), block.alias("block")).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 4096)))).text(path)


HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def records(data) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive's bytes: offset and length are those of its gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        out, size, m, head, end = [], 0, None, {}, at
        while m is None or size < m.end() + int(head["Content-Length"]) + 4:
            z = zlib.decompressobj(31)
            while not z.eof:
                if end >= len(view):
                    raise ValueError(f"the record at byte {at} has no end")
                out.append(z.decompress(view[end : end + 65_536]))
                size += len(out[-1])
                end = min(len(view), end + 65_536)
            end -= len(z.unused_data)
            if m is None:
                m = HEADER.match(b"".join(out))
                if not m:
                    raise ValueError(f"no WARC record at byte {at}")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in m[1].decode().split("\r\n")[:-1])
        raw = b"".join(out)
        if len(raw) != m.end() + int(head["Content-Length"]) + 4:
            raise ValueError(f"the record at byte {at} has another length than it names")
        yield head, raw[m.end() : -4], at, end - at
        at = end


def order(e: tuple) -> tuple:
    return e[0], e[1], (e[2] is not None, e[2] or 0)


def _number(x: str | None) -> int | None:
    digits = (x or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), TYPES, strict=True)], NAMES)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index entries of each file. Payload digests are taken again from the stored bytes."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            entries = []
            for head, block, offset, length in records(content.as_buffer()):
                kind = head["WARC-Type"]
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if kind == "response" and (digest, size) != (hashlib.sha256(block).hexdigest(), len(block)):
                    raise ValueError(f"{path}: the record at {offset} doesn't have the payload that it names")
                entries.append((head["X-Url-Key"], head["WARC-Date"], _number(head["WARC-Record-ID"]), kind, digest, size, _number(head.get("WARC-Refers-To")), offset, length, path.rpartition("/")[2]))
            if entries:
                yield _batch(entries)


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so an entry costs one match a level. A run may join at any time."""

    def __init__(self, runs: Iterable[Iterable[tuple]] = ()) -> None:
        self.sources: list = []
        self.build([iter(r) for r in runs])

    def build(self, more: list) -> None:
        live = [(s, e) for s, e in [*zip(self.sources, getattr(self, "heads", []), strict=False), *((s, next(s, None)) for s in more)] if e is not None]
        self.sources, self.heads = [s for s, _ in live], [e for _, e in live]
        self.k = k = max(1, 1 << (len(live) - 1).bit_length()) if live else 1
        self.heads += [None] * (k - len(live))
        self.keys = [None if e is None else (order(e), i) for i, e in enumerate(self.heads)]
        self.tree, level, node = [0] * k, list(range(k)), k // 2
        while len(level) > 1:
            winners = []
            for i in range(0, len(level), 2):
                won, lost = level[i : i + 2] if self.beats(level[i], level[i + 1]) else level[i : i + 2][::-1]
                self.tree[node + i // 2] = lost
                winners.append(won)
            level, node = winners, node // 2
        self.won = level[0]

    def add(self, run: Iterable[tuple]) -> None:
        self.build([iter(run)])

    def beats(self, a: int, b: int) -> bool:
        return self.keys[a] is not None and (self.keys[b] is None or self.keys[a] < self.keys[b])

    def head(self) -> tuple | None:
        """The smallest entry that is left."""
        return self.heads[self.won]

    def pop(self) -> tuple:
        won = self.won
        out = self.heads[won]
        self.heads[won] = e = next(self.sources[won], None)
        self.keys[won] = None if e is None else (order(e), won)
        at = (won + self.k) // 2
        while at:
            if self.beats(self.tree[at], won):
                self.tree[at], won = won, self.tree[at]
            at //= 2
        self.won = won
        return out


def merge(blocks: Iterable[tuple[tuple, Iterable[tuple]]]) -> Iterator[tuple]:
    """All entries in order, of blocks (first entry, sorted entries) that come in order of their first entries. Only blocks are open that overlap."""
    tree = LoserTree()
    for first, entries in blocks:
        while (e := tree.head()) is not None and order(e) < order(first):
            yield tree.pop()
        tree.add(entries)
    while tree.head() is not None:
        yield tree.pop()


BLOCKS = "range int, run int, url_key string, timestamp string, page_id long, entries binary"


def _packed(k: int, run: int, held: list[tuple]) -> pa.RecordBatch:
    """A block as a row of BLOCKS."""
    sink = pa.BufferOutputStream()
    own = _batch(held)
    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(own)
    columns = [[k], [run], [held[0][0]], [held[0][1]], [held[0][2]], [sink.getvalue().to_pybytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["range", "run", "url_key", "timestamp", "page_id", "entries"])


def _blocks(bounds):
    """Cuts a task's sorted entries, a run, into blocks of BLOCK entries at most, none across a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        own = TaskContext.get().partitionId()
        held: list[tuple] = []
        at = 0
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = bisect_right(bounds.value, order(e))
                if held and (k != at or len(held) == BLOCK):
                    yield _packed(at, own, held)
                    held = []
                held.append(e)
                at = k
        if held:
            yield _packed(at, own, held)

    return run


def _merged(last: bool):
    """Rows of BLOCKS, sorted by range, group of FAN runs and first entry, to the entries of each range and group in order; packed as blocks of a longer run, unless it is the last pass."""

    def opened(content: bytes) -> Iterator[tuple]:
        for batch in pa.ipc.open_stream(content):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[k].as_py(), b.column(1)[k].as_py() // FAN, tuple(b.column(c)[k].as_py() for c in (2, 3, 4)), b.column(5)[k]) for b in batches for k in range(b.num_rows))
        for (k, group), own in groupby(rows, key=lambda r: r[:2]):
            held = []
            for e in merge((first, opened(content.as_py())) for _, _, first, content in own):  # a block is unpacked when it is its turn
                held.append(e)
                if len(held) == BLOCK:
                    yield _batch(held) if last else _packed(k, group, held)
                    held = []
            if held:
                yield _batch(held) if last else _packed(k, group, held)

    return run


def index(spark: SparkSession, path: str) -> DataFrame:
    """The capture histories of all archives below path: entries in order of url_key, timestamp and page_id.

    Each task sorts the entries of its files (Spark's sort, which spills): a run, cut into blocks at the bounds of
    ranges. Passes of loser trees merge FAN runs at a time, range by range, into longer ones, until FAN are left, which the last
    pass merges: blocks come out of Spark's shuffle in order of their first entries, and as those of a run don't overlap, a task
    holds a block or two of each of FAN runs, never a range. An entry is moved once a pass, of which there are as many as
    the logarithm of the runs to the base FAN. Partitions of the result follow each other in order. A URL captured any
    number of times is cut by timestamp and page_id. Bounds come from SAMPLED entries a range, chosen by hash.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    entries = written(archives.mapInArrow(_entries, ENTRY))
    key = ["url_key", "timestamp", F.asc_nulls_first("page_id")]
    ranges, total = partitions(spark), entries.count()
    take = min(1.0, SAMPLED * ranges / max(1, total))
    chance = F.pmod(F.xxhash64("url_key", "timestamp", "page_id", "offset"), F.lit(1_000_000))
    few = entries.where(chance < max(1, int(take * 1_000_000))).select("url_key", "timestamp", "page_id", chance.alias("c"))
    keys = sorted(order(tuple(r)[:3]) for r in few.orderBy("c").limit(4 * SAMPLED * ranges).collect())
    bounds = spark.sparkContext.broadcast([keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else [])
    ordered = entries.sortWithinPartitions(*key)
    blocks, runs = ordered.mapInArrow(_blocks(bounds), BLOCKS), entries.rdd.getNumPartitions()
    group = F.floor(F.col("run") / FAN)
    while runs > FAN:
        dealt = blocks.repartition(ranges * min(4, -(-runs // FAN)), "range", group).sortWithinPartitions("range", group, *key)
        blocks, runs = written(dealt.mapInArrow(_merged(False), BLOCKS)), -(-runs // FAN)
    return blocks.repartitionByRange(ranges, "range").sortWithinPartitions("range", *key).mapInArrow(_merged(True), ENTRY)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html, timestamp if there is one) as WARC files and gives their merged index.

    Null html counts as empty, and a null url has the key ")/". An entry's offset and length are those of its record's
    gzip member in its file. Without a timestamp column, or where it is null, page
    n is captured n seconds after 2020-01-01. A null page_id is no response that others refer to unless all copies
    lack one. Rows that repeat a page_id get a record each. Other columns are not stored. No rows give no rows.
    """
    spark = pages.sparkSession
    path = path or scratch(spark)
    base = F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000)
    stamp = F.coalesce(F.col("timestamp").cast("timestamp"), base) if "timestamp" in pages.columns else base
    out = with_revisits(pages.select("page_id", "url", "html", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    write_warc(out.withColumn("url_key", url_key(F.col("url"))), path)
    return index(spark, path)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("timestamp").alias("captured"))


QUERIES = {"op4_warc_index": op4_warc_index}
ORACLE = {
    "op4_warc_index": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, lower(regexp_replace(coalesce(url, ''), '#.*$', '')) AS u FROM pages
        ), q AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest,
                   regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)', 1), '^www[.]', '') AS host,
                   regexp_replace(u, '^[a-z][a-z0-9+.-]*://[^/?]*', '') AS rest
            FROM p
        ), r AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
               strftime(make_timestamp((1577836800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM r
    """
}
