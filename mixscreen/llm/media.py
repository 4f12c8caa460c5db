"""Media columns: interleaved sequences of text and media, with payloads stored and found by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, unused, written

#: Width of the stored grey images, in samples.
WIDTH = 192
PART = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
SCHEME = "media:sha256:"


class Sequence(HTMLParser):
    """Collects text and media references in the order of the page; a figure's caption belongs to the figure's last reference.

    What a browser doesn't show, text or media, is left out: the title and what is in SKIPPED elements. Other parts of
    the head show nothing, so its end, which pages may leave out, doesn't matter. An element that is never closed
    skips nothing but itself: its start is among `ignored`, the places of start tags to pass over. Media are those of
    src; srcset and attributes for scripts, such as data-src, aren't read.
    """

    BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "figure", "figcaption", "img", "video", "audio", "source", "blockquote", "pre"}
    SKIPPED = {"script", "style", "title", "noscript", "template"}
    MEDIA = {"img", "video", "audio", "source"}

    def __init__(self, ignored: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption, self.last = None, None
        self.ignored, self.starts = ignored, 0
        self.open: list[tuple[str, int]] = []  # skipped elements: tag and place among the starts of such

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.parts.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.starts += 1
            if self.starts not in self.ignored:
                self.open.append((tag, self.starts))
        elif self.open:
            return
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.last = None
            given = dict(attrs)
            if tag in self.MEDIA and (src := given.get("src")):
                digest = src.removeprefix(SCHEME).lower() if src.startswith(SCHEME) else None
                self.last = {"kind": "media", "text": None, "src": src, "digest": digest, "caption": given.get("alt")}
                self.parts.append(self.last)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            at = max((k for k, (own, _) in enumerate(self.open) if own == tag), default=None)
            if at is not None:  # what was opened inside ends too
                del self.open[at:]
        elif self.open:
            return
        elif tag == "figcaption" and self.caption is not None:
            if self.last is not None:
                self.last["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.open:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str) -> list[dict]:
    """The parts of a page, with their positions. A page with elements that are never closed is read again without their starts."""
    ignored: frozenset[int] = frozenset()
    while True:
        page = Sequence(ignored)
        page.feed(html)
        page.close()
        if not page.open:
            page.flush()
            return [p | {"position": k} for k, p in enumerate(page.parts)]
        ignored |= {k for _, k in page.open}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))]))
    for batch in batches:
        parts = pa.array([parse(h) for h in batch.column(1).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), parts], [batch.schema.names[0], "sequence"])


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, sequence): the ordered text and media-reference structs of each page's HTML; null or empty HTML has an empty sequence."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.coalesce(html, F.lit("")).alias(unused("html", [key]))).mapInArrow(_parsed, f"{key} {kind}, sequence {PART}")


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), filled up with spaces to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)) * WIDTH
    return F.concat(raw, F.repeat(F.lit(" "), (n - F.octet_length(raw)).cast("int")).cast("binary"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, payload) of payloads that the task hasn't met before."""
    seen: set[bytes] = set()
    for batch in batches:
        new, digests = [], []
        for k, x in enumerate(batch.column(0)):
            if (d := hashlib.sha256(x.as_buffer()).digest()) not in seen:
                seen.add(d)
                new.append(k)
                digests.append(d.hex())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column(0).take(pa.array(new, pa.int64()))], ["digest", "payload"])


def store(payloads: DataFrame, path: str) -> None:
    """Writes (digest, media) below path: each payload as a binary grey image (PGM, 8 bits a sample, WIDTH samples a row), named by the payload's SHA-256. A task stores equal payloads once."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length("payload") / WIDTH).cast("long").cast("string"), F.lit("\n255\n")).cast("binary")
    payloads.select("payload").mapInArrow(_once, "digest string, payload binary").select("digest", F.concat(head, "payload").alias("media")).write.option("compression", "zstd").parquet(path)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of 8 by 8 fields of each image are brighter than the image's mean (an average hash), as hex, then the mean in 1/100. Whole numbers throughout."""
    for batch in batches:
        out = []
        for image in batch.column(2):
            data = image.as_buffer()
            x = np.frombuffer(data, np.uint8)[bytes(data[:40]).index(b"\n255\n") + 5 :].reshape(-1, WIDTH)
            n = len(x)
            columns = np.concatenate((np.zeros((1, 8), np.int64), np.cumsum(x.reshape(n, 8, -1).sum(axis=2, dtype=np.int64), axis=0)))
            a = np.arange(8) * n // 8
            b = np.maximum(a + 1, np.arange(1, 9) * n // 8)
            fields, sizes, total, count = columns[b] - columns[a], (b - a) * (WIDTH // 8), int(columns[-1].sum()), x.size
            bits = np.packbits((fields * count > total * sizes[:, None]).ravel())
            out.append(f"{bits.tobytes().hex()}-{(200 * total + count) // (2 * count)}")
        yield batch.drop_columns(["media"]).append_column("feature", pa.array(out, pa.string()))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each stored payload, from the bytes read back: payload_sha256 (its key), payload_bytes, tail_crc32, media_bytes, media_sha256, feature.

    Copies of a payload meet as equal entries, of which one is kept by a map-side aggregate. Entries are written.
    A payload that isn't the one it was stored as raises an error.
    """
    stored = spark.read.schema("digest string, media binary").parquet(path)
    body = F.expr("substring(media, locate('\n255\n', cast(substring(media, 1, 40) as string)) + 5)")
    rows = stored.select("digest", F.octet_length("media").cast("long").alias("media_bytes"), "media", F.sha2(body, 256).alias("payload_sha256"), F.octet_length(body).cast("long").alias("payload_bytes"), F.crc32(F.substring(body, -16, 16)).alias("tail_crc32"), F.sha2("media", 256).alias("media_sha256"))
    schema = "digest string, media_bytes long, payload_sha256 string, payload_bytes long, tail_crc32 long, media_sha256 string, feature string"
    whole = F.when(F.col("digest") == F.col("payload_sha256"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("stored media is damaged: "), "digest")).cast("boolean"))
    entries = rows.mapInArrow(_features, schema).where(whole)
    return written(entries.groupBy("payload_sha256").agg(*[F.first(c).alias(c) for c in ("payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature")]))


def resolve(parsed: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each part of each sequence: key, position, kind, text, src, digest, caption and the columns of the media entry with that digest (null if there is none, and for text).

    Only references move, not payloads: the join is by digest with the index of entries. The index is a read table, so
    that adaptive execution can split the references of a digest that many pages show; text isn't joined at all.
    """
    parts = parsed.select(F.col(key).alias("key"), F.explode("sequence").alias("p")).select(F.col("key").alias(key), "p.*")
    columns = [F.lit(None).cast(media.schema[c].dataType).alias(c) for c in media.columns]
    return parts.where("digest IS NULL").select("*", *columns).unionByName(parts.where("digest IS NOT NULL").join(media, F.col("digest") == F.col("payload_sha256"), "left"))


def interleave(pages: DataFrame, payloads: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Stores payloads (payload binary) and resolves the references ("media:sha256:DIGEST" in a src) of the pages to them.

    Positions count text and media parts of a page in order; captions are those of the figure, or else alternative
    texts. References to nothing stay, with null entries. Equal payloads have one entry. Null payloads are left out;
    null and repeated keys are carried along; other columns of either table don't matter; no rows give no rows.
    """
    path = scratch(pages.sparkSession)
    store(payloads.where("payload is not null"), path)
    return resolve(sequences(pages, key, html), describe(pages.sparkSession, path), key)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), payload(F.col("text")).alias("payload"))
    html = F.concat(F.lit("<article><figure><img src='" + SCHEME), F.sha2("payload", 256), F.lit("'><figcaption>"), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure></article>"))
    out = interleave(docs.select("doc_id", html.alias("html")), docs.select("payload"), key="doc_id").where("kind = 'media'")
    return out.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the pages as they are: their parts in order, and a digest of all text that a page shows."""
    out = sequences(read(spark, sf_dir, "pages"))
    text = F.filter("sequence", lambda p: p["kind"] == "text")
    return out.select("page_id", F.size("sequence").alias("n_parts"), F.size(F.filter("sequence", lambda p: p["kind"] == "media")).alias("n_media"), F.sha2(F.array_join(F.transform(text, lambda p: p["text"]), "\n").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op6_media_columns": op6_media_columns, "op6_page_sequences": op6_page_sequences}
#: CRC-32 of the last 16 bytes bit by bit, and the average hash from the bytes of each image.
ORACLE = {
    "op6_media_columns": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
        ), p AS (
            SELECT doc_id, n_bytes, greatest(1, (n_bytes + 191) // 192) AS h, text || repeat(' ', (greatest(1, (n_bytes + 191) // 192) * 192 - n_bytes)::BIGINT) AS payload FROM t
        ), q AS (
            SELECT *, chr(80) || '5' || chr(10) || '192 ' || h || chr(10) || '255' || chr(10) AS head, list_transform(regexp_extract_all(hex(encode(payload)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM p
        ), u AS (
            SELECT doc_id, h, unnest(bytes) AS v, unnest(range(len(bytes))) AS k FROM q
        ), w AS (
            SELECT doc_id, h, k // 192 AS y, (k % 192) // 24 AS fx, sum(v) AS v FROM u GROUP BY ALL
        ), f AS (
            SELECT w.doc_id, r.range AS fy, fx, sum(v) AS v, count(*) * 24 AS n
            FROM w JOIN range(8) r ON y >= r.range * h // 8 AND y < greatest(r.range * h // 8 + 1, (r.range + 1) * h // 8) GROUP BY ALL
        ), m AS (
            SELECT doc_id, sum(v) AS total, max(h) * 192 AS n FROM w GROUP BY doc_id
        ), g AS (
            SELECT f.doc_id, fy, sum(CASE WHEN f.v * m.n > m.total * f.n THEN 1 << (7 - fx)::INT ELSE 0 END) AS byte, any_value((200 * m.total + m.n) // (2 * m.n)) AS mean
            FROM f JOIN m USING (doc_id) GROUP BY f.doc_id, fy
        ), e AS (
            SELECT doc_id, string_agg(printf('%02x', byte::INT), '' ORDER BY fy) || '-' || any_value(mean)::BIGINT AS feature FROM g GROUP BY doc_id
        )
        SELECT q.doc_id, n_bytes, h * 192 AS payload_bytes, sha256(payload) AS payload_sha256,
               xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes[-16:]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS tail_crc32,
               h * 192 + length(head) AS media_bytes, sha256(head || payload) AS media_sha256, feature
        FROM q JOIN e USING (doc_id)
    """
}
