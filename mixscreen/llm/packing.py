"""Packing by power-of-two decomposition."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MAX_LENGTH, END = 2048, 1
#: Pieces that a document in a given order may have: more than a text of 2 GB has.
MOST_PIECES = 1 << 21
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long"


def decompose(n: int, most: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of pieces that cover n tokens: whole `most`s, then the binary digits of the rest, longest first."""
    out, at = [], 0
    while at < n:
        size = most if n - at >= most else 1 << (n - at).bit_length() - 1
        out.append((at, size))
        at += size
    return out


#: The pre-tokens of byte-level BPE where no white space character stands next to another: without the look-ahead,
#: which only matters in longer runs, the pattern runs in linear time.
ALONE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
TOGETHER = re.compile(r"\s(?:\s|$)")


def encoder(path: str) -> Callable[[str], Sequence[int]]:
    """Ids of a text as `tokenizers` gives them by default, with add_special_tokens=False, for a byte-level BPE file.

    If the file's merges make its ids in order, as in such vocabularies, its ids are merge ranks and tiktoken's
    faster core gives the same ids (tests compare them); `tokenizers` itself is used for other files, and for texts
    with the literal content of an added token, which has an id of its own.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
    if not (plain and merged and merged == sorted(set(merged)) and merged[0] >= 256):
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    import public_tokenizers
    import tiktoken

    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    core, alone = (tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for pattern in (public_tokenizers.PATTERN, ALONE))
    added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def encode(text: str) -> Sequence[int]:
        if added.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return core(text) if TOGETHER.search(text) else alone(text)

    return encode


_ENCODERS: dict[str, Callable] = {}


def _pieces(path: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, encoder(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # bounds what is held for the longest texts
                part = batch.slice(first, 256)
                cols: tuple = ([], [], [], [], [], [])
                for doc_id, text, at in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    numbers = encode(text)
                    n = len(numbers) + 1
                    ids = struct.pack(f"<{n}I", *numbers, end)
                    for k, (start, length) in enumerate(decompose(n, most)):
                        for col, x in zip(cols, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n, None if at is None else at * MOST_PIECES + k), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, most: int = MAX_LENGTH, order: Column | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket) of the token sequences of docs.

    A document's ids (and `end`) are cut into pieces of power-of-two lengths up to `most`; a piece is a sequence of
    its own, so none crosses documents and none needs padding. `bucket` is the length's logarithm: batches are drawn
    from one bucket (see write_buckets()). ids: little-endian uint32. A null or empty text has the end
    id alone; null or repeated doc_ids are carried along, a row for each piece of each row. Sequence ids are unique,
    not consecutive, and depend on how docs are partitioned; with `order` (a long, not negative, of its own for each row) they follow it, and the pieces of a
    document follow each other. Other columns of docs are not read. No shuffle: each row is packed where it is read.
    tokenizer: path of a byte-level BPE file for `tokenizers`.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(None) if order is None else order).cast("long").alias("order")).mapInArrow(_pieces(str(tokenizer), end, most), PIECES)
    number = F.monotonically_increasing_id() if order is None else F.col("sequence_id")
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pieces as Parquet, a folder for each bucket: sequences in it have one length, so a batch of them is a matrix. No rows write no folder."""
    pieces.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read(spark, sf_dir, "documents")))


QUERIES = {"op10_pack_powers": op10_pack_powers}
ORACLE: dict[str, str] = {}
