"""Byte-level BPE encoding and decoding with padded matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: No pair; characters of text that are encoded together; pieces and bytes of a piece that a worker remembers.
NONE, TOGETHER, REMEMBERED, SHORT = np.int32(2**31 - 1), 1 << 20, 1 << 18, 64
#: Cells of a matrix; bytes of a piece from which all places of its smallest pair are merged in a round where that is the same.
CELLS, LONG = 1 << 20, 512
#: Bytes of ids after which a batch is passed on.
PASSED = 1 << 24


class Pairs:
    """A hash table from pairs of ids to the id of the merged token: open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE, np.int32)
        at, rest = self.place(keys), np.arange(len(keys))
        while len(rest):
            free = self.values[at] == NONE
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)  # one key for each free place
            put = first[free[first]]
            self.keys[at[put]], self.values[at[put]] = keys[rest[put]], merged[rest[put]]
            left_over = np.ones(len(rest), bool)
            left_over[put] = False
            at, rest = (at[left_over] + 1) & self.mask, rest[left_over]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id for each pair, NONE where there is none or an id is negative."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        keys, out = keys.ravel(), np.full(keys.size, NONE)
        rest = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = keys[rest]
        at = self.place(keys)
        while len(rest):
            same = self.keys[at] == keys
            out[rest[same]] = self.values[at[same]]
            on = ~same & (self.values[at] != NONE)  # an empty place ends the search
            rest, keys, at = rest[on], keys[on], (at[on] + 1) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """The ranks of a file in tiktoken's format: a base64 token and its rank, which is its id, on each line. All 256 single bytes must be there."""

    def __init__(self, path: str) -> None:
        lines = Path(path).read_bytes().split(b"\n")
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = Pairs(left, right, merged.astype(np.int32))
        # a token from which no pair of a smaller or equal rank can come: all its places may be merged in one round
        self.plain = np.ones(max(self.ranks.values()) + 1, bool)
        self.plain[left[merged <= left]] = False
        self.plain[right[merged <= right]] = False
        held: list[bytes | None] = [None] * len(self.plain)
        for token, r in self.ranks.items():
            held[r] = token
        self.tokens = pa.array(held, pa.large_binary())

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit numbers. A piece that is a token is that token; others are merged in buckets of about equal length."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (r := self.ranks.get(piece)) is not None:
                out[k] = r.to_bytes(4, "little")
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(k)
        for bits, own in buckets.items():
            width = 1 << bits
            if width >= LONG:
                for k in own:
                    out[k] = self.one(pieces[k])
                continue
            for first in range(0, len(own), max(1, CELLS // width)):
                some = own[first : first + max(1, CELLS // width)]
                for k, ids in zip(some, self.together([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merges the leftmost pair of minimum rank of every row of a padded matrix each round; a merge leaves a hole, which is closed. Rows without a pair leave the matrix."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = lambda x: np.concatenate((x[:, 1:], np.full((len(x), 1), -1, np.int32)), axis=1)
        ranks, rows, out = self.pairs.find(ids, after(ids)), np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            ended = best == NONE
            if ended.any():
                for k, own in zip(rows[ended], ids[ended], strict=True):
                    out[k] = own[own >= 0].tobytes()
                ids, ranks, rows, at, best = ids[~ended], ranks[~ended], rows[~ended], at[~ended], best[~ended]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids[every, at] = best
            ids, ranks = ids[keep].reshape(len(rows), -1), ranks[keep].reshape(len(rows), -1)
            last = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[every, at] = self.pairs.find(best, np.where(at + 1 < ids.shape[1], ids[every, last], -1))
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], best[before])
        return out

    def one(self, piece: bytes) -> bytes:
        """A long piece alone. All places of the smallest pair are merged in a round, from the left, where no smaller pair can come from it; else the leftmost."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if self.plain[best]:
                starts = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]  # of places next to each other every second
            else:
                at = at[:1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            ids = ids[keep]
            # pairs that begin at a merged token or before one are new
            at = at - np.arange(len(at))
            ranks = np.concatenate((ranks, [NONE]))[keep][:-1]
            new = np.unique(np.concatenate((at, at - 1)))
            new = new[(new >= 0) & (new < len(ranks))]
            ranks[new] = self.pairs.find(ids[new], ids[new + 1])
        return ids.tobytes()


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _VOCABULARIES.get(path) or _VOCABULARIES.setdefault(path, Vocabulary(path))


def cuts(text: str, most: int = TOGETHER) -> Iterator[str]:
    """The text in parts of about `most` characters. Cut before white space that follows other characters, where a match of the pattern always ends."""
    import regex

    edge, at = regex.compile(r"\S(?=\s)"), 0
    while len(text) - at > most and (m := edge.search(text, at + most)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, own = regex.compile(pattern).findall, vocabulary(path)
        known: dict[str, bytes] = {}

        def encoded(texts: list[str]) -> list[bytes]:
            pieces = [split(t) for t in texts]
            new = list(set(chain.from_iterable(pieces)).difference(known))
            found = dict(zip(new, own.encode([p.encode() for p in new]), strict=True))
            if len(known) + len(found) > REMEMBERED:
                found |= {p: known[p] for p in set(chain.from_iterable(pieces)).intersection(known)}
                known.clear()
            known.update((p, x) for p, x in found.items() if len(p) <= SHORT)
            look = known if all(len(p) <= SHORT for p in new) else known | found
            return [b"".join(map(look.__getitem__, p)) for p in pieces]

        def groups(texts: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
            held, size = [], 0
            for k, text in texts:
                for part in cuts(text):
                    held.append((k, part))
                    size += len(part)
                    if size > TOGETHER:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for batch in batches:
            rest, texts = batch.column(0), batch.column(1)
            done: list[list[bytes]] = []  # of the rows from `first` on
            first = 0

            def passed(upto: int) -> pa.RecordBatch:
                joined = [b"".join(x) for x in done[: upto - first]]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in joined], dtype=np.int64)))
                values = pa.array(np.frombuffer(b"".join(joined), np.int32))
                return pa.RecordBatch.from_arrays([rest.slice(first, upto - first), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "ids"])

            for group in groups((k, t.as_py() or "") for k, t in enumerate(texts)):
                for (k, _), x in zip(group, encoded([t for _, t in group]), strict=True):
                    while first + len(done) <= k:
                        done.append([])
                    done[k - first].append(x)
                upto = first + len(done) - 1  # the last row may go on
                if sum(len(x) for own_ids in done for x in own_ids) > PASSED and upto > first:
                    out = passed(upto)
                    done, first = done[-1:], upto
                    yield out
            if done:
                yield passed(batch.num_rows)

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            ids = batch.column(1)
            if ids.null_count:
                ids = ids.fill_null([])
            flat = ids.flatten()
            if flat.null_count or len(flat) and not 0 <= min(flat.to_numpy()) <= max(flat.to_numpy()) < len(own.tokens):
                raise ValueError("an id is in no vocabulary")
            tokens = own.tokens.take(flat)
            if tokens.null_count:
                raise ValueError("an id is in no vocabulary")
            at = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
            ends = at[ids.offsets.to_numpy() - ids.offsets[0].as_py()] if len(ids) else np.zeros(1, np.int64)
            data = tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids: array<int>) of each row of docs: what tiktoken gives for the whole text with the ranks in the file and the pattern (the public one), without special tokens.

    Each match of the pattern is merged by itself; equal ones of a group of texts (of about a million characters) once.
    Matches are bucketed by length into padded matrices, in which every row merges its leftmost pair of minimum rank
    each round; pairs are looked up in a hash table. Matches of LONG bytes or more are merged alone. A text of any
    length is read whole, cut where a match ends anyway. Null and empty texts have no ids. Rows that repeat or have no
    doc_id have their own results. Other columns don't matter. No rows give no rows. No shuffle.
    """
    import public_tokenizers

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(path, pattern or public_tokenizers.PATTERN), "doc_id long, ids array<int>")


def bpe_decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded: binary) of rows (doc_id, ids): the bytes of the tokens one after another. Null ids are empty; an id without a token raises an error."""
    return rows.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids array<int>, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_decode(bpe_encode(read(spark, sf_dir, "documents"), path), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLE: dict[str, str] = {}
