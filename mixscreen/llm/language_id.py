"""Language ID by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, remainder, unused

#: Labelled documents (rows, taken whole) that each language's automaton is built from, at most.
DOCUMENTS = 16
#: Bytes of a text that are parsed side by side with the text's other pieces; the parse is that of the whole text.
PIECE = 1024
#: Bytes of a text that count at most in the score.
SCORED = 50
UNKNOWN = "und"


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of data (state 0 first)."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[cur] = q
        last = cur
    return nxt


class CrossParser:
    """Counts, for many texts at once, the phrases of the greedy parse of a text into longest substrings of each language's data."""

    def __init__(self, data: dict[str, bytes]) -> None:
        self.languages = sorted(data)
        self.bits = np.log2(np.array([[len(data[x]) + 2] for x in self.languages], np.float64))  # of a place in the data
        used = sorted(set().union(*data.values())) if data else []
        self.symbol = np.full(256, len(used), np.int64)  # the last symbol stands for bytes that no language has
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        tables, starts, base = [], [], 0
        for name in self.languages:
            moves = suffix_automaton(data[name])
            t = np.full((len(moves), self.width), -1, np.int32)
            for state, to in enumerate(moves):
                for c, x in to.items():
                    t[state, self.symbol[c]] = base + x
            # where no move is left, a new phrase begins: with this byte if the language has it; the lowest bit counts it.
            # One more state stands before a text and behind a byte that the language lacks: whatever follows is a new phrase
            fresh = base + len(moves)
            again = np.where(t[0] >= 0, t[0], fresh) * 2 + 1
            tables += [np.where(t >= 0, t * 2, again).astype(np.int32), again[None].astype(np.int32)]
            starts.append(fresh)
            base = fresh + 1
        self.starts = np.array(starts, np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases: a row for each language, a column for each text.

        Texts are cut into pieces that are parsed side by side, as if a phrase began with each. Then each piece is parsed
        again from the state in which the one before ended, until both parses are in the same state: from there they
        are one, most often after a few phrases. Where they never meet, the next piece is parsed again in turn.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner) or not len(self.languages):
            return counts
        number = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
        size = np.minimum(PIECE, lengths[owner] - number * PIECE)
        start = (np.cumsum(lengths) - lengths)[owner] + number * PIECE
        symbols = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]

        order = np.argsort(-size, kind="stable")
        by_size, at = size[order], start[order]
        state = np.repeat(self.starts[:, None], len(order), axis=1)
        found = np.zeros(state.shape, np.int64)
        active = np.searchsorted(-by_size, -np.arange(PIECE), side="left")
        for k in range(int(by_size[0])):
            n = active[k]
            s = self.table[state[:, :n] * self.width + symbols[at[:n] + k]]
            found[:, :n] += s & 1
            state[:, :n] = s >> 1
        phrases, ends = np.empty_like(found), np.empty_like(state)
        phrases[:, order], ends[:, order] = found, state

        alone, more = ends.copy(), np.zeros_like(phrases)
        later = np.flatnonzero(number > 0)
        lang, piece = (x.ravel() for x in np.meshgrid(np.arange(len(self.languages)), later, indexing="ij"))
        while len(piece):
            lang, piece = self._again(symbols, start, size, lang, piece, alone, ends, more)
            hold = piece + 1 < len(owner)
            lang, piece = lang[hold], piece[hold] + 1
            hold = number[piece] > 0
            lang, piece = lang[hold], piece[hold]
        for row, f in zip(counts, phrases + more, strict=True):
            row += np.bincount(owner, weights=f, minlength=len(texts)).astype(np.int64)
        return counts

    def _again(self, symbols, start, size, lang, piece, alone, ends, more) -> tuple[np.ndarray, np.ndarray]:
        """Parses pieces from the ends of those before; sets `more` phrases than alone, and `ends`; gives the pieces whose end is another than before."""
        true, spare, extra = ends[lang, piece - 1], self.starts[lang], np.zeros(len(piece), np.int64)
        changed: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(PIECE + 1):
            met, over = true == spare, size[piece] == k
            if k % 8 == 0 or over.any():
                done = met | over
                now, p, g = np.where(met, alone[lang, piece], true)[done], piece[done], lang[done]
                more[g, p] = extra[done]
                other = now != ends[g, p]
                ends[g, p] = now
                changed.append((g[other], p[other]))
                lang, piece, true, spare, extra = (x[~done] for x in (lang, piece, true, spare, extra))
                if not len(piece):
                    break
            c = symbols[start[piece] + k]
            s, t = self.table[true * self.width + c], self.table[spare * self.width + c]
            extra += (s & 1) - (t & 1)
            true, spare = s >> 1, t >> 1
        return tuple(np.concatenate(x) for x in zip(*changed, strict=True))


_PARSERS: dict[int, CrossParser] = {}


WORD = regex.compile(r"[\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """What is parsed: lower-case letters and their marks in UTF-8, a space for whatever stands between."""
    return " ".join(WORD.findall(text.lower())).encode()


def _predict(data, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if seed not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[seed] = CrossParser(data.value)
        parser = _PARSERS[seed]
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts = part.column(part.num_columns - 1).to_pylist()
                raw = [plain(t) for t in texts]
                real = np.array([any(c.isalpha() for c in t) for t in texts], bool) & bool(parser.languages)
                lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if real.any():
                    at = np.flatnonzero(real)
                    size = np.array([len(raw[i]) for i in at], np.float64)
                    bits = parser.phrases([raw[i] for i in at]) * parser.bits / size
                    lang[at] = np.array(parser.languages, object)[bits.argmin(axis=0)]
                    score[at] = 1 / np.exp2(-(bits - bits.min(axis=0)) * np.minimum(size, SCORED)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    return run


def learn(docs: DataFrame, documents: int = DOCUMENTS) -> dict[str, bytes]:
    """Text of each language: the whole texts of at most `documents` labelled documents, those of smallest hash.

    Rows without text, lang or doc_id don't count. Which rows are taken depends on doc_id and text alone, so
    partitions don't matter; rows that repeat both are one. The driver and each worker hold the sample's texts, and
    the workers tables of at most 2 states a byte.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("text").alias("t"), F.xxhash64("doc_id", F.lit(5)).alias("h")).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))).where(F.col("r") <= documents).select("doc_id", "lang", "t", "h")
    texts = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("t")).join(F.broadcast(first), ["doc_id", "lang", "t"])  # at most `documents` rows a language
    out: dict[str, bytes] = {}
    for r in sorted(texts.groupBy("lang", "h", "doc_id", "t").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.lang, r.h, r.doc_id, r.t)):
        out[r.lang] = out.get(r.lang, b"") + b" " + plain(r.text)
    return out


def identify(docs: DataFrame, data: dict[str, bytes], into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all), the language whose data gives the text the fewest phrases for each byte, and a score.

    The whole text is parsed, its letters alone, in lower case and with single spaces between, into the longest phrases that the data of a
    language has. Phrases are normalised: each counts the bits of a place in that data, over the text's bytes. The
    score is the winner's share if languages are weighed by 2^-bits of a text of as many bytes, SCORED at most. Null
    texts, texts without a letter, and all if no language was learned: `und` and 0. Ties go to the language that sorts
    first. Each row is predicted where it is. Columns of docs that are named as those of `into` are replaced.
    """
    cols = [c for c in (keep or docs.columns) if c not in into]
    schema = docs.select(*cols).schema.add(into[0], "string").add(into[1], "double")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    return docs.select(*cols, F.coalesce("text", F.lit("")).alias(unused("text", cols))).mapInArrow(_predict(shared, hash(str(sorted(data.items()))), schema.names), schema)


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs.where(remainder("doc_id", 4) != 2)), keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_cross_parsing": op5_cross_parsing}
ORACLE: dict[str, str] = {}
