"""LM scoring: a word bigram model by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, mix, partitions, read, remainder, unique_sorted, written

#: Characters of text in a part, within which equal n-grams are asked for once; share of the training documents whose
#: counts are held out to learn the weights (one in TUNE); buckets of context frequency (powers of two); steps of EM.
PART_CHARS, TUNE, BUCKETS, STEPS = 10_000_000, 8, 24, 60
#: EM ends where no weight changes by more, or after STEPS.
SETTLED = 1e-7
#: Characters of all texts for each hash range, whose n-grams one task counts.
RANGE_CHARS = 32_000_000
END = np.uint64(0x7E1D5C0FFEE5A11D)
UNIGRAM, BIGRAM = 0, 1


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number of tokens of each text): A-Z lower-cased, words between ASCII white space, then an end."""
    split = [t.encode().lower().split() for t in texts]
    counts = np.array([len(s) + 1 for s in split], np.int64)
    ends = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = hashed([w for s in split for w in s])
    out[~is_word] = END
    return out, counts


def pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of each token, hash of context and token): a document's first context is the end of the one before."""
    context = np.concatenate(([END], words[:-1])) if len(words) else words
    return context, mix(mix(context) ^ words)


def _packed(x: np.ndarray) -> bytes:
    """Counts, mostly small: one byte each, or four where needed; then compressed."""
    raw = b"\1" + x.astype("<u1").tobytes() if not len(x) or x.max() < 256 else b"\4" + x.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw[1:], "<u1" if raw[0] == 1 else "<u4").astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals a task's documents into parts; documents whose counts are held out have parts of their own."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    held: dict[bool, tuple[list, int]] = {False: ([], 0), True: ([], 0)}

    def part(tune: bool) -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(held[tune][0])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        size, held[tune] = held[tune][1], ([], 0)
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([(task << 24) + made], pa.int64()), pa.array([tune]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "tune", "size", "docs"])

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            chunk = batch.slice(k, 256)
            for tune in (False, True):
                own = chunk.filter(pc.equal(chunk.column(3), tune))
                if own.num_rows:
                    rows, size = held[tune]
                    held[tune] = (rows + [own], size + own.column(1).nbytes)
                    if held[tune][1] > PART_CHARS:
                        yield part(tune)
    for tune in (False, True):
        if held[tune][0]:
            yield part(tune)


def _opened(docs: bytes) -> tuple[list, list[str], np.ndarray]:
    table = pa.ipc.open_stream(docs).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_numpy(zero_copy_only=False).astype(bool)


def _distinct(keys: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs where weigh is true."""
    at = np.argsort(keys, kind="stable")
    s = keys[at]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[first], (np.add.reduceat(weigh[at].astype(np.int64), first) if len(s) else first)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets, which are ranges of the sorted keys."""
    width = (1 << 64) // buckets + 1
    return np.searchsorted(keys, np.array([k * width for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)


def _requests(buckets: int):
    """For each bucket and kind the n-grams of a part, once each, with their counts in the part's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tune, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                _, texts, train = _opened(docs.as_buffer())
                words, counts = tokens(texts)
                weigh = np.repeat(train, counts)
                rows: list = []
                for kind, keys in ((UNIGRAM, words), (BIGRAM, pairs(words, counts)[1])):
                    keys, n = _distinct(keys, weigh)
                    cuts = _cuts(keys, buckets)
                    for k, (own, c) in enumerate(zip(np.split(keys, cuts), np.split(n, cuts), strict=True)):
                        if len(own):
                            rows.append((k, number, tune, kind, own.tobytes(), _packed(c)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "tune", "kind", "keys", "counts"])

    return run


def _replies(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket and kind: each part's n-grams with their counts in all training documents, and in those held out.

    A row with a null part holds the numbers of distinct training n-grams, of their occurrences and of those held out.
    """
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in group["keys"]])
    counts = [_unpacked(c) for c in group["counts"]]
    sizes = [len(c) for c in counts]
    own = np.concatenate(counts)
    tuned = np.repeat(group["tune"].to_numpy(bool), sizes)
    at = np.argsort(keys, kind="stable")
    s = keys[at]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first, number = np.flatnonzero(new), np.empty(len(s), np.int64)
    number[at] = np.cumsum(new) - 1
    total = np.add.reduceat(own[at], first)
    apart = np.add.reduceat(np.where(tuned, own, 0)[at], first)
    bounds = np.cumsum(sizes)[:-1]
    rows = [(p, k, b, _packed(total[x]), _packed(apart[x]), 0, 0, 0) for p, k, b, x in zip(group["part"], group["kind"], group["bucket"], np.split(number, bounds), strict=True)]
    rows.append((None, int(group["kind"].iloc[0]), int(group["bucket"].iloc[0]), b"", b"", int((total > 0).sum()), int(total.sum()), int(apart.sum())))
    return pd.DataFrame(rows, columns=["part", "kind", "bucket", "total", "apart", "types", "n", "apart_n"]).astype({"part": "Int64"})


def _looked_up(replies: pd.DataFrame, kind: int, column: str, keys: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    own = replies[replies["kind"] == kind].sort_values("bucket")
    values = np.concatenate([_unpacked(c) for c in own[column]])
    return values[np.searchsorted(distinct, keys)]


def _events(docs: bytes, replies: pd.DataFrame, columns: tuple[str, ...]):
    """For each token of a part: counts of its bigram, its context and its word, from each of the columns."""
    ids, texts, train = _opened(docs)
    words, counts = tokens(texts)
    context, both = pairs(words, counts)
    uni, bi = unique_sorted(words), unique_sorted(both)
    # the first context is an end even if no document of the part came before: it is in the part, as each text has one
    found = [[_looked_up(replies, kind, c, keys, d) for kind, keys, d in ((BIGRAM, both, bi), (UNIGRAM, context, uni), (UNIGRAM, words, uni))] for c in columns]
    return ids, train, counts, found


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1)).astype(np.int64))


def _held_out():
    """Distinct held-out events of a part: context bucket, and counts of bigram, context and word that are left; n: how often."""

    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for docs in left["docs"]:
            _, train, counts, ((b, c, w), (b1, c1, w1)) = _events(docs, right, ("total", "apart"))
            b, c, w = b - b1, c - c1, w - w1
            own = pd.DataFrame({"bucket": _bucket(c), "b": b, "c": c, "w": w})[np.repeat(train, counts)]
            out.append(own.groupby(["bucket", "b", "c", "w"], as_index=False).size().rename(columns={"size": "n"}))
        return pd.concat(out)

    return run


def expectation_maximisation(events: DataFrame | None, left: int, types: int, steps: int = STEPS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket that make the held-out events likeliest.

    events: as _held_out() gives them (None: there are none); left: all occurrences that aren't held out. Spark sums each step's shares up, on
    exact counts: three numbers a bucket come to the driver. Where no event fell into a bucket the nearest lower bucket's
    weights hold, at first (0, 0.9, 0.1), or the uniform part's alone if nothing was learned. The weight of the uniform
    part stays over 0, so that no text gets probability 0; an unseen context has no bigram part.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen: set[int] = set()
    for _ in range(steps if events is not None else 0):
        # the weights are a constant of the plan, not of its generated code, which is compiled once
        now = F.lit(weights.ravel().tolist())
        weigh = lambda k: F.get(now, (F.col("bucket") * 3 + k).cast("int"))  # noqa: B023, E731
        parts = [weigh(0) * F.coalesce(F.try_divide(F.col("b").cast("double"), "c"), F.lit(0.0)), weigh(1) * F.col("w") / max(1, left), weigh(2) / (types + 1)]
        shares = events.select("bucket", "n", *(p.alias(f"p{k}") for k, p in enumerate(parts))).withColumn("p", F.expr("n / (p0 + p1 + p2)"))
        sums = {r[0]: np.array(r[1:]) for r in shares.groupBy("bucket").agg(*(F.sum(F.expr(f"p{k} * p")) for k in range(3))).collect()}
        seen, before = set(sums), weights.copy()
        for k, x in sums.items():
            w = np.maximum(x / x.sum(), [0, 0, 1e-9])
            weights[k] = w / w.sum()
        if abs(weights - before).max() <= SETTLED:
            break
    before = np.array([0.0, 0.9, 0.1]) if types else np.array([0.0, 0.0, 1.0])
    for k in range(BUCKETS):
        weights[k] = before = weights[k] if k in seen else before
    w = weights[0] * [0, 1, 1]
    weights[0] = w / w.sum()
    return weights


def _scored(n: int, types: int, weights: np.ndarray):
    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for docs in left["docs"]:
            ids, train, counts, ((b, c, w),) = _events(docs, right, ("total",))
            own = weights[_bucket(c)]
            p = own[:, 0] * (b / np.maximum(c, 1)) + own[:, 1] * (w / max(n, 1)) + own[:, 2] / (types + 1)
            starts = np.cumsum(counts) - counts
            base = np.add.reduceat(np.log10((w + 1) / (n + types + 1)), starts)
            out.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "trained": train, "n_tokens": counts, "n_known": np.add.reduceat((w > 0).astype(np.int64), starts), "train_tokens": n, "base_score": base, "score": np.add.reduceat(np.log10(p), starts)}))
        return pd.concat(out)

    return run


def score_documents(docs: DataFrame, trained: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    The model learns from the rows where `trained` holds. A token's probability mixes the maximum-likelihood estimates
    of its bigram and its word, and 1/(V+1), with weights for its context's frequency bucket. The weights are learned
    by EM on the counts of one in TUNE of the training documents, taken away from all counts for that; scores use the
    counts of all. base_score is the add-one unigram score. A null text counts as empty: an end alone. Rows that
    repeat are separate texts. Without training rows each token has probability 1/(V+1) = 1. No rows, no result.
    Tokens are told apart by 64-bit hashes. Other columns of docs aren't read.

    Texts are dealt into parts where they are read; a part asks for each of its n-grams once, packed by hash range.
    The ranges' counts go back to the parts, which meet their texts again by part number. So nothing is shuffled for
    each occurrence, no word is a hot key, and memory goes with the size of a part (or of the longest text) and of a hash
    range (as many as RANGE_CHARS asks for, one for each shuffle partition at least), never with the vocabulary.
    """
    spark = docs.sparkSession
    tune = trained & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(TUNE)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"), F.coalesce(tune, F.lit(False)).alias("tune"))
    parts = written(rows.mapInArrow(_parts, "part long, tune boolean, size long, docs binary"), "none")
    ranges = max(partitions(spark), -(-(parts.agg(F.sum("size")).first()[0] or 0) // RANGE_CHARS))
    parts = parts.drop("size")
    asked = parts.mapInArrow(_requests(ranges), "bucket int, part long, tune boolean, kind int, keys binary, counts binary")
    replies = written(asked.groupBy("bucket", "kind").applyInPandas(_replies, "part long, kind int, bucket int, total binary, apart binary, types long, n long, apart_n long"), "none")
    known = replies.where("part is null").groupBy("kind").agg(F.sum("types"), F.sum("n"), F.sum("apart_n")).collect()
    types, n, apart_n = next(((r[1], r[2], r[3]) for r in known if r[0] == UNIGRAM), (0, 0, 0))
    replies = replies.where("part is not null").select("part", "kind", "bucket", "total", "apart")
    tuning = parts.where("tune")
    lengths = replies.join(tuning.select("part"), "part", "left_semi")
    events = written(tuning.groupBy("part").cogroup(lengths.groupBy("part")).applyInPandas(_held_out(), "bucket long, b long, c long, w long, n long")) if n else None
    weights = expectation_maximisation(events, n - apart_n, types)
    schema = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("part").cogroup(replies.select("part", "kind", "bucket", "total").groupBy("part")).applyInPandas(_scored(n, types, weights), schema)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(read(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_lm_scores": op3_lm_scores}
ORACLE: dict[str, str] = {}
