"""Toxicity: a linear classifier of character n-grams that naive Bayes log-count ratios scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder, unused, written

#: Characters in an n-gram; bits of a feature's number; labelled documents (rows) that the fit takes at most; ranges in which features are counted.
ORDERS, BITS, SAMPLE, RANGES = (4, 5, 6), 20, 20_000, 64
#: Least log-likelihood ratio (G squared) of a feature and the label, and least size of its log-count ratio: others say next to nothing.
SIGNIFICANT, TELLING = 6.0, 1.0
#: The score from which a text counts as toxic; the share of clean texts that may reach it, by scores of texts that weren't learned from; parts that are left out in turn for these.
THRESHOLD, FALSE_ALARMS, FOLDS = 0.7, 0.005, 3
GAP = "\0" * 8
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose n-grams are made together.
TOGETHER = 1 << 18


def grams(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct lower-cased n-gram of each text, sorted; only of those features that are wanted, if given."""
    low = [t.lower() for t in texts]
    joined = GAP.join(low) + GAP
    ends = np.cumsum([len(t) + len(GAP) for t in low])
    text = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for start in range(0, len(text), TOGETHER):
        c = np.zeros(TOGETHER + 7, np.uint64)
        own = text[start : start + len(c)]
        c[: len(own)] = own
        m = min(TOGETHER, len(text) - start)
        key, full = c[:m].copy(), c[:m] != 0
        for k in range(1, max(ORDERS)):
            key *= ODD
            key += c[k : m + k]
            if k + 1 in ORDERS:
                f = (mix_small(key, k) >> np.uint64(64 - BITS)).astype(np.int64)
                real = full & (c[k : m + k] != 0)
                if wanted is not None:
                    real &= wanted[f]
                at = np.flatnonzero(real)
                doc = np.searchsorted(ends, at + start, side="right")
                out.append((doc << BITS) | f[at])
        if wanted is None and len(out) > 60:
            out = [np.unique(np.concatenate(out))]
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def mix_small(x: np.ndarray, k: int) -> np.ndarray:
    """A cheap mixing of numbers of which only the highest bits are used."""
    y = (x ^ np.uint64(k << 56)) * ODD
    return (y ^ (y >> np.uint64(32))) * ODD


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic): in how many texts of either label each feature is, packed by range."""
    counts, some = np.zeros((2, 1 << BITS), np.int32), False
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            doc, feature = grams(part.column(0).to_pylist())
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[doc]
            for label in (0, 1):
                counts[label] += np.bincount(feature[toxic == bool(label)], minlength=1 << BITS).astype(np.int32)
            some = True
    if some:
        ranges = np.split(counts, RANGES, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in ranges], pa.binary())], ["range", "counts"])


def significance(n0: np.ndarray, n1: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Log-likelihood ratio of independence, from the texts of either label that a feature is in."""
    table = [(n1, toxic), (n0, rows - toxic), (toxic - n1, toxic), (rows - toxic - n0, rows - toxic)]
    df = n0 + n1
    g = np.zeros(len(n0))
    for (n, of), total in zip(table, (df, df, rows - df, rows - df), strict=True):
        expected = total * (of / rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(n > 0, 2 * n * np.log(n / expected), 0)
    return g


def log_ratio(n0: np.ndarray, n1: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """The naive Bayes log-count ratio, smoothed by one."""
    return np.log(((n1 + 1) / (toxic + 2)) / ((n0 + 1) / (rows - toxic + 2)))


def telling(n0: np.ndarray, n1: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Which features are learned from."""
    return (n0 + n1 >= 3) & (significance(n0, n1, rows, toxic) >= SIGNIFICANT) & (abs(log_ratio(n0, n1, rows, toxic)) >= TELLING)


def _summed(rows: int, toxic: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = 2 * (1 << BITS) // RANGES
        total = np.zeros(size, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(pa.decompress(x, decompressed_size=4 * size, codec="zstd"), np.int32)
        n0, n1 = total.reshape(2, -1)
        at = np.flatnonzero(telling(n0, n1, rows, toxic))
        return pd.DataFrame({"feature": at + int(group["range"].iloc[0]) * (size // 2), "n0": n0[at], "n1": n1[at]})

    return run


def _selected(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                doc, feature = grams(part.column(0).to_pylist(), wanted.value)
                own = np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x.tobytes() for x in own], pa.binary())], ["toxic", "features"])

    return run


def fit(features: list[np.ndarray], labels: list[int], ratio: np.ndarray, rounds: int = 200, penalty: float = 3e-3) -> tuple[float, np.ndarray]:
    """(bias, weights): logistic regression (Adam, full batches, classes of equal mass) on the numbered features of each text, each times its log-count ratio."""
    y = np.asarray(labels, np.float64)
    n, m = len(features), len(ratio)
    doc, col = np.repeat(np.arange(n), [len(x) for x in features]), np.concatenate(features).astype(np.int64)
    x = ratio[col]
    mass = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(m), 0.0
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, rounds + 1):
        s = b + np.bincount(doc, weights=w[col] * x, minlength=n)
        d = mass * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        g = np.append(np.bincount(col, weights=d[doc] * x, minlength=m) + penalty * w, d.sum())
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        step = 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w * ratio


def shift(features: list[np.ndarray], labels: list[int], m: int, folds: int = FOLDS) -> float:
    """What is added to the bias so that THRESHOLD separates texts that weren't learned from.

    Each of `folds` parts is scored by a model of the others, with counts, telling features and ratios of theirs. The
    threshold's place is halfway between the score that FALSE_ALARMS of the clean texts pass and the next score of a
    toxic one above it (that score itself, if there is none).
    """
    y, n = np.asarray(labels), len(features)
    part, scores = np.arange(n) % folds, np.zeros(n)
    for k in range(folds):
        own, rest = np.flatnonzero(part != k), np.flatnonzero(part == k)
        toxic = int(y[own].sum())
        if not 0 < toxic < len(own) or not len(rest):
            return 0.0
        n0, n1 = (np.bincount(np.concatenate([features[i] for i in own if y[i] == label]), minlength=m) for label in (0, 1))
        used = telling(n0, n1, len(own), toxic)
        number = np.where(used, np.cumsum(used) - 1, -1)
        chosen = [x[x >= 0] for x in (number[features[i]] for i in own)]
        b, w = fit(chosen, y[own].tolist(), log_ratio(n0[used], n1[used], len(own), toxic))
        weights = np.zeros(m)
        weights[used] = w
        scores[rest] = [b + weights[features[i]].sum() for i in rest]
    at = np.quantile(scores[y == 0], 1 - FALSE_ALARMS, method="higher")
    above = scores[(y == 1) & (scores > at)]
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (at + above.min()) / 2 if len(above) else np.log(THRESHOLD / (1 - THRESHOLD)) - at)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """(bias, weight of each feature), learned from at most `sample` labelled documents: those of smallest hash, half of them of either label.

    labels: doc_id, toxic; null labels and ids, and null texts, are left out; of several labels of a document the
    larger counts, of several texts the one of smallest hash. With no row of one label the classifier gives every text
    its bias: 0 or 1 as the other label has it, 0.5 without any row.

    The bias is set so that THRESHOLD keeps clean texts: see shift(). Whole texts are learned from. Tasks count features; sums by range give the log-count ratios, and the features that
    go with the label (SIGNIFICANT). The driver gets these, and each text's numbers of them, never a text.
    """
    spark, nothing = docs.sparkSession, np.zeros(1 << BITS, np.float32)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    taken = marked.where("toxic = 1").orderBy("h", "doc_id").limit(sample // 2).unionAll(marked.where("toxic = 0").orderBy("h", "doc_id").limit(sample // 2))
    ids = F.broadcast(written(taken.select("doc_id", "toxic")))  # at most `sample` rows
    rows = docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    found = dict(rows.groupBy("toxic").count().collect())
    n, toxic = sum(found.values()), found.get(1, 0)
    if len(found) < 2:
        return (0.0 if not n else 40.0 if toxic else -40.0), nothing
    known = rows.mapInArrow(_counted, "range int, counts binary").groupBy("range").applyInPandas(_summed(n, toxic), "feature long, n0 long, n1 long").toPandas().sort_values("feature")
    ratio = log_ratio(known["n0"].to_numpy(), known["n1"].to_numpy(), n, toxic)
    wanted = np.zeros(1 << BITS, bool)
    wanted[known["feature"]] = True
    number = np.cumsum(wanted) - 1
    chosen = rows.mapInArrow(_selected(spark.sparkContext.broadcast(wanted)), "toxic int, features binary").toPandas()
    chosen = chosen.sort_values(["toxic", "features"], kind="stable")  # so that partitions make no difference
    numbers, marks = [number[np.frombuffer(x, np.int32)] for x in chosen["features"]], chosen["toxic"].tolist()
    b, w = fit(numbers, marks, ratio)
    nothing[known["feature"]] = w
    return b + shift(numbers, marks, len(ratio)), nothing


def _scores(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model.value
        wanted = weights != 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                doc, feature = grams(part.column(part.num_columns - 1).to_pylist(), wanted)
                s = bias + np.bincount(doc, weights=weights[feature], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(s, -40, 40))), pa.float64())], names)

    return run


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray], text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all) and the score of its text, 0 to 1; null counts as empty, whose score is that of the bias.

    Whole texts are scored: a feature counts once for a text. The model (a bias and 2^BITS single floats, 4 MB) is
    a broadcast variable of fixed size. Rows stay where they are; a column named as `into` is replaced.
    """
    cols = [c for c in (keep or docs.columns) if c != into]
    frame = docs.select(*cols, F.coalesce(text, F.lit("")).alias(unused("text", cols)))
    schema = docs.select(*cols).schema.add(into, "double")
    return frame.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), schema.names), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    out = score_toxicity(docs, model, keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
