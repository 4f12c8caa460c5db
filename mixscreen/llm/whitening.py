"""Whitening of embeddings by shifted CholeskyQR."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, whole_numbers, written

#: Components that are returned; passes over the rows that orthogonalise them at most; rows in a block of a sum.
COMPONENTS, PASSES, BLOCK = 4, 5, 1 << 14
#: Components whose standard deviation is less, as a share of the largest, have no variance to divide by.
NOTHING = 1e-8


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column of lists as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular r, column by column."""
    out = np.empty_like(rows, order="F")
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """R with R'R = gram; with shift added to the diagonal if it isn't positive definite otherwise (or if the shift is asked for by a negative number)."""
    if shift >= 0:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(gram + abs(shift) * np.eye(len(gram))).T


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors x and the exact sum of each dimension: high and low halves of the numbers are summed apart in each task, then as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(high))], pa.int32()), pa.array([0, *high], pa.int64()), pa.array([n, *low], pa.int64())], ["j", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "j int, high long, low long").groupBy("j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")])
    found = {r.j: (int(r.high) << 32) + int(r.low) for r in parts.collect()}  # a row for each dimension
    return found.pop(-1, 0), [found[j] for j in sorted(found)]


def gram(fit: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of what rows_of makes of the vectors, whose width it keeps or changes.

    A task adds up its blocks and gives a row for each row of the matrix; these are dealt out by their place and
    added in the order of the tasks, so that no task holds more than one row of the sum, and the driver one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                q = rows_of(matrix(batch.slice(k, BLOCK).column(0)))
                held = q.T @ q if held is None else held + q.T @ q
        if held is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["i", "part", "held"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held], pa.list_(pa.float64()))], ["i", "held"])
        for batch in batches:
            for i, own in zip(batch.column(0).to_pylist(), matrix(batch.column(2)), strict=True):
                if i != at and at is not None:
                    yield give()
                at, held = i, own if i != at else held + own
        if at is not None:
            yield give()

    parts = fit.select("x").mapInArrow(run, "i int, part int, held array<double>")
    whole = parts.repartition(partitions(fit.sparkSession), "i").sortWithinPartitions("i", "part").mapInArrow(added, "i int, held array<double>")
    return np.array([r.held for r in sorted(whole.collect(), key=lambda r: r.i)], float)


def components(fit: DataFrame, n: int, total: list[int], most: int = COMPONENTS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors as columns, eigenvalues, trace) of the covariance of the vectors x.

    The first pass takes the Gram matrix of the centred rows, whose Cholesky factor with a shift on the diagonal always
    exists. Each further pass solves the rows by the factors so far and takes the Gram matrix again, until it is the
    identity to rounding; the product of the factors is R of the centred rows, whose singular values and right
    vectors are those of the rows. Where the rows have less than full rank the last factors are shifted too.
    """
    mean = np.array([t / n for t in total])
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for r in factors:
            q = solved(q, r)
        return q

    d, trace, r = len(total), 0.0, np.eye(len(total))
    for k in range(passes):
        g = gram(fit, orthogonal)
        if k == 0:
            trace = float(np.trace(g)) / n
            if not trace:
                return np.zeros((d, 0)), np.zeros(0), 0.0
        shift = 11 * (min(n, BLOCK) * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
        own = cholesky(g, shift if k else -shift)
        factors.append(own)
        r = own @ r
        if k and np.abs(g - np.eye(d)).max() < 1e-10:
            break
    _, s, v = np.linalg.svd(r)
    keep = min(most, int((s > NOTHING * s[0]).sum()))
    v = v[:keep] * np.where(np.take_along_axis(v[:keep], np.abs(v[:keep]).argmax(axis=1)[:, None], 1) < 0, -1, 1)  # the largest entry is positive
    return v.T, s[:keep] ** 2 / n, trace


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """For each row the sum over dimensions of (n x - total) squared; None where it is no 64-bit number."""
    widest = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, total), default=0)
    if widest * widest * max(1, len(total)) < 1 << 63:
        return list(((n * x - np.array(total, np.int64)) ** 2).sum(axis=1))
    exact = ((x.astype(object) * n - np.array(total, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, x: array<long>), for each row and component up to `most`.

    Components are fitted on each distinct x once (a map-side aggregate, so that copies of any number are one row),
    by components(), and numbered by falling variance; the largest entry of each is positive. whitened is null, and
    explained 0, for components without variance (rows that are all equal, a single row, fewer rows than `most`
    ask for; less than 1e-8 of the largest standard deviation counts as none); vectors shorter than `most` have as
    many components as entries. deviation is null where it isn't a 64-bit number. identity_error is null without
    any variance. Ids may be null or repeat; each row has its results. No rows, or empty vectors alone, give no
    rows; vectors of several lengths raise an error. Other columns don't matter.
    """
    spark = rows.sparkSession
    fit = written(rows.select("x").distinct())
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = fit.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not sizes.high:
        return spark.createDataFrame([], schema)
    if sizes.low != sizes.high:
        raise ValueError(f"vectors have from {sizes.low} to {sizes.high} entries")
    n, total = sums(fit)
    v, e, trace = components(fit, n, total, most)
    mean, found, asked = np.array([t / n for t in total]), len(e), min(most, len(total))
    by = v / np.sqrt(e)
    error = None
    if found:
        # the whitened rows beside a column of ones, so that the Gram matrix has their sums too
        g = gram(fit, lambda x: np.column_stack(((x - mean) @ by, np.ones(len(x))))) / n
        error = float(np.abs(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) - np.eye(found)).max())
    explained = [*(e / trace if found else []), *[0.0] * (asked - found)]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = matrix(batch.column(1)), batch.num_rows
            white = np.full((m, asked), np.nan)
            white[:, :found] = (x - mean) @ by
            again = pa.array(np.repeat(np.arange(m), asked))
            columns = [
                batch.column(0).take(again), pa.array(np.tile(np.arange(1, asked + 1, dtype=np.int32), m)), pa.array(np.full(m * asked, n, np.int64)), pa.array(deviations(x, n, total), pa.int64()).take(again),
                pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())), pa.array(np.tile(explained, m)), pa.array([error] * (m * asked), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_numbers(read(spark, sf_dir, "embeddings"), "vec_id"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict[str, str] = {}
