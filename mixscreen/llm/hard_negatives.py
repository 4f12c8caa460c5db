"""Hard negatives by certified search in an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read, whole_numbers, written

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Vectors that the codebooks are fitted on, most codewords of a half, rounds of fitting.
SAMPLE, WORDS, ROUNDS = 16_384, 256, 8
#: Vectors of a block, queries of a chunk, requests that are passed on at a time (and so many more as the chunk that passes it has), rows that the first round of a search visits for a query, and by how much each further round goes on.
BLOCK, CHUNK, ASKED, FIRST, GROWTH = 2048, 256, 4096, 4096, 8
#: Bytes of lists that are broadcast to the anchors; more are shuffled.
LISTED = 16 << 20
#: A number over that of any cell's parts.
PARTS = 1 << 31
QUERY = "gid long, label long, x array<long>, w array<int>, low array<long>, high array<long>, kth array<long>"


def vectors(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else flat.reshape(len(column), 0)


def packed(x: np.ndarray) -> bytes:
    """The entries as the smallest of the integer types that holds them all."""
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(t).max)).tobytes()


def unpacked(data: pa.Buffer, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * d)}").reshape(n, d).astype(np.int64) if n * d else np.zeros((n, d), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, as 64-bit numbers; an error where one might be none."""
    most = int(np.abs(a.astype(object)).max(initial=0)) * int(np.abs(b.astype(object)).max(initial=0)) * a.shape[1] if a.size and b.size and max(-int(a.min()), int(a.max()), -int(b.min()), int(b.max())) >= 1 << 20 else a.shape[1] << 40
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("inner products may pass 64 bits")
    return a @ b.T


def codebook(sample: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a half of the sampled vectors, by Lloyd's rounds from the first distinct ones; a centre without vectors stays where it is."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(first)[:words]].astype(float)
    for _ in range(rounds):
        own, _ = nearest(sample, centres)
        for k in np.unique(own):
            centres[k] = sample[own == k].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and a bound of the distance to it."""
    x = x.astype(float)
    own = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1)) * (1 + 1e-12)


class Cells:
    """The codebooks of the two halves, and of each cell its number of vectors and the radii of its halves."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books, self.half = books, books[0].shape[1]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, da), (b, db) = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        return a * len(self.books[1]) + b, da, db

    def measure(self, stats: list) -> None:
        shape = len(self.books[0]), len(self.books[1])
        self.n, self.radius = np.zeros(shape, np.int64), [np.zeros(shape), np.zeros(shape)]
        for r in stats:
            at = divmod(r.cell, shape[1])
            self.n[at], self.radius[0][at], self.radius[1][at] = r.n, r.first, r.second

    def visit(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, after: int, upto: int) -> tuple[list[int], bool]:
        """(cells to compare with x, whether more may be needed) after the cells of the first `after` vectors, up to those of `upto`.

        Cells come in falling order of the sum of their halves' bounds, each the product with a codeword plus the
        length of x's half times the largest radius of the codeword's vectors: a heap of pairs of places in the two
        sorted lists of half-scores. It ends as soon as that bound is below the lowest score that any window still
        takes; of the cells on the way, those whose own bounds meet no window are left out.
        """
        halves = x[: self.half].astype(float), x[self.half :].astype(float)
        dots = [book @ h for book, h in zip(self.books, halves, strict=True)]
        length = [math.sqrt(float(h @ h)) for h in halves]
        slack = 1e-9 * (1 + sum(n * (math.sqrt((book * book).sum(axis=1).max(initial=0)) + r.max(initial=0)) for n, book, r in zip(length, self.books, self.radius, strict=True)))
        upper = [dots[0] + length[0] * self.radius[0].max(axis=1), dots[1] + length[1] * self.radius[1].max(axis=0)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        (u, v), (first, second) = (own[o].tolist() for own, o in zip(upper, order, strict=True)), (o.tolist() for o in order)
        need, width = float(low.min()) - slack, len(second)
        own_upper = dots[0][:, None] + dots[1][None, :] + length[0] * self.radius[0] + length[1] * self.radius[1] + slack
        own_lower = dots[0][:, None] + dots[1][None, :] - length[0] * self.radius[0] - length[1] * self.radius[1] - slack
        meets = ((own_upper[..., None] >= low) & (own_lower[..., None] <= high)).any(axis=-1) & (self.n > 0)
        heap, seen, out = [(-(u[0] + v[0]), 0, 0)], 0, []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < need:
                return out, False
            if seen >= upto:
                return out, True
            if j + 1 < width:
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            a, b = first[i], second[j]
            if seen >= after and meets[a, b]:
                out.append(a * width + b)
            seen += int(self.n[a, b])
        return out, False


def _placed(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, first, second = cells.place(vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(first), pa.array(second)], ["label", "x", "ids", "cell", "first", "second"])

    return run


def _blocks(buckets: int):
    """Rows (cell and part as one number, ids, label, x), sorted by it and first id, as blocks of at most BLOCK vectors of a part of a cell, each in one of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, BLOCK):
            cell, part = divmod(key, PARTS)
            ids = rows.column(1)
            values = *(np.ascontiguousarray(c).tobytes() for c in (ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), rows.column(2).to_numpy())), packed(vectors(rows.column(3)))
            columns = [pa.array([k], pa.int32()) for k in ((cell + part) % buckets, cell)] + [pa.array([v], pa.binary()) for v in values]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "cell", "ids", "sizes", "labels", "xs"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(cell, rows) of up to `most` rows that follow each other and have one cell."""
    held: list[pa.RecordBatch] = []
    at, n = None, 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        cells = batch.column(0).to_numpy()
        ends = [*np.flatnonzero(np.diff(cells)) + 1, len(cells)] if len(cells) else []
        start = 0
        for end in ends:
            while start < end:
                if at is not None and (cells[start] != at or n == most):
                    yield at, whole()
                    held, n = [], 0
                at = int(cells[start])
                take = min(end - start, most - n)
                held.append(batch.slice(start, take))
                start, n = start + take, n + take
    if held:
        yield at, whole()


def _visits(cells: Cells, part: pa.RecordBatch, after: int, upto: int) -> Iterator[tuple[list[int], bool]]:
    """Cells.visit() of each row of QUERY."""
    xs = vectors(part.column(2))
    for k in range(part.num_rows):
        low, high, kth = (np.array(part.column(c)[k].as_py(), object) for c in (4, 5, 6))
        least = np.array([x if y is None else max(x, y) for x, y in zip(low, kth, strict=True)], float)
        yield cells.visit(xs[k], least, high.astype(float), after, upto)


def _open(cells: Broadcast, after: int, upto: int):
    """Rows of QUERY to the gids of those that may need more cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [m for _, m in _visits(cells.value, batch, after, upto)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(more, pa.bool_()))], ["gid"])

    return run


def _asked(cells: Broadcast, buckets: int, after: int, upto: int):
    """Rows of QUERY as chunks (to, cells, queries, own): for each bucket that holds a part of a cell to visit, up to CHUNK queries with the cells that each of them visits there, and all of these.

    So a query is sent once to a bucket, not once to a cell.
    """

    def deal(part: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
        visited = [np.array(c, np.int64) for c, _ in _visits(cells.value, part, after, upto)]
        query, cell = np.repeat(np.arange(len(visited)), [len(c) for c in visited]), np.concatenate(visited)
        parts = np.minimum(-(-cells.value.n.ravel()[cell] // BLOCK), buckets)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        query, cell = np.repeat(query, parts), np.repeat(cell, parts)
        bucket = (cell + nth) % buckets
        order = np.lexsort((cell, query, bucket))
        query, cell, bucket = query[order], cell[order], bucket[order]
        xs = vectors(part.column(2))
        for own in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []:
            asks, starts = np.unique(query[own], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)), pa.int32()), pa.array(cell[own]))
            rows = part.drop_columns(["x"]).take(pa.array(asks))
            sink = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "cells"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield len(asks), int(bucket[own[0]]), [np.unique(cell[own]).tolist(), sink.getvalue().to_pybytes(), packed(xs[asks])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for at in range(0, batch.num_rows, CHUNK):
                last = at + CHUNK >= batch.num_rows
                for asks, bucket, values in deal(batch.slice(at, CHUNK)):
                    held.append((bucket, *values))
                    n += asks
                    if n >= ASKED:
                        yield passed(held)
                        held, n = [], 0
                if last and held:
                    yield passed(held)

    def passed(held: list) -> pa.RecordBatch:
        kinds = pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), kinds, strict=True)], ["to", "cells", "queries", "own"])

    return run


def _scored(same: bool, k: int, d: int):
    """Joined chunks and blocks of a bucket to (gid, w, score, id): for each query that visits the block's cell, and window, the best k vectors' ids in the block that can still count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for r in range(batch.num_rows):
                if data is None or not batch.column(0)[r].as_buffer().equals(data):  # a chunk meets all blocks of its bucket, one after another
                    data = batch.column(0)[r].as_buffer()
                    chunk = pa.ipc.open_stream(data).read_next_batch()
                    visits = chunk.column(6)
                    of_visit, visits = np.repeat(np.arange(len(visits)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
                    chunk_xs = unpacked(batch.column(1)[r].as_buffer(), chunk.num_rows, d)
                here = of_visit[visits == batch.column(2)[r].as_py()]
                queries = chunk.take(pa.array(here))
                ids, sizes, labels = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64 if c != 4 else np.int32) for c in (3, 4, 5))
                n = len(sizes)
                scores = products(chunk_xs[here], unpacked(batch.column(6)[r].as_buffer(), n, d))
                fits = (queries.column(1).to_numpy()[:, None] == labels[None, :]) == same
                starts = np.concatenate(([0], np.cumsum(sizes)))
                # of each query and window, one row
                sizes_w = np.diff(queries.column(2).offsets.to_numpy())
                of = np.repeat(np.arange(len(sizes_w)), sizes_w)
                w, low, high = (queries.column(c).flatten().to_numpy() for c in (2, 3, 4))
                kth = queries.column(5).flatten()
                low = np.maximum(low, kth.fill_null(-(1 << 63)).to_numpy())
                for at in range(0, len(of), CHUNK):
                    part = slice(at, at + CHUNK)
                    own = scores[of[part]]
                    ok = fits[of[part]] & (own >= low[part, None]) & (own <= high[part, None])
                    rows, places = np.nonzero(ok)
                    value = own[rows, places]
                    order = np.lexsort((places, -value, rows))
                    rows, places, value = rows[order], places[order], value[order]
                    begin = np.searchsorted(rows, np.arange(ok.shape[0]))
                    kept = np.arange(len(rows)) - begin[rows] < k
                    rows, places, value = rows[kept], places[kept], value[kept]
                    if len(rows):
                        many = sizes[places]
                        each = np.repeat(np.arange(len(rows)), many)
                        which = np.repeat(starts[places] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                        gid = queries.column(0).to_numpy()[of[part]][rows]
                        yield pa.RecordBatch.from_arrays([pa.array(gid[each]), pa.array(w[part][rows][each]), pa.array(value[each]), pa.array(ids[which])], ["gid", "w", "score", "id"])

    return run


class Index:
    """An inverted multi-index of rows (label, x, ids: the smallest ids of each label and vector), as blocks of its cells."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, words: int | None = None) -> None:
        self.spark = rows.sparkSession
        self.total = rows.count()
        share = min(1.0, 1.2 * sample / max(1, self.total))
        key = F.pmod(F.xxhash64("x", "label"), F.lit(1 << 30))
        few = rows.where(key < int(share * (1 << 30))).select("x", key.alias("k")).orderBy("k", "x").limit(sample).collect()
        x = np.array([r.x for r in few], np.int64).reshape(len(few), -1)
        self.d, self.buckets = x.shape[1], 2 * partitions(self.spark)
        words = words or max(1, min(WORDS, round(self.total**0.25)))
        half = x.shape[1] // 2
        cells = Cells([codebook(x[:, :half], words), codebook(x[:, half:], words)])
        placed = written(rows.select("label", "x", "ids").mapInArrow(_placed(cells), "label long, x array<long>, ids array<long>, cell int, first double, second double"))
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.max("second").alias("second"))
        found = stats.collect()  # at most WORDS squared cells
        cells.measure(found)
        self.cells = self.spark.sparkContext.broadcast(cells)
        # large cells are dealt out in parts of about a block
        parts = F.broadcast(self.spark.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in found], "cell int, parts long"))
        dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
        dealt = dealt.repartition(partitions(self.spark), "cell", "part").select((F.col("cell").cast("long") * PARTS + F.col("part")).alias("key"), "ids", "label", "x")
        dealt = dealt.sortWithinPartitions("key", F.col("ids")[0])
        self.blocks = written(dealt.mapInArrow(_blocks(self.buckets), "bucket int, cell int, ids binary, sizes binary, labels binary, xs binary"))

    def search(self, queries: DataFrame, same: bool, k: int, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
        """(gid, w, score, id): for each query (gid, label, x, w, low, high: arrays of its windows) and window the k best ids of rows of the same label, or of others, by inner product with x; ties by smaller id.

        Round by round each query visits the next cells of its order, `growth` times as many rows as before; a query
        whose windows are certified, because no cell left can reach their scores or their k-th best, goes no further.
        Chunks of queries meet the blocks of a bucket in a join; what a task makes of them is cut to the k best by a
        group limit before it is shuffled. Joins are merge joins: Spark takes a chunk for as small as its query's row,
        and would broadcast all of them by way of the driver.
        """
        n, after, upto = partitions(self.spark), 0, first
        found = None
        last = Window.partitionBy("gid", "w").orderBy(F.desc("score"), "id")
        rest = queries.withColumn("kth", F.transform("w", lambda _: F.lit(None).cast("long")))
        while True:
            asked = rest.repartition(n, "gid").mapInArrow(_asked(self.cells, self.buckets, after, upto), "to int, cells array<int>, queries binary, own binary")
            met = asked.join(self.blocks.hint("merge"), F.expr("to = bucket AND array_contains(cells, cell)"))
            new = met.select("queries", "own", "cell", "ids", "sizes", "labels", "xs").mapInArrow(_scored(same, k, self.d), "gid long, w int, score long, id long")
            both = new if found is None else new.unionByName(found)
            found = written(both.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).drop("r"))
            if upto >= self.total:
                return found
            more = written(rest.repartition(n, "gid").mapInArrow(_open(self.cells, after, upto), "gid long"))
            if more.isEmpty():
                return found
            full = found.groupBy("gid", "w").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
            full = full.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("of"))
            rest = rest.drop("kth").join(more.hint("merge"), "gid", "left_semi").join(full.hint("merge"), "gid", "left")
            rest = written(rest.select(*queries.columns, F.transform("w", lambda w: F.try_element_at("of", w)).alias("kth")))
            after, upto = upto, upto * growth


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """(label, x, ids) with the smallest `most` distinct ids of rows (vec_id, label, x): more of the same label and vector can be in no list of `most`."""
    order = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    kept = rows.distinct().withColumn("r", order).where(F.col("r") <= most)
    return kept.groupBy("label", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE, words: int | None = None, first: int = FIRST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, x: array<long>).

    A score is the exact inner product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's
    positives are its first `positives` other rows of its label (all, if fewer); a positive's negatives the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score, low
    and high from 0 to 100: none for negative positive_scores. Searches in the index are exact: see Index.search.

    Rows with a null in any column take no part; rows that repeat all three columns count once. Of rows with equal
    label and vector only the smallest ids that lists can hold are indexed, and anchors with equal label and vector
    are searched for once, so that copies of any number cost little. Rows that repeat a vec_id with another vector or
    label are rows of their own, and an anchor's own row is that with its vec_id, label and vector. No rows, or
    anchors alone in a table without other labels, give no rows; vectors of several lengths raise an error.
    Other columns don't matter.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x").dropna()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    held = written(smallest(rows, max(positives + 1, negatives)))
    anchors = written(rows.where(is_anchor).distinct())
    sizes = held.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if sizes.high is None:
        return rows.sparkSession.createDataFrame([], schema)
    if sizes.low != sizes.high:
        raise ValueError(f"vectors have from {sizes.low} to {sizes.high} entries")
    index = Index(held, sample, words)
    groups = written(anchors.select("label", "x").distinct().withColumn("gid", F.monotonically_increasing_id()))
    no_bound = F.array(F.lit(0)).alias("w"), F.array(F.lit(-(1 << 62))).alias("low"), F.array(F.lit(1 << 62)).alias("high")
    near = index.search(groups.select("gid", "label", "x", *no_bound), True, positives + 1, first)

    # a window for each score of a positive: its bounds in whole numbers, for scores from 0
    windows = near.where("score >= 0").select("gid", "score").distinct().withColumn("w", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("score"))))
    windows = windows.withColumns({"low": F.expr(f"({low} * score + 99) div 100"), "high": F.expr(f"({high} * score) div 100")}).where("low <= high")
    windows = written(windows)
    listed = windows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("of")).select("gid", *[F.col(f"of.{c}").alias(c) for c in ("w", "low", "high")])
    far = index.search(written(groups.join(listed.hint("merge"), "gid").select("gid", "label", "x", "w", "low", "high")), False, negatives, first)

    # a row for each group of anchors, with its lists
    found = far.join(windows.select("gid", "w", F.col("score").alias("positive_score")).hint("merge"), ["gid", "w"])
    lists = found.groupBy("gid", "positive_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "id"))).alias("negatives"))
    lists = lists.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "negatives"))).alias("negatives"))
    lists = near.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "id"))).alias("positives")).join(lists.hint("merge"), "gid")
    lists = written(groups.join(lists.hint("merge"), "gid").select("label", "x", "positives", "negatives"))
    most = max(1, LISTED // (8 * (sizes.high + 5 * (positives + 1) * (negatives + 1))))
    lists = F.broadcast(lists) if lists.limit(most + 1).count() <= most else lists.hint("merge")
    out = anchors.join(lists, ["label", "x"]).withColumn("p", F.explode(F.slice(F.filter("positives", lambda p: p["id"] != F.col("vec_id")), 1, positives)))
    out = out.select("vec_id", "p", F.posexplode(F.try_element_at("negatives", -F.col("p.n"))))
    return out.select(F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("negative_id"), (-F.col("p.n")).alias("positive_score"), (-F.col("col.n")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_numbers(read(spark, sf_dir, "embeddings"), "vec_id", own.alias("label")), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {
    "op13_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id OR a.label <> b.label WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
    """
}
