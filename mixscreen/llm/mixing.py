"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate, chain, islice
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read, small_side, unused, written

#: Documents in a block.
BLOCK = 8
#: Rows of one source that are ranked together; such buckets whose sizes are summed up together.
RANKED, SUMMED = 512, 4096
#: Times RANKED rows beyond which a bucket is searched for equal rows; blocks whose slots make a row; such rows (8 kB at most) that may be broadcast.
CROWDED, CHUNK, CHUNKS = 8, 1024, 2000
#: Target weights of the query; other sources have weight 1.
WEIGHTS = {"src0": 6, "src1": 2.5, "src2": 0.5}


def shares(weights: Mapping, period: int) -> dict:
    """Slots of each key in a period, by largest remainders, at least one each; they add up to the period."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    while (left := period - sum(out.values())) > 0:
        for s in order[:left]:
            out[s] += 1
    while sum(out.values()) > period:
        out[max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], str(s)))] -= 1
    return out


def exact_shares(weights: Mapping) -> dict:
    """Slots of each key in the shortest period in which all have whole numbers of slots. Floats count as the decimals that they print as."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    whole = lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * whole) for s, x in exact.items()}
    common = gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def runs(share: Mapping, left: Mapping, slot: int = 0) -> tuple[list, list]:
    """(sources as (key, share, blocks) in the order in which they end, runs as (first segment, end, first slot, slots of a segment, sources that have ended)).

    Segment i holds the blocks n*i to n*(i+1)-1 of each key of share n, as far as it has them. At a segment's begin every
    key that still has blocks has had exactly its due, so segments can be scheduled apart. Those of a run are alike: a run
    ends where the segment begins in which a key ends, and that segment is a run of its own.
    """
    ends = sorted(((s, n, left[s]) for s, n in share.items() if left[s]), key=lambda x: (Fraction(x[2], x[1]), str(x[0])))
    points = sorted({0, *(e for _, n, m in ends for e in (m // n, -(-m // n)))})
    k, done, rate, begins = 0, 0, sum(n for _, n, _ in ends), []
    for p in points:
        while k < len(ends) and ends[k][2] <= p * ends[k][1]:
            done, rate, k = done + ends[k][2], rate - ends[k][1], k + 1
        begins.append((slot + done + p * rate, k))
    return ends, [(p, q, t, (u - t) // (q - p), k) for p, q, (t, k), (u, _) in zip(points, points[1:], begins, begins[1:], strict=False)]


def segment(active: list[tuple[str, int, int]]) -> Iterator[int]:
    """The place in `active` of each slot's source. active: (name, share, blocks that it has, at most its share).

    Served as a fluid, a source of share n has had j blocks when t = sum(min(share * j/n, blocks)) slots of all sources have passed:
    those that have ended take nothing, the others keep their proportions. Block j is released at floor(t(j/n)) and due at
    ceil(t((j+1)/n)); of the released blocks the earliest deadline goes first, ties by name. As the fluid meets all
    windows, so does this, and no slot stays empty.
    """
    short = sorted(((m, n) for _, n, m in active if m < n), key=lambda x: Fraction(*x))
    at = [m / n for m, n in short]
    ended, rate = [0, *accumulate(m for m, _ in short)], list(accumulate((-n for _, n in short), initial=sum(n for _, n, _ in active)))

    def passed(j: int, n: int) -> tuple[int, int]:
        """t(j/n), rounded down and up."""
        i = bisect_right(at, j / n)
        while i and short[i - 1][0] * n > j * short[i - 1][1]:
            i -= 1
        while i < len(short) and short[i][0] * n <= j * short[i][1]:
            i += 1
        return ended[i] + j * rate[i] // n, ended[i] - (-j * rate[i] // n)

    waiting = [(0, passed(1, n)[1], name, k) for k, (name, n, _) in enumerate(active)]  # a source's next block: release, deadline
    ready: list = []
    done = [0] * len(active)
    heapq.heapify(waiting)
    for t in range(sum(m for _, _, m in active)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, name, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("missed a deadline")
        yield k
        done[k] += 1
        if done[k] < active[k][2]:
            heapq.heappush(waiting, (passed(done[k], active[k][1])[0], passed(done[k] + 1, active[k][1])[1], name, k))


class Plan:
    """Runs of segments of all sources; those of weight 0 have runs of their own after all others. It grows with the number of sources alone."""

    def __init__(self, blocks: Mapping, weights: Mapping, period: int | None = None) -> None:
        some = {s: weights[s] for s, n in blocks.items() if n and weights[s] > 0}
        share = (shares(some, period) if period else exact_shares(some)) if some else {}
        none = {s: 1 for s, n in blocks.items() if n and not weights[s] > 0}
        self.groups = [runs(share, blocks), runs(none, blocks, sum(blocks[s] for s in share))]
        self.firsts = [[r[0] for r in own] for _, own in self.groups]
        self.share = {s: (g, n) for g, x in enumerate((share, none)) for s, n in x.items()}

    def count(self) -> int:
        return sum(len(own) for _, own in self.groups)

    def scheduled(self, run: int) -> Iterator[tuple]:
        """(source, run, chunk, slots) of the blocks of a run's first segment, CHUNK blocks of a source in a chunk, slots from 0."""
        g = int(run >= len(self.groups[0][1]))
        ends, own = self.groups[g]
        p, _, _, _, gone = own[run - g * len(self.groups[0][1])]
        active = [(str(s), n, min(n, m - n * p)) for s, n, m in ends[gone:]]
        held, made = [[] for _ in active], [0] * len(active)
        for t, k in enumerate(segment(active)):
            held[k].append(t)
            if len(held[k]) == CHUNK:
                yield active[k][0], run, made[k], held[k]
                held[k], made[k] = [], made[k] + 1
        for k, x in enumerate(held):
            if x:
                yield active[k][0], run, made[k], x

    def chunks(self, source: str, first: int, last: int) -> list[tuple[int, int]]:
        """(run, chunk) of all that block_slots() asks for."""
        g, n = self.share[source]
        own, base = self.groups[g][1], g * len(self.groups[0][1])
        out, r = [], bisect_right(self.firsts[g], first // n) - 1
        while True:
            p, q = own[r][:2]
            lo, hi = max(first, p * n), min(last, q * n - 1)
            x, y = lo % n // CHUNK, hi % n // CHUNK
            if hi - lo + 1 >= n or lo % n > hi % n:  # around a segment's end
                all_of = range((n - 1) // CHUNK + 1)
                wanted = all_of if hi - lo + 1 >= n else sorted({*range(x, len(all_of)), *range(y + 1)})
            else:
                wanted = range(x, y + 1)
            out += [(base + r, c) for c in wanted]
            if q * n > last:
                return out
            r += 1

    def block_slots(self, source: str, first: int, last: int, chunks: Mapping) -> list[int]:
        """Slots of a source's blocks first to last. chunks: of each (run, chunk) its slots."""
        g, n = self.share[source]
        own, base, r, out = self.groups[g][1], g * len(self.groups[0][1]), 0, []
        for k in range(first, last + 1):
            i, j = divmod(k, n)
            if not out or i >= own[r][1]:
                r = bisect_right(self.firsts[g], i) - 1
            p, _, slot, length, _ = own[r]
            out.append(slot + (i - p) * length + chunks[base + r, j // CHUNK][j % CHUNK])
        return out


def _ties_apart(rows: DataFrame, s: str, b: str, h: str, x: str, ranked: int) -> DataFrame:
    """rows with x: 0, or for rows that more than `ranked` others equal a number from 1 that about `ranked` rows of one bucket have."""
    sizes = written(rows.groupBy(s, b).agg(F.count("*").alias("n")))
    crowded = sizes.where(F.col("n") > CROWDED * ranked).select(s, b)
    if not crowded.limit(1).count():
        return rows.withColumn(x, F.lit(0).cast("long"))
    equal = rows.select(s, b, h).join(small_side(crowded), [s, b], "left_semi").groupBy(s, b, h).agg(F.count("*").alias("n"))
    equal = small_side(written(equal.where(F.col("n") > ranked).select(s, b, h)))
    # written with their numbers, so that these stay the same however often rows are read
    tied = written(rows.join(equal, [s, b, h], "left_semi").withColumn(x, 1 + F.floor(F.monotonically_increasing_id() / ranked)))
    rest = rows.join(equal, [s, b, h], "left_anti").withColumn(x, F.lit(0).cast("long"))
    return rest.unionByName(tied)


def mix_sources(docs: DataFrame, weights: Mapping | None = None, block: int = BLOCK, period: int | None = None, ranked: int = RANKED) -> DataFrame:
    """docs with mix_source, mix_block, mix_slot, mix_position: sort by mix_position to read the sources in their target proportions.

    weights has the target weight of each source (default, and for sources it lacks: 1; 0: after all others; negative:
    ValueError). A source's documents are put in the order of a hash of doc_id and the other columns (maps and variants
    don't count) and cut into blocks (the last may be short); rows that hundreds of others equal come last among their
    neighbours. At every slot, no source is a whole block ahead of or behind its share: its weight's part of all slots as
    long as all sources have blocks, and of those that the others leave as sources end (see segment()). Weights are
    exact, unless a `period` is given: they are then rounded to multiples of 1/period, at least one each (for up to
    `period` sources). No row is dropped or repeated. A null source is a source of its own; null ids are ids. Rows that
    are equal in all columns keep any order among themselves. Columns that are named as the added ones are replaced,
    others stay. No rows give no rows.

    Ranks within a source come from counts by (source, hash bucket) of about `ranked` rows, summed up in two levels;
    rows that many others equal are numbered in written tables, so neither a source of any size nor rows that repeat are
    in one task. The driver holds a few numbers for each source. Tasks schedule one segment (as many slots as the
    weights' smallest whole multiples add up to) of each run of equal segments, holding a block of each source at a
    time, and write its slots in chunks, which buckets join. Weights of so many digits that a segment has as many slots
    as there are blocks make this one task, still of bounded memory.
    """
    spark = docs.sparkSession
    s, h, b, r, k, start, slots, x = (unused(c, docs.columns) for c in ("source_", "hash_", "bucket_", "rank_", "block_", "start_", "slots_", "tie_"))
    source = F.coalesce("source", F.lit("\0null"))
    sizes = {c[0]: c[1] for c in docs.groupBy(source.alias("s")).count().collect()}
    want = {c: (weights or {}).get(None if c == "\0null" else c, 1) for c in sizes}
    if any(w < 0 for w in want.values()):
        raise ValueError("negative weight")
    if period and len(sizes) > period:
        raise ValueError(f"more sources than slots in a period of {period}")
    plan = spark.sparkContext.broadcast(Plan({c: -(-n // block) for c, n in sizes.items()}, want, period))
    buckets = max(1, -(-max(sizes.values(), default=1) // ranked))
    ends = lambda first, n: (first // block, (first + n - 1) // block)

    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = chain.from_iterable(map(plan.value.scheduled, batch.column(0).to_pylist()))
            while some := list(islice(rows, 512)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["s", "run", "chunk", "own"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [plan.value.chunks(c, *ends(first, n)) for c, first, n in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True)]
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), [len(w) for w in wanted])))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([c[i] for w in wanted for c in w], pa.int64()) for i in (0, 1))], ["s", "b", "x", "start", "n", "run", "chunk"])

    def with_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [plan.value.block_slots(c, *ends(first, n), {(p["run"], p["chunk"]): p["own"] for p in parts}) for c, first, n, parts in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.list_(pa.int64()))], [s, b, x, start, slots])

    n_runs = plan.value.count()
    scheduled = written(spark.range(0, n_runs, 1, max(1, min(n_runs, 4 * partitions(spark)))).mapInArrow(schedule, "s string, run long, chunk long, own array<bigint>"))
    hashed = [f.name for f in docs.schema if f.name != "doc_id" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.withColumns({s: source, h: F.xxhash64("doc_id", *hashed)}).withColumn(b, F.floor((F.col(h) / 2.0**64 + 0.5) * buckets).cast("int"))
    rows = _ties_apart(rows, s, b, h, x, ranked)
    counts = written(rows.groupBy(F.col(s).alias("s"), F.col(b).alias("b"), F.col(x).alias("x")).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("b") / SUMMED)))
    before = lambda by, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("s", "part").agg(F.sum("n").alias("n")).select("s", "part", before(["s"], "part").alias("first"))
    starts = counts.join(small_side(written(parts)), ["s", "part"]).select("s", "b", "x", (F.col("first") + before(["s", "part"], "b", "x")).alias("start"), "n")
    wanted = starts.mapInArrow(asked, "s string, b int, x long, start long, n long, run long, chunk long")
    found = written(wanted).join(small_side(scheduled, CHUNKS), ["s", "run", "chunk"]).groupBy("s", "b", "x", "start", "n").agg(F.collect_list(F.struct("run", "chunk", "own")).alias("parts"))
    starts = found.mapInArrow(with_slots, f"{s} string, {b} int, {x} long, {start} long, {slots} array<bigint>")
    rank = F.row_number().over(Window.partitionBy(s, b, x).orderBy(h, "doc_id"))
    rows = rows.withColumn(r, rank).join(starts, [s, b, x]).withColumn(r, F.col(start) + F.col(r) - 1).withColumn(k, F.floor(F.col(r) / block).cast("long"))
    slot = F.get(slots, (F.col(k) - F.floor(F.col(start) / block)).cast("int"))
    added = {"mix_source": F.col("source"), "mix_block": F.col(k), "mix_slot": slot, "mix_position": slot * block + F.col(r) % block}
    return rows.select(*[c for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


QUERIES = {"op1_pfair_mix": op1_pfair_mix}
ORACLE: dict[str, str] = {}
