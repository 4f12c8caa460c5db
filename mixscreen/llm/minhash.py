"""MinHash: signatures, band keys that several rows share, candidate pairs as stars or tiles, and links verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, small_side, written
from .unionfind import Forest, components

#: Rows of one key that a task sends on for matching with other tasks' rows; of more it sends one.
SENT = 64
#: Rows that one stands for in a star; members that meet in one task come from at most two chunks of about this size.
CHUNK = 512
#: Hashes of a signature that are compared at a time, in all, and the posterior probability below which a pair is dropped.
STEP, HASHES, TOLERANCE = 16, 128, 1e-4
#: Bits of a band key that hold the band's number.
BAND_BITS = 8
#: Of one permutation hashing: a bin without values. Members of a tile whose pairs are listed and looked up at once.
NONE, LISTED = np.uint32(0xFFFFFFFF), 64


def minima(values: np.ndarray, starts: np.ndarray, hashes: int, seed: int = 1) -> np.ndarray:
    """32-bit MinHash values, a row for each of the runs of values that begin at starts (none of them empty)."""
    x = (mix(values) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(seed))
    odd, add = rng.integers(0, 1 << 31, hashes, np.int64).astype(np.uint32) * 2 + 1, rng.integers(0, 1 << 32, hashes, np.int64).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    y = np.empty_like(x)
    for k in range(hashes):
        np.multiply(x, np.uint32(odd[k]), out=y)
        y += np.uint32(add[k])
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def binned(values: np.ndarray, rows: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One permutation hashing, `bins` values for each of n rows: the least of the row's 32-bit values (given in 64 bits) that fall in the bin, or NONE."""
    at = values * np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += rows * bins
    out = np.full(n * bins, NONE)
    np.minimum.at(out, at, values.astype(np.uint32))
    return out.reshape(-1, bins)


def filled(out: np.ndarray) -> np.ndarray:
    """binned() values, in which an empty bin takes over the next filled one's value, changed by the distance."""
    short = np.flatnonzero((out == NONE).any(axis=1))
    own, bins = out[short], out.shape[1]
    places = np.arange(bins, dtype=np.int32)
    at = np.where(own == NONE, np.int32(2 * bins), places)
    at = np.concatenate((at, np.where(own == NONE, np.int32(2 * bins), places + bins)), axis=1)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = (at - places).astype(np.uint32)
    taken = (np.take_along_axis(own, at % bins, axis=1) ^ away) * np.uint32(0x9E3779B1) | np.uint32(1)
    out[short] = np.where(away == 0, own, np.where(away < bins, taken, NONE))
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` values, one row for each signature; its lowest bits are the band's number."""
    if bands > 1 << BAND_BITS:
        raise ValueError(f"more than {1 << BAND_BITS} bands")
    number = np.arange(bands, dtype=np.uint64)
    key = np.broadcast_to(number + np.uint64(1), (len(signatures), bands))
    for r in range(rows):
        key = mix(key ^ signatures[:, r : bands * rows : rows])
    return (key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | number


def _sorted_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (key, id)."""
    at = np.argsort(keys)
    keys, ids = keys[at], ids[at]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))  # most keys are alone: only the others' ids are sorted
    ids[tied] = ids[tied[np.lexsort((ids[tied], keys[tied]))]]
    new[1:] |= ids[1:] != ids[:-1]
    return keys[new], ids[new]


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) that join all ids of each key. keys, ids: sorted, distinct. Every CHUNK-th id of a key stands for those up to the next, the first for these."""
    at = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), at, 0)) if len(keys) else at
    place = at - first
    up = np.where(place % CHUNK == 0, first, first + place // CHUNK * CHUNK)
    hold = place > 0
    return keys[hold], ids[up[hold]], ids[hold]


def _local(buckets: int):
    """Packs (key, id) by key range. Of a key with over SENT ids in the task, stars are made here and their first id alone is
    sent to its range, so that no task gets all rows of a key; stars are packed under a number of the task (-1 - task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        width = (1 << 64) // buckets + 1
        bounds = np.array([k * width for k in range(1, buckets)], np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            keys, ids = _sorted_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
            big = np.repeat(counts > SENT, counts)
            rows: list = []
            k2, i2 = keys[~big | new], ids[~big | new]
            cuts = np.searchsorted(k2, bounds)
            for k, (a, b) in enumerate(zip(np.split(k2, cuts), np.split(i2, cuts), strict=True)):
                if len(a):
                    rows.append((k, a.tobytes(), b.tobytes(), None))
            if big.any():
                rows.append((-1 - task, *(x.tobytes() for x in stars(keys[big], ids[big]))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bands = batch.column(1)
            keys = np.frombuffer(b"".join(bands.to_pylist()), np.uint64) if pa.types.is_binary(bands.type) else bands.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = len(keys) // batch.num_rows
            held.append((keys, np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), n)))
            size += len(held[-1][0])
            if size > 4_000_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return run


def _starred(group: pd.DataFrame) -> pd.DataFrame:
    keys, a = np.concatenate([np.frombuffer(k, np.uint64) for k in group["keys"]]), np.concatenate([np.frombuffer(k, np.int64) for k in group["a"]])
    if int(group["bucket"].iloc[0]) >= 0:
        keys, a, b = stars(*_sorted_pairs(keys, a))
    else:
        b = np.concatenate([np.frombuffer(k, np.int64) for k in group["b"]])
    return pd.DataFrame({"key": keys.view(np.int64), "a": a, "b": b})


def shared(signed: DataFrame) -> DataFrame:
    """(key, a, b), written: of each band key that several ids have, stars that join all its ids.

    signed: id long, bands array<long> or the same as binary (as many for each row; rows may repeat).
    """
    packed = signed.select("id", "bands").mapInArrow(_local(partitions(signed.sparkSession)), "bucket int, keys binary, a binary, b binary")
    return written(packed.groupBy("bucket").applyInPandas(_starred, "key long, a long, b long"))


def members(found: DataFrame) -> DataFrame:
    """(key, id), each once, of the stars."""
    return found.select("key", F.explode(F.array("a", "b")).alias("id")).distinct()


def tiles(rows: DataFrame, labelled: bool = False) -> DataFrame:
    """(tile, key, side, id, label) in which every two ids of a key meet once, in tiles of bounded size.

    rows: key, id. Ids of a key that has more than CHUNK are dealt into chunks; every chunk is a tile (of one side) and
    every two chunks are one (of two sides, between which pairs are to be looked for). Keys with the same ids have one
    tile, under that key whose band comes first. With labels (a long, for each id the same) only pairs of two labels
    need to meet: chunks are then dealt by label, and tiles of one label are left out.
    """
    if not labelled:
        rows = rows.withColumn("label", F.lit(None).cast("long"))
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = small_side(written(per.groupBy("key").agg(F.sum("n").alias("total"))))  # a read table: adaptive execution can split hot keys
    if labelled:
        large = small_side(written(per.where(F.col("n") > CHUNK // 2).withColumnRenamed("n", "own")))
        dealt = rows.join(sizes, "key").join(large, ["key", "label"], "left")
        pure = F.xxhash64("label", F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / CHUNK)))
        mixed = F.pmod(F.xxhash64("label"), F.ceil(F.col("total") / CHUNK)).cast("long")
        chunk = F.when(F.col("total") <= CHUNK, F.lit(0)).when(F.col("own").isNotNull(), pure).otherwise(mixed)
    else:
        dealt = rows.join(sizes, "key")
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / CHUNK)).cast("long")
    lists = dealt.groupBy("key", chunk.alias("chunk")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("id", "label"))).alias("ids"), F.min("label").alias("least"), F.max("label").alias("most"))
    lists = written(lists)
    alone = lists.where("least < most") if labelled else lists
    alone = alone.where(F.size("ids") > 1).groupBy("ids").agg(F.min_by("key", F.pmod("key", F.lit(1 << BAND_BITS))).alias("key"))
    alone = alone.select("key", F.xxhash64("ids", F.lit(-1)).alias("tile"), F.explode("ids").alias("x"), F.lit(0).alias("side"))
    many = lists.where(F.col("total") > CHUNK)
    other = many.select("key", F.col("chunk").alias("chunk2"), F.col("ids").alias("ids2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    cross = many.join(other, "key").where("chunk < chunk2")
    if labelled:
        cross = cross.where("least < most OR least2 < most2 OR least <> least2")
    side = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(k).alias("side")))
    cross = cross.select("key", F.xxhash64("key", "chunk", "chunk2").alias("tile"), F.explode(F.concat(side("ids", 0), side("ids2", 1))).alias("y")).select("key", "tile", "y.x", "y.side")
    return alone.unionByName(cross).select("tile", "key", "side", "x.id", "x.label")


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n matching values at which the similarity, uniform before, is at least `threshold` with probability `tolerance` or more."""
    # the posterior is Beta(m + 1, n - m + 1); its upper tail at t is P(Binomial(n + 1, t) <= m)
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


@cache
def upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b below n."""
    return np.triu_indices(n, 1)


def candidates(signatures: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) that survive: STEP values at a time, pairs go whose posterior probability falls below the tolerance."""
    n = len(signatures)
    if n <= LISTED:
        a, b = upper(n)
        found = (signatures[a, :STEP] == signatures[b, :STEP]).sum(axis=1)
        hold = found >= least_matches(STEP, threshold, tolerance)
        a, b, found = a[hold], b[hold], found[hold]
    else:
        match = np.zeros((n, n), np.int16)
        for k in range(STEP):
            match += signatures[:, k, None] == signatures[None, :, k]
        a, b = np.nonzero(np.triu(match >= least_matches(STEP, threshold, tolerance), 1))
        found = match[a, b].astype(np.int64)
    for k in range(STEP, signatures.shape[1], STEP):
        found = found + (signatures[a, k : k + STEP] == signatures[b, k : k + STEP]).sum(axis=1)
        hold = found >= least_matches(k + STEP, threshold, tolerance)
        a, b, found = a[hold], b[hold], found[hold]
    return a, b


def survives(x: np.ndarray, y: np.ndarray, threshold: float, tolerance: float) -> bool:
    """candidates() for one pair of signatures."""
    found = 0
    for k in range(0, len(x), STEP):
        found += int((x[k : k + STEP] == y[k : k + STEP]).sum())
        if found < least_matches(min(k + STEP, len(x)), threshold, tolerance):
            return False
    return True


def in_both(x: np.ndarray, y: np.ndarray) -> int:
    """The number of values that two sorted sets share."""
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    return int(np.count_nonzero(z[1:] == z[:-1]))


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair. Where pairs are many, they come from products of membership matrices, some values at a time."""
    n = len(sets)
    if len(a) <= 4 * n:
        return np.array([in_both(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    hold = counts[at] > 1  # values of one set alone are in no intersection
    rows, at = rows[hold], (np.cumsum(counts > 1) - 1)[at[hold]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    common = np.zeros((n, n), np.float64)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        x, y = np.searchsorted(at, (k, k + COLUMNS))
        member = np.zeros((n, COLUMNS), np.float32)
        member[rows[x:y], at[x:y] - k] = 1
        common += member @ member.T
    return common[a, b].astype(np.int64)


def tile_links(sides: np.ndarray, labels: np.ndarray | None, sets: list[np.ndarray], signatures: np.ndarray, bands: np.ndarray | None, key: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity), by places, of a tile's verified links.

    bands (the band keys of each member): only pairs count whose first shared key is the tile's, so that a pair that
    shares many keys counts in one tile. labels: only pairs of two labels count.
    """
    a, b = candidates(signatures, threshold, tolerance)
    sizes = np.array([len(s) for s in sets], np.int64)
    hold = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    if sides.any():
        hold &= sides[a] != sides[b]
    if labels is not None:
        hold &= labels[a] != labels[b]
    a, b = a[hold], b[hold]
    if bands is not None and len(a):
        first = np.zeros(len(a), np.int64)
        for k in range(bands.shape[1] - 1, -1, -1):
            same = bands[a, k] == bands[b, k]
            first[same] = bands[a[same], k]
        a, b = a[first == key], b[first == key]
    common = overlaps(sets, a, b)
    similarity = common / (sizes[a] + sizes[b] - common)
    hold = similarity >= threshold - 1e-12
    return a[hold], b[hold], similarity[hold]


#: Values of sets whose signatures are computed together; values that are counted together in overlaps().
TOGETHER, COLUMNS = 2_000_000, 4096
LINKS = "a long, b long, similarity double, n long"


def _batch(a, b, similarity, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, similarity, n), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["a", "b", "similarity", "n"])


def _tiled(to_sets: Callable[[list[bytes]], list[np.ndarray]], threshold: float, tolerance: float, hashes: int, mode: str):
    """Rows (tile, key, side, id, label, item, keys) in order of tile. mode: links, counts or forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> Iterator[pa.RecordBatch]:
            sets = to_sets([x[5] for rows in held for x in rows])
            signatures = minima(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])]), hashes, seed=2)
            at = 0
            for rows in held:
                part = slice(at, at + len(rows))
                at = part.stop
                ids = np.array([x[3] for x in rows], np.int64)
                labels = None if rows[0][4] is None else np.array([x[4] for x in rows], np.int64)
                bands = None if mode == "forest" else np.array([np.frombuffer(x[6], np.int64) for x in rows])
                a, b, similarity = tile_links(np.array([x[2] for x in rows]), labels, sets[part], signatures[part], bands, rows[0][1], threshold, tolerance)
                if mode == "links":
                    yield _batch(ids[a], ids[b], similarity, np.ones(len(a), np.int64))
                elif len(a):
                    forest = Forest()
                    tree = np.fromiter((forest.join(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
                    yield _batch(ids[a[tree]], ids[b[tree]], similarity[tree], np.zeros(int(tree.sum()), np.int64))
                    if mode == "counts":
                        n = np.bincount(np.concatenate((a, b)), minlength=len(ids))
                        yield _batch(ids[n > 0], pa.nulls(int((n > 0).sum()), pa.int64()), pa.nulls(int((n > 0).sum()), pa.float64()), n[n > 0])

        tile, held, size = None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != tile:
                    if size > TOGETHER:
                        yield from out(held)
                        held, size = [], 0
                    tile = row[0]
                    held.append([])
                held[-1].append(row)
                size += len(row[5]) // 8
        if held:
            yield from out(held)

    return run


def packed_sets(items: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in items]


def verified(tiled: DataFrame, items: DataFrame, threshold: float, to_sets: Callable[[list[bytes]], list[np.ndarray]] = packed_sets, tolerance: float = TOLERANCE, hashes: int = HASHES, mode: str = "links") -> DataFrame:
    """(a, b, similarity, n) from tiles. items: id, item, keys; to_sets makes sets (sorted distinct 64-bit values, not empty) of items.

    mode links: all links, each once. counts: a spanning forest of each tile's links (n = 0), and for each id (a; b is
    null) the number n of its links in a tile. forest: the spanning forest alone (`keys` is then not needed).
    """
    keys = F.lit(None).cast("binary").alias("keys") if mode == "forest" else F.col("keys")
    rows = tiled.join(items, "id").select("tile", "key", "side", "id", "label", "item", keys)
    return rows.repartition(partitions(tiled.sparkSession), "tile").sortWithinPartitions("tile", "side", "id").mapInArrow(_tiled(to_sets, threshold, tolerance, hashes, mode), LINKS)


def _compared(to_sets: Callable[[list[bytes]], list[np.ndarray]], threshold: float, tolerance: float, hashes: int):
    """Rows (a, id, item) in order of a, first its own: the links of each a with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, mine, own = None, np.zeros(0, np.uint64), None
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                sets = to_sets(part.column(2).to_pylist())
                signatures = minima(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])]), hashes, seed=2) if hashes else [None] * len(sets)
                out: tuple[list, list, list] = ([], [], [])
                for a, i, x, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets, signatures, strict=True):
                    if a == i:
                        root, mine, own = a, x, s
                        continue
                    if a != root:
                        raise ValueError(f"{a} has no item")
                    m, n = len(mine), len(x)
                    if min(m, n) < threshold * max(m, n) - 1e-9 or hashes and not survives(own, s, threshold, tolerance):
                        continue
                    common = in_both(mine, x)
                    if (similarity := common / (m + n - common)) >= threshold - 1e-12:
                        for c, v in zip(out, (a, i, similarity), strict=True):
                            c.append(v)
                yield _batch(*out, [1] * len(out[0]))

    return run


def chained(found: DataFrame, items: Callable[[DataFrame], DataFrame], threshold: float, to_sets: Callable[[list[bytes]], list[np.ndarray]] = packed_sets, tolerance: float = TOLERANCE, hashes: int = HASHES, keep: bool = False) -> DataFrame:
    """(id, root): the classes into which chains of links put ids; ids without a link are left out.

    found: stars as shared() gives them. items: gives (id, item) of a table of ids. hashes: 0 verifies every candidate
    pair, without pruning. keep: items are written, and read again when some of them are compared again. No link that joins two classes is lost, though not all are looked for: each id is compared
    with those that stand for it, which takes no more pairs than rows; what is left are keys whose ids are still in
    several classes, and there every two ids of different classes meet.
    """
    pairs = found.select("a", "b").distinct()
    wanted = written(pairs.unionAll(pairs.select("a", F.col("a").alias("b")).distinct()).withColumnRenamed("b", "id"))
    own = items(wanted.select("id").distinct())
    own = written(own) if keep else own
    rows = wanted.join(own, "id").select("a", "id", "item")
    links = rows.repartition(partitions(found.sparkSession), "a").sortWithinPartitions("a", F.col("a") != F.col("id"), "id").mapInArrow(_compared(to_sets, threshold, tolerance, hashes), LINKS)
    links = written(links.select("a", "b"))
    roots = small_side(components(links))
    named = found.join(roots.toDF("a", "label_a"), "a", "left").join(roots.toDF("b", "label_b"), "b", "left")
    named = named.select("key", "a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))
    split = written(named.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("label_a") != F.col("label_b")).alias("several")).where("several AND n > 1").select("key"))
    both = F.array(F.struct(F.col("a").alias("id"), F.col("label_a").alias("label")), F.struct(F.col("b").alias("id"), F.col("label_b").alias("label")))
    rest = written(named.join(split, "key", "left_semi").select("key", F.explode(both).alias("x")).select("key", "x.id", "x.label").distinct())
    if not rest.limit(1).count():
        return roots
    again = rest.select("id").distinct()
    again = own.join(small_side(again), "id", "left_semi") if keep else items(again)
    more = verified(tiles(rest, labelled=True), again, threshold, to_sets, tolerance, hashes or STEP, "forest").select("a", "b")
    return components(links.unionAll(written(more)))
