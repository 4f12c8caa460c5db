"""Connected components: union-find inside each partition, then star contraction between partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Links that a task joins in the second pass, whose tasks are as many as the links ask for.
LINKS = 500_000


class Forest:
    """Union-find over any hashable nodes; the smallest node of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star forest of the partition's links, given out whenever it has a million nodes, so memory stays bounded."""

    def stars(forest: Forest) -> pa.RecordBatch:
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["u", "v"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield stars(forest)
            forest = Forest()
    if forest.up:
        yield stars(forest)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of each node that has a link to another node; root is the component's smallest id.

    Links are joined where they are, and the forests that come of it once more, LINKS of them in a task. If that is one
    task, its forest is the result; else rounds follow. Each round first gives the larger neighbours of a node the smallest one of its neighbourhood (large star), then
    its smaller ones (small star). Rounds are logarithmic in the longest path; links go to a written table after each.
    The smallest neighbours are written too: a join of two read tables is one whose hot keys (a large component's
    root) adaptive execution splits. Null ends and links of a node with itself are left out; repeated links change
    nothing; no links give no rows.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    edges = written(links.mapInArrow(_local, "u long, v long").distinct())
    tasks = 1 + edges.count() // LINKS
    edges, before = written(edges.coalesce(tasks).mapInArrow(_local, "u long, v long")), None
    if tasks == 1:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        down = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = written(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
