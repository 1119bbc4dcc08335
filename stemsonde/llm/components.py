"""Connected components of a table of links, without any link leaving the executors.

Each task first runs union-find over the links it holds and passes on a forest; the forests are joined by alternating
the two star steps (every neighbour of a node to its smallest neighbour: first the larger ones, then the smaller ones)
until the edges no longer change. Minima are combined before each shuffle, and the joins are ones that adaptive
execution may split, so that a node with a third of all links does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def edges():
        child = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array([find(x) for x in child], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(a), find(b)
            if a != b:
                a, b = max(a, b), min(a, b)
                parent[a] = b
                parent.setdefault(b, b)
        if len(parent) > 500_000:  # bounded memory: what was learned so far goes on
            yield edges()
            parent.clear()
    yield edges()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links: two long columns. Returns (node, component), component the smallest node reached; nodes without a link
    to another node are missing, null ends are ignored."""
    a, b = links.columns
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    edges = stored(links.mapInArrow(_forest, "u long, v long"))
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
