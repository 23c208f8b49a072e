"""Groups of a sorted partition, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import scratch


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """The runs of equal values of column `key` in a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    name: object = None
    for batch in batches:
        values = batch.column(key).to_pylist()
        lo = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[lo]:
                if held and name != values[lo]:
                    yield name, pa.Table.from_batches(held)
                    held = []
                name = values[lo]
                held.append(batch.slice(lo, i - lo))
                lo = i
    if held:
        yield name, pa.Table.from_batches(held)


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two trees so far: at most n - 1 of them connect the same points as all."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root for each end of an edge (columns a, b): root is the least node of its component.

    Alternating large-star and small-star steps: each replaces every node's links by links to the least
    neighbour, until nothing changes; the number of rounds grows with the logarithm of the longest path. Each
    step is written to the shared folder. Minima are pre-aggregated, and a hub's links are split by the skew
    join, since both sides of the join are read from tables.
    """
    spark = edges.sparkSession

    def star(links: DataFrame, large: bool) -> DataFrame:
        near = links.union(links.select("b", "a")).toDF("u", "v") if large else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = scratch.keep(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
        moved = near.join(least, "u")
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = scratch.keep(out.where("a <> b").distinct(), f"{name}-links")
        scratch.drop(spark, least, links)  # what comes later reads the new table only
        return out

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")
    now, before = state(links), None
    while now[0] and now != before:
        links, before = star(star(links, True), False), now
        now = state(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
