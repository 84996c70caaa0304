"""Connected components of an edge table: union-find inside each partition, then alternating star steps across them.

Union-find first replaces the edges of a partition by a spanning forest (at most one edge a node), so what is shuffled
shrinks to the nodes. The star steps use a grouped minimum and a join, never a collected neighbourhood, so a node with
any number of edges stays in pre-aggregated sums and in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over pairs: node to the smallest node of its tree, for nodes that aren't the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: r for x in list(parent) if (r := root(x)) != x}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            yield from zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)

    found = forest(pairs())
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], schema=schema)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most as ``u``, and none if it is the ``v`` of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("to")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("to"))
    )
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("to").alias("to")).where("out > 1 or out = 1 and to = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """edges(u, v), longs -> (node, component) for every node with an edge; component is its smallest node."""
    links = edges.select("u", "v").where("u <> v").mapInArrow(_local, "u long, v long")
    old = scratch.save_narrow(links.distinct(), "edges")
    for _ in range(limit):
        if _stars(old):
            break
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save_narrow(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        scratch.let_go(large)
        scratch.drop(old)
        old = new
    else:
        raise RuntimeError(f"no forest of stars after {limit} rounds")
    tops = old.select(F.col("v").alias("node")).distinct()
    return old.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
