"""Connected components of a distributed edge list.

Each partition first contracts its own edges with union-find; what is left alternates between the
large-star and small-star steps (Kiveris et al., 2014) until the edges stop changing. No node's
neighbours are ever gathered: both steps are a grouped minimum and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

EDGE = "u long, v long"


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its group, for the pairs given."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        u, v = [x for x, r in roots.items() if x != r], [r for x, r in roots.items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    edges: two long columns (u, v) without nulls. No edges: an empty result.
    """
    edges = edges.toDF("u", "v").where("u != v").mapInArrow(_contract, EDGE).distinct()
    edges = scratch.keep(edges, f"{name}-0")
    mark = None
    for i in range(1, most_rounds):
        edges = scratch.keep(_star(_star(edges, large=True), large=False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
