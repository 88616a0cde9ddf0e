"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """Ties what is around a node to the smallest id there: larger neighbours, or smaller ones and itself."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.save(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    near = near.where("b > a") if large else near.unionByName(near.select("a", F.col("a").alias("b")))
    tied = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task; the smallest id of a component is its root."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(top, ids), pa.int64())], ["id", "component"])


#: So many edges are joined up in one task; more by joins.
FEW = 200_000


def components(scratch: Scratch, edges: DataFrame, limit: int = 40, few: int = FEW) -> DataFrame:
    """(id, component) for each id in an edge (a, b); component is the smallest id reachable.

    More than ``few`` edges alternate the large-star and small-star steps until they are stars; the
    number of rounds grows with the logarithm of the ids. Raises if ``limit`` rounds don't do.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = _mark(edges)
    if last[0] <= few:
        return scratch.save(edges.coalesce(1).mapInArrow(_joined, "id long, component long"))
    for _ in range(limit):
        edges = scratch.save(_star(scratch, scratch.save(_star(scratch, edges, True)), False))
        now = _mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return scratch.save(ids.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))
