"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.session import checkpointed

# Edges of a partition that are contracted together before the first round.
TOGETHER = 1 << 18


def forest(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index connected with every index below ``count`` by the pairs (u, v)."""
    root = np.arange(count)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same nodes as ``TOGETHER`` of the given ones: of every node with the smallest it reaches there."""

    def contracted():
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        root = forest(len(nodes), *ends.reshape(2, -1))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    held = []
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(h.shape[1] for h in held) >= TOGETHER:
            yield contracted()
            held = []
    if held:
        yield contracted()


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = least.select("a", F.least("a", "low").alias("low"))
    larger = both.where("b > a").join(least, "a")
    return larger.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; every edge points downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of the edges ``a``, ``b``.

    The edges of a partition are contracted by themselves first. If no more are left than are contracted together
    anyway, a last contraction gives the result; else rounds follow, in which only a count and a sum reach the driver.
    What a step makes is written to the shared checkpoint folder. Loops and nulls are ignored. An empty edge table
    gives an empty result.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges, before = checkpointed(edges.distinct().mapInArrow(_stars, "a long, b long")), None
    if edges.count() <= TOGETHER:
        edges = checkpointed(edges.coalesce(1).mapInArrow(_stars, "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, before = checkpointed(_small_star(_large_star(edges))), state
