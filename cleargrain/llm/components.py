"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage

#: Tasks over which a node's edges are dealt.
SALTS = 8


def roots_of(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to count - 1 the smallest node that the edges (x, y) join it with."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[x], root[y])
        old = root.copy()
        np.minimum.at(root, old[x], low)
        np.minimum.at(root, old[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root[x], root[y]):
            return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and, for each, the smallest node that it is joined with."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[roots_of(len(nodes), index[: len(a)], index[len(a) :])]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            nodes, roots = forest(batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64))
            keep = nodes != roots
            yield pd.DataFrame({"a": nodes[keep], "b": roots[keep]})


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """a's least neighbour m beside each of a's edges, which are dealt over SALTS tasks a node by their other end."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(spread, ["a", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _ordered(_with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable): one row per node that has an edge.

    Edges are pairs of longs; null ends, loops and repeats don't count. Each task first replaces the edges it
    holds by a forest; then rounds go on until every edge leads to its component's smallest node.
    Minima are aggregated before the shuffle, and joined back to a node's edges in SALTS tasks.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    left = cut_lineage(_ordered(pairs.mapInPandas(_forests, "a long, b long")))
    before = None
    while True:
        now = tuple(left.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
        left = cut_lineage(_small_star(_large_star(left)))
    roots = left.select(F.col("b").alias("node")).distinct()
    return left.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
