"""Connected components: forests within bounded partitions, then stars that are rehung by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, stored

#: Links that one task joins at most (in memory, about 100 bytes each).
LINKS_PER_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, the smallest node that the links of this partition reach) for each node of theirs."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = []
            for v in (a, b):
                parent.setdefault(v, v)
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                ends.append(v)
            parent[max(ends)] = min(ends)
    nodes = sorted(parent)
    for v in nodes:  # parents are smaller, and so already at their roots
        parent[v] = parent[parent[v]]
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(some, np.int64)), pa.array(np.array([parent[v] for v in some], np.int64))], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for each node of links (columns a and b, longs).

    Links are dealt to as many tasks as LINKS_PER_TASK asks for, and each task reduces its own to a
    forest of stars. If one task holds them all, that is the result. Else rounds of large stars and small stars hang
    nodes on the least of their neighbours, until each node hangs on a root; rounds grow with the logarithm of the
    nodes. Nodes of many links are joined apart from the rest. Rounds are written tables in the shared
    checkpoint folder, and nothing but counts comes to the driver. No links give no rows.
    """
    links = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    stars = links.repartition(tasks).mapInArrow(_forest, "a long, b long")
    if tasks == 1:
        return cut(stars.select(F.col("a").alias("node"), F.col("b").alias("component")))
    edges = stored(stars.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = cut(stars.select(F.col("a").alias("node")).distinct())
    while True:
        # each node's greater neighbours are hung on the least of all its neighbours, then its lesser ones
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_hung(both.where("u < v"), both))
        edges = stored(_hung(edges, edges).union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        roots = edges.select(F.col("v").alias("u")).distinct()
        if not edges.join(roots, "u", "left_semi").limit(1).count() and not edges.groupBy("u").count().where("count > 1").limit(1).count():
            return cut(nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component")))


def _hung(edges: DataFrame, around: DataFrame) -> DataFrame:
    """(v, least of u and its neighbours `around`) for each of the edges (u, v), without loops."""
    least = around.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return hot_join(edges, least, ["u"], F.col("v"), "inner").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
