"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


class Forest:
    """Union-find over integers 0 to n - 1; roots are the least members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch replaced by a spanning star of each of its components."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, index = np.unique(ends, return_inverse=True)
        forest = Forest(len(nodes))
        half = len(index) // 2
        for a, b in zip(index[:half].tolist(), index[half:].tolist()):
            forest.join(a, b)
        roots = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
        keep = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[keep]), "v": pa.array(nodes[roots[keep]])})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; ``edges`` has two long columns.

    The component is the least node. Rounds of large and small stars run until nothing
    changes, each round cut off by a stored table; no node's neighbours are gathered,
    only their minimum. The minima of large stars are stored too: both sides of that join then are
    plain shuffles, which adaptive execution splits where a node has very many edges.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v and u is not null and v is not null")
    stars = materialize(pairs.mapInArrow(_shrink, "u bigint, v bigint").distinct(), "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = materialize(small.where("u <> v").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
