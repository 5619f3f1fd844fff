"""Connected components of a graph held as a table of links.

Links are turned into stars by alternating two steps, each one aggregation and one join: every
node links its larger neighbours to its smallest neighbour, then its smaller ones. Each round is
written to the shared folder. No task holds a component, and nothing is collected but two sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link to another; root is the smallest node reachable. a and b are longs; null links don't count."""
    links = staged(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct())
    before = None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x")).select("x.*")
        links = staged(small.where("hi <> lo").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a[k]-b[k]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
