"""Connected components by alternating star contraction, on Spark throughout.

Each round hangs the larger neighbours of every node, then the smaller ones, on the
least node around it (large star, small star). Minima are gathered per node by
partial aggregation. They go back to the links by a join whose sides are both dealt for it, so that
Spark can split a node with a third of all links over several tasks, as it can't where a join reuses an aggregate's dealing.
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.llm.scratch import Scratch


def forest(n: int, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indices of pairs (x, y) of n nodes that span the same components as all of them."""
    up = list(range(n))
    out = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(k)
    return out


def dealt_join(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Joins rows with an aggregate of them, dealing both anew, so that Spark can split the rows of a hot key."""
    dealt = F.xxhash64(*keys).alias("__h")
    return rows.select("*", dealt).join(sums.select("*", dealt), ["__h", *keys]).drop("__h")


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over links (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = dealt_join(both, least, ["u"])
    if large:  # larger neighbours hang on the minimum; smaller ones do so from their own side
        found = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # every neighbour is smaller here, and the node itself hangs on the minimum too
        found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.filter("a > b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its smallest node.

    Links may repeat, stand either way round or join a node to itself; null ends link nothing.
    Nodes without a link to another are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b and a is not null and b is not null").distinct()
    edges, before, done, n = scratch.save(edges, f"{name}-0"), None, [], 0
    while True:
        n += 1
        edges = scratch.save(stars(stars(edges, True), False), f"{name}-{n}")
        done.append(f"{name}-{n - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(*done)
        done = []
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
