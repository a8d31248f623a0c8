"""Connected components by distributed union-find.

Each partition of the edges is reduced to a spanning forest by a local union-find, the forests
are merged hierarchically (ever fewer partitions), and once what is left fits the stated bound
one last union-find gives the roots. If the forests stay larger than the bound, alternating
large-star and small-star rounds finish the work without ever gathering a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize

#: Edges one task may hold in its union-find (16 bytes each, about ten times that in Python).
TASK_EDGES = 1_000_000
FAN_IN = 8


class Forest:
    """Union-find over integers whose root is always the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def frame(self) -> pd.DataFrame:
        """Every member with its root, roots themselves left out."""
        rows = [(x, r) for x in self.up if (r := self.find(x)) != x]
        return pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)


def _forest(batches: Iterator[pd.DataFrame], bound: int | None) -> Iterator[pd.DataFrame]:
    """Spanning forest of a partition; one that outgrows ``bound`` nodes is given out and begun
    anew, so what comes out may still have to be merged. Without a bound it is final."""
    f = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            f.join(a, b)
        if bound is not None and len(f.up) > bound:  # the rest of this partition starts a new forest
            yield f.frame()
            f = Forest()
    yield f.frame()


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (a, b: bigint); root is the smallest
    node of the component.

    Null ends and self-loops carry no link and are dropped; repeated edges count once; no edges
    give no rows. A task holds one forest of about ``task_edges`` nodes, the last one a forest of
    at most ``task_edges`` edges, whatever their nodes.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _forest(batches, task_edges)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _forest(batches, None)

    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    forest = materialize(pairs.mapInPandas(local, "a long, b long"), "forest")
    n, parts = forest.count(), max(1, forest.rdd.getNumPartitions())
    while n > task_edges:
        parts = max(1, parts // FAN_IN, n // task_edges)
        # by the member, of which a partition has at most one row a forest: the root of a giant component would be one key
        merged = materialize(forest.repartition(parts, F.col("a")).mapInPandas(local, "a long, b long"), "forest")
        m = merged.count()
        forest = merged
        if m > 0.8 * n:
            return _stars(forest)
        n = m
    roots = materialize(forest.coalesce(1).mapInPandas(final, "a long, b long"), "roots") if n else forest
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b"), F.col("b")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until every edge points at its component's smallest node."""
    last = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
