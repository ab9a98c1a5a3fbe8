"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originflow.llm.common import Staged


class LocalSets:
    """Union-find over the rows of one batch; ``roots`` gives the current root of every row."""

    def __init__(self, n: int):
        import numpy as np
        self.np, self.parent = np, np.arange(n)

    def link(self, a, b) -> None:
        parent = self.parent
        for x, y in zip(a.tolist(), b.tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y

    def roots(self):
        while True:
            up = self.parent[self.parent]
            if self.np.array_equal(up, self.parent):
                return self.parent
            self.parent = up


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: the smallest node that each linked node can reach.

    Alternating large-star and small-star rounds: a node's links move to its smallest neighbour until every node hangs on
    its root. A round is two aggregates (combined before the shuffle, so a hub sends one row per task) and two joins; the
    number of links never grows and the rounds are about the logarithm of the longest path. Each round is written to the
    shared folder and the one before deleted. Self links and null ends are ignored; both orders and repeats are allowed.
    """
    now = Staged(links.filter(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    seen = None
    while True:
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.df.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = tuple(mark)
        both = now.df.union(now.df.select("u", "v"))  # (node, neighbour)
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter(F.col("u") > F.col("v")).join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        mid = Staged(large, "links")  # here u < v again
        low = mid.df.groupBy("v").agg(F.min("u").alias("m"))
        small = mid.df.join(low, "v")
        nxt = small.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v != u").union(low.select("v", F.col("m"))).distinct()
        old, now = now, Staged(nxt, "links")
        old.drop()
        mid.drop()
