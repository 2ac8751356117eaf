"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowmill.llm.common import checkpointed


class Forest:
    """Union-find over any keys, for use inside one task."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def stars(self) -> tuple[list, list]:
        """Every node that has been joined, but for roots, with its root: the same edges wherever the same nodes are known to be connected."""
        nodes = [x for x in self.parent if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]

    def join(self, a, b) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that an edge touches.

    Each round lets a node point to its smallest neighbour, follows the
    pointers to their ends, and puts the ends in place of the nodes of all
    edges. Rounds at least halve the nodes that still have edges, and the
    tables only ever hold edges between different nodes.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a") != F.col("b"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = checkpointed(pairs.distinct().select(ways.alias("way")).select("way.a", "way.b"))
    rounds = []
    while not links.isEmpty():
        up = checkpointed(links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        moved = True
        while moved:
            # Three steps at once: a pointer to an end of an end of an end.
            ahead = up
            for _ in range(3):
                ahead = ahead.join(_onward(up), "root").select("node", F.col("top").alias("root"))
            ahead = checkpointed(ahead.join(_onward(up), "root").select("node", "root", (F.col("top") != F.col("root")).alias("moved")))
            moved = not ahead.where("moved").isEmpty()
            up = ahead.drop("moved")
        rounds.append(up)
        ends = up.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        others = up.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        links = checkpointed(links.join(ends, "a").join(others, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    known = rounds[0]
    for up in rounds[1:]:
        known = known.join(_onward(up), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return checkpointed(known)


def _onward(up: DataFrame) -> DataFrame:
    return up.select(F.col("node").alias("root"), F.col("root").alias("top"))
