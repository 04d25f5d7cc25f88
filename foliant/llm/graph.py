"""Connected components of a graph of links, by contraction.

Each round every node points to its smallest neighbour, links are redrawn between
the nodes pointed to, and links within a node vanish. Every node but a local
minimum merges, so a round at least halves the nodes that still have links. Nothing
is collected; rounds cut lineage with tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that a link touches; component is the smallest
    node reachable. Nulls and loops are left out."""
    links = links.select(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b")).where("a <> b").distinct()
    label, last, labels = None, Shelf(), Shelf()
    links = last.put(links, "links")
    for _ in range(rounds):
        now, named = Shelf(), Shelf()
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        to = now.put(to, "up")
        if label is None:
            label = to.select("node", F.col("up").alias("component"))
        else:
            nxt = to.select(F.col("node").alias("component"), "up")
            label = label.join(nxt, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = named.put(label, "label")
        labels.clear()
        labels = named
        links = (
            links.join(to.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b"))
            .distinct()
        )
        links = now.put(links, "links")
        last.clear()
        last = now
        if links.isEmpty():
            last.clear()
            return label
    raise RuntimeError(f"components did not end within {rounds} rounds")


class LocalUnion:
    """Union-find over the links that one task meets; roots are smallest members."""

    def __init__(self):
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

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x < y:
            x, y = y, x
        self.up[x] = y
        self.up.setdefault(y, y)
        return True

    def pairs(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
