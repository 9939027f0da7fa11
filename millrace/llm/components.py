"""Connected components of a link table: union-find within tasks, contraction across them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle, small


#: A task gives out what it has united when it holds more nodes than this, whatever the size of its part of the links.
MOST_NODES = 200_000


class Groups:
    """Union-find; a group is known by its smallest node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def add(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.find(a), self.find(b)
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> dict[int, int]:
        """Each node with its group's smallest."""
        return {x: self.find(x) for x in list(self.parent)}


def unite(links: DataFrame) -> DataFrame:
    """Links (a, b) of each task replaced by those of its nodes with the smallest of their group there; a group's smallest is linked with itself."""

    most = MOST_NODES

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()

        def out() -> pa.RecordBatch:
            tree = groups.roots()
            return pa.RecordBatch.from_arrays([pa.array(list(tree), pa.int64()), pa.array(list(tree.values()), pa.int64())], ["a", "b"])

        for batch in batches:
            groups.add(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(groups.parent) > most:
                yield out()
                groups.parent.clear()
        yield out()

    return links.select("a", "b").mapInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b: long): the smallest node of its component.

    Links may repeat and come in either direction. No links give an empty table. In each round a
    node goes to the smallest node among its neighbours and itself, and links between nodes that
    went to the same one vanish; a component's smallest node always stays. Nodes numbered like
    hashes, as classes are, halve at least from round to round; others may take more rounds.
    """
    steps = []
    left = settle(unite(links), "links")
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        step = settle(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up")), "labels")
        steps.append(step)
        near = small(step)
        ends = left.where(F.col("a") != F.col("b")).alias("e").join(near.alias("x"), F.col("e.a") == F.col("x.node")).join(near.alias("y"), F.col("e.b") == F.col("y.node"))
        moved = ends.select(F.col("x.up").alias("a"), F.col("y.up").alias("b")).where(F.col("a") != F.col("b")).distinct()
        left = settle(unite(moved), "links")
        if left.isEmpty():
            break
    labels = steps.pop(0)
    for step in steps:
        labels = labels.alias("s").join(small(step).alias("l"), F.col("s.up") == F.col("l.node"), "left").select("s.node", F.coalesce("l.up", "s.up").alias("up"))
    return settle(labels.select("node", F.col("up").alias("label")), "labels")
