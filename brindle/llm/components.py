"""Connected components by alternating large-star and small-star contraction, fully distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import checkpointed

ROOTS = 500_000


def _forest(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars: each node with the smallest one that they connect it to, ROOTS nodes at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    for batch in incoming:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) >= ROOTS:
            yield out()
            root.clear()
    if root:
        yield out()


def _unsettled(e: DataFrame) -> bool:
    """Whether some node hangs from two others, or from one that hangs itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(e.select("v", F.lit(0), F.lit(1)))
    g = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not g.filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Null ends and loops are left out; repeated edges count once; no edges give no rows. Each partition first makes stars
    of its own edges. The smallest neighbour of a node is found with map-side combine; the edges of a node with very
    many neighbours meet that one in a join, which adaptive execution splits. Rounds, which grow with the logarithm of
    the longest path, end as soon as every node hangs from a root.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = checkpointed(e.mapInArrow(_forest, "u long, v long").distinct())
    while _unsettled(e):
        # large star: neighbours above a node hang from its smallest neighbour
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").mapInArrow(_forest, "u long, v long").distinct()
        # small star: the node and its neighbours below hang from the smallest of these
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(low, "u")
        e = checkpointed(
            j.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).mapInArrow(_forest, "u long, v long").distinct()
        )
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
