"""Connected components by contraction of edge tables.

In each round every node points at the neighbour, or itself, that comes first in an order drawn anew for the round, and
edges are rewritten by where their ends point, so a logarithmic number of rounds is enough; a star is gone in two. A
node with very many edges enters its minimum as partial minima, and joins with it are plain ones over written tables,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.storage import discard, materialise


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` of any ordered type to ``node, root``: the least node of each component of two or more.

    Edges with a null end or from a node to itself link nothing; no edges give no rows.
    """
    edges, labels, k = materialise(_ordered(edges)), None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("node"), rank("b").alias("r")).union(edges.select(F.col("b").alias("node"), rank("a").alias("r")))
        to = materialise(ends.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["v"].alias("to")))
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        after = materialise(_ordered(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        discard(edges)
        edges = after
        if labels is None:
            labels = to
        else:
            now = materialise(labels.join(to.select(F.col("node").alias("label"), F.col("to").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label")))
            discard(labels, to)
            labels = now
        labels = labels.toDF("node", "label")
        k += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = materialise(labels.groupBy("label").agg(F.min("node").alias("root")))
    return labels.join(least, "label").select("node", "root")
