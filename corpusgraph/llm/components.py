"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, class) for every node of ``edges`` (a, b); class is the smallest node of the component.

    Rounds of contraction: each node joins the neighbour (or itself) whose hash is smallest and edges move to those nodes.
    Ordering by hash shrinks even long chains by a constant factor per round. Each round's tables lie in the shared folder.
    """
    def ends(e):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both.select("a", F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n")).alias("to"),
                           F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")).alias("own"))

    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    label = None
    while True:
        step = materialize(ends(edges).groupBy("a").agg(F.min(F.least("to", "own")).alias("m"))
                           .select(F.col("a").alias("node"), F.col("m.n").alias("root")), "roots")
        if label is None:
            label = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = materialize(label.join(moved, "root", "left")
                                .select("node", F.coalesce("next", "root").alias("root")), "labels")
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = materialize(edges.join(left, "a").join(right, "b").filter("ra <> rb")
                            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    smallest = label.groupBy("root").agg(F.min("node").alias("class"))
    return label.join(smallest, "root").select("node", "class")
