"""Connected components by stars, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import written
from iocweave.operators.match import skew_join


def _linked(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a > b) moved to the least node that the node ``u`` of each knows."""
    moved = skew_join(edges, least, ["u"]).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a long, b long); root is the least node reachable.

    Two steps in turn, until nothing changes. Large star: every node links its larger neighbours to the least node that it
    knows, itself included. Small star: every node links its smaller neighbours, and itself, to the least of them. Both
    keep what is connected, and together they end with stars around the roots, after a number of rounds that grows with
    the logarithm of the largest component; there is no bound on rounds. Only minima are gathered per node, they combine
    before the exchange, and a node with very many neighbours is split at run time. Rounds are cut by tables in the
    shared folder. Edges of a node to itself, and those with a null end, say nothing and give no row.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    known = None
    while True:
        up, down = edges.select(F.col("b").alias("u"), F.col("a").alias("v")), edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = up.unionByName(down).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A node that is the least itself keeps its larger neighbours as they are.
        large = written(_linked(up, least).distinct(), "large-stars")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked(down, least).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "small-stars")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == known:
            break
        known = mark
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
