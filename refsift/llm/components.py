"""Connected components of an edge table: hook every node to its smallest smaller neighbour, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _rooted(parent: DataFrame, space: Workspace) -> DataFrame:
    """node, parent with every parent a root: pointer jumping, which halves the longest path each time."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = space.cut(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump")
        if not jumped.where("moved").limit(1).count():
            return jumped.select("node", "parent")
        parent = jumped.select("node", "parent")


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, comp for every node that isn't the smallest of its component; comp is that smallest node.

    A node that is the smallest of its neighbourhood is a root; of the nodes of an open component at most half are, so
    the number of rounds is logarithmic. Nothing is gathered: a node of very many edges is aggregated in part first.
    """

    def plain(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    open_edges = space.cut(plain(edges), "edges")
    labels = None
    while open_edges.limit(1).count():
        parent = space.cut(open_edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parent")
        rooted = _rooted(parent, space)
        mine = rooted.select("node", F.col("parent").alias("comp"))
        if labels is None:
            labels = mine
        else:
            up = rooted.select(F.col("node").alias("comp"), F.col("parent").alias("above"))
            labels = space.cut(labels.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")).unionByName(mine), "labels")
        one = rooted.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        two = rooted.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        moved = open_edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        open_edges = space.cut(plain(moved), "edges")
    if labels is None:
        return open_edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    return labels
