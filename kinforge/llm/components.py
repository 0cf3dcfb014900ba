"""Connected components of a link table, without ever collecting it.

Nodes are ordered by a hash. Each round every node takes the first of its neighbours and itself as its
parent, links are rewritten between parents, and links that then join a node to itself go; a node that
is nobody's parent leaves the graph. In hashed order a chain has no long descending runs, so the number
of rounds grows with the logarithm of a component, whatever its ids are. At the end each component has
one node, and is named by the smallest id that led to it. Minima are pre-aggregated, and every table
that is joined was written before, so that a node with very many links is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Nulls and links of a node to itself are ignored; repeated links change nothing; no links give an
    empty table.
    """
    pair = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        parent = materialize(first.select("node", F.least(order("node"), F.col("first"))["id"].alias("parent")), "parents")
        if labels is None:
            now = parent.select("node", F.col("parent").alias("component"))
        else:
            moved = labels.join(parent, labels["component"] == parent["node"], "left")
            now = moved.select(labels["node"], F.coalesce("parent", "component").alias("component"))
        old, labels = labels, materialize(now, "labels")
        pa, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        # A hash join could not be split at a hot node; a merge join can.
        step = edges.join(pa.hint("merge"), "a").join(pb.hint("merge"), "b")
        rewritten = step.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        # A node may have been chosen as parent and have another parent itself: that link must stay.
        left, edges = edges, materialize(rewritten.union(_chained(parent)).distinct(), "links")
        for t in (left, parent, old):
            if t is not None:
                discard(t)
    discard(edges)
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    least = materialize(labels.groupBy("component").agg(F.min("node").alias("least")), "names")
    return labels.join(least.hint("merge"), "component").select("node", F.col("least").alias("component"))


def _chained(parent: DataFrame) -> DataFrame:
    """Links between a parent and its own parent where they differ."""
    chosen = parent.where("parent <> node").select(F.col("parent").alias("a")).distinct()
    return chosen.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("b")), "a").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
