"""Connected components by randomized contraction, in DataFrame operations.

Each round every node takes, of itself and its neighbours, the one whose hash
of this round is least; edges move to the nodes taken. The expected number of
nodes with edges falls by a constant factor per round, whatever the graph.
Rounds are written to the shared folder, so a lost executor costs one round at
most. Nodes of many edges are aggregated before the shuffle, and the joins are
plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.session import materialize


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The node that each node takes, and the edges that are left."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
    ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    taken = materialize(
        ways.groupBy("a")
        .agg(F.min(rank("b")).alias("best"))
        .select(F.col("a").alias("node"), F.least(rank("a"), "best")["v"].alias("taken")),
        "taken",
    )
    moved = (
        edges.join(taken.toDF("a", "new_a"), "a").join(taken.toDF("b", "new_b"), "b")
        .where(F.col("new_a") != F.col("new_b"))
        .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        .distinct()
    )
    return taken, materialize(moved, "edges")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for all nodes of ``edges``.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type. Edges with
    a null end are ignored; loops only name a node; repeated edges do no harm.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    label, left, turn = None, left.where(F.col("a") != F.col("b")), 0
    while not left.isEmpty():
        taken, left = _contract(left, turn)
        if label is None:
            label = taken.select("node", F.col("taken").alias("label"))
        else:
            step = taken.toDF("label", "next")
            label = materialize(
                label.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "label"
            )
        turn += 1
    if label is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = label.groupBy("label").agg(F.min("node").alias("component"))
    labelled = label.join(least, "label").select("node", "component")
    return nodes.join(labelled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
