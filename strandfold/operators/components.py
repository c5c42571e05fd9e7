"""Connected components by contraction: every round joins each node to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.durable import durable

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the least node reachable.

    Works on any orderable id type. Nodes hook onto their least neighbour, two pointer jumps
    shorten the trees, edges are rewritten to the trees' roots and made distinct, and the
    rounds end when no edge between different roots is left, which takes about the logarithm
    of the diameter. Nothing is collected but one emptiness test a round. Null ends and
    self-loops link nothing, though the node of a self-loop is returned.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = edges.where("a <> b")
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            return labels
        hook = (
            live.select(F.col("b").alias("node"), F.col("a").alias("up"))
            .groupBy("node")
            .agg(F.min("up").alias("up"))
        )
        for _ in range(2):  # the least node of a tree hooks onto nothing, so a missing parent is the root
            up = hook.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            hook = (
                hook.join(up, hook["up"] == up["mid"], "left")
                .select("node", F.coalesce("top", "up").alias("up"))
            )
        hook = durable(hook, "hook")
        labels = durable(
            labels.join(hook.withColumnRenamed("node", "component"), "component", "left")
            .select("node", F.coalesce("up", "component").alias("component")),
            "labels",
        )
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = live.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")
        )
        live = durable(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "live"
        )
    raise RuntimeError("connected_components did not settle; the graph's diameter is out of reach")
