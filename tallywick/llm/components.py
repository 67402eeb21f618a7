"""Connected components of a link table by alternating stars, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywick.session import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """For every node the least node among itself and its neighbours (partial aggregation first)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def connected_components(links: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, label): label is the least node of the component; nodes without links are absent.

    Each round hooks every node to the least node within two steps and halves the distances, so the
    number of rounds grows with the logarithm of the diameter. Each round is a table in the shared
    folder; it ends when no label changes.
    """
    edges = links.select("a", "b").filter("a != b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.save(nodes.select("node", F.col("node").alias("label")), "labels")
    for _ in range(rounds):
        at_a, at_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        across = edges.join(at_a, "a").join(at_b, "b").select("la", "lb").filter("la != lb").distinct()
        across = scratch.save(across, "across")
        if across.isEmpty():
            return labels
        hook = _least(across.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        hook = scratch.save(hook, "hook")
        # labels point to labels: follow the pointers to their ends
        while True:
            step = hook.alias("x").join(hook.select(F.col("a").alias("n"), F.col("m").alias("mm")).alias("y"), F.col("x.m") == F.col("y.n"), "left").select("x.a", F.least("x.m", F.coalesce("y.mm", "x.m")).alias("m"), F.col("x.m").alias("was"))
            step = scratch.save(step, "jump")
            hook = step.select("a", "m")
            if step.filter("m != was").isEmpty():
                break
        labels = scratch.save(labels.join(hook.select(F.col("a").alias("label"), "m"), "label", "left").select("node", F.coalesce("m", "label").alias("label")), "labels")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
