"""Ends and distances of pointer trees by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.session import Scratch

#: Nodes that one task resolves once the rest is spliced out.
REMAINDER = 200_000


def _coin(node: str, turn: int) -> Column:
    return F.xxhash64("tree", node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def _resolved(nodes: DataFrame) -> DataFrame:
    """(tree, node, end, steps) of a bounded number of nodes, walked in one task."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {}
        for f in frames:
            at |= {(t, n): (to, s, e) for t, n, to, s, e in zip(*(f[c].tolist() for c in ("tree", "node", "to", "steps", "ends")), strict=True)}
        for tree, node in list(at):
            path = []
            while not at[tree, node][2]:
                path.append(node)
                node = at[tree, node][0]
            end, far, _ = at[tree, node]
            for before in reversed(path):
                far += at[tree, before][1]
                at[tree, before] = (end, far, True)
        keys = list(at)
        if keys:
            yield pd.DataFrame({"tree": [t for t, _ in keys], "node": [n for _, n in keys], "end": [at[k][0] for k in keys], "steps": [at[k][1] for k in keys]})

    kinds = dict(nodes.dtypes)
    return nodes.coalesce(1).mapInPandas(walk, f"tree {kinds['tree']}, node {kinds['node']}, end {kinds['node']}, steps long")


def ends_of(nodes: DataFrame, scratch: Scratch, most: int = REMAINDER) -> DataFrame:
    """(tree, node, end, steps): where the pointers of (tree, node, to) lead, and in how many steps.

    A node without `to` is an end; pointers have no cycles and stay in their tree. tree and node are not
    null and together unique. Each round splices out nodes that nothing points to, and, by a coin that
    all tasks toss alike, nodes whose next one stays: those that pointed to them point on to it. A
    constant share goes, so all rounds together move a multiple of the nodes. What is left when no more
    than `most` remain is walked in one task, and the spliced nodes follow in reverse, each round with
    one join.
    """
    nodes = scratch.save(nodes.select("tree", "node", "to"), "nodes")
    roots = nodes.filter("to is null").select("tree", "node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps"))
    is_end = roots.select("tree", F.col("node").alias("to"), F.lit(True).alias("end"))
    active = nodes.filter("to is not null").join(is_end, ["tree", "to"], "left")
    active = scratch.save(active.select("tree", "node", "to", F.lit(1).cast("long").alias("steps"), F.col("end").isNotNull().alias("ends")), "active")
    spliced: list[DataFrame] = []
    while active.count() > most:
        turn = len(spliced)
        pointed = active.filter("not ends").select("tree", F.col("to").alias("node"), F.lit(True).alias("pointed")).distinct()
        rows = active.join(pointed, ["tree", "node"], "left").withColumn("leaf", F.col("pointed").isNull())
        rows = rows.withColumn("out", ~F.col("leaf") & _coin("node", turn) & (F.col("ends") | ~_coin("to", turn)))
        rows = scratch.save(rows.drop("pointed"), "tossed")
        over = rows.filter("out").select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("ends").alias("next_ends"))
        moved = rows.join(over, ["tree", "to"], "left").select(
            "tree", "node", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("next_ends", "ends").alias("ends"), (F.col("leaf") | F.col("out")).alias("gone")
        )
        moved = scratch.save(moved, "round")
        spliced.append(moved.filter("gone").drop("gone"))
        active = moved.filter("not gone").drop("gone")
    known = roots.unionByName(scratch.save(_resolved(active), "resolved"))
    for rows in reversed(spliced):
        at = known.select("tree", F.col("node").alias("to"), "end", F.col("steps").alias("more"))
        found = rows.join(at, ["tree", "to"]).select("tree", "node", "end", (F.col("steps") + F.col("more")).alias("steps"))
        known = known.unionByName(scratch.save(found, "expanded"))
    return known
