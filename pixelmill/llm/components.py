"""Connected components of an edge table, on DataFrames alone.

Each round every node hooks onto its least neighbour. Along a circle of such hooks every node's hook is at
most the node before it, so a circle has two nodes; the smaller one becomes the root. The trees
are closed by pointer jumping and each becomes one node of the next round's graph, until no edge is
left. A tree has at least two nodes, so n nodes take at most log2(n) rounds whatever the graph's
diameter, each with as many jumps as the logarithm of its trees' depth; there is no bound on rounds. Hooks are
minima, which Spark combines before the shuffle, so a node with very many links is no hot task; joins
on such a node are split by AQE. Nothing but one row a step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


def _trees(both: DataFrame, stored) -> DataFrame:
    """(id, root) for every node of the symmetric ``both``; each root has two nodes at least."""
    hooks = stored(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("root")), "hooks")
    beyond = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
    top = (F.col("next") == F.col("id")) & (F.col("id") < F.col("root"))
    trees = stored(hooks.join(beyond, "root").select("id", F.when(top, F.col("id")).otherwise(F.col("root")).alias("root")), "trees")
    while True:
        # two jumps at once: paths shrink to a quarter
        beyond = trees.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = trees.select(F.col("id").alias("next"), F.col("root").alias("last"))
        jumped = stored(trees.join(beyond, "root").join(after, "next").select("id", F.col("last").alias("root"), (F.col("last") != F.col("root")).alias("moved")), "trees")
        trees = jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            return trees


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (src, dst); component is the smallest id in it.

    Null ends and self loops are left out (a node with self loops alone is not returned).
    """
    with scratch(edges.sparkSession, "components") as keep:
        return stored(_components(edges, keep), "labels")


def _components(edges: DataFrame, stored) -> DataFrame:
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    both = stored(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    rounds = []
    while not both.isEmpty():
        trees = _trees(both, stored)
        rounds.append(trees)
        moved = both.join(trees.select(F.col("id").alias("src"), F.col("root").alias("from")), "src").join(trees.select(F.col("id").alias("dst"), F.col("root").alias("to")), "dst")
        both = stored(moved.where(F.col("from") != F.col("to")).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct(), "edges")
    labels = rounds.pop()
    for trees in reversed(rounds):
        later = labels.select(F.col("id").alias("root"), F.col("root").alias("last"))
        labels = stored(trees.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
