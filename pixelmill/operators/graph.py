"""Connected components of edge tables, by stars that grow and shrink in turns.

In a round each node first hands its smallest neighbour to all larger ones (large stars), then all smaller ones to each other's smallest (small stars).
Every component ends as one star around its smallest node; the number of rounds grows with the logarithm of its size. Each round is
written and read again. A node with very many edges is one row a task before the shuffle, and a join that AQE may split after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, settled


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()  # every node points at a smaller one now
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of ``edges`` (u, v, of one type that can be ordered); a component is named by its smallest node.

    Null ends are left out; a node that has only an edge to itself is a component of its own.
    """
    rows = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")
    with scratch(edges.sparkSession, "stars") as keep:
        rows = keep(rows)
        now = keep(rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        while True:
            before, now = now, keep(_round(now))
            if now.join(before, ["u", "v"], "left_anti").isEmpty() and before.join(now, ["u", "v"], "left_anti").isEmpty():
                break
        nodes = rows.select(F.col("u").alias("id")).unionByName(rows.select(F.col("v").alias("id"))).distinct()
        found = nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
        return settled(found.select("id", F.coalesce("component", "id").alias("component")))
