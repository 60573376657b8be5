"""Connected components of a large graph by contraction, with every step in shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes that ``edges`` (u, v) name.

    In each round every node moves to its smallest neighbour, and on to the smallest neighbour of
    that one; edges are renamed and those inside a component vanish. Neighbours are only ever
    aggregated, never gathered, and the joins are between written tables, so that adaptive execution
    can split a hub. The number of rounds grows with the logarithm of the longest chain.
    """
    ordered = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = settled(edges.where("u <> v").select(*ordered).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    found = settled(nodes.select("node", F.col("node").alias("component")), "components")
    while not edges.isEmpty():
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = settled(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "steps")
        on = step.select(F.col("u").alias("to"), F.col("to").alias("_on"))
        jump = settled(step.join(on, "to").select("u", F.col("_on").alias("to")), "jumps")
        first = edges.join(jump, "u").select(F.col("to").alias("u"), "v")
        second = first.join(jump.withColumnRenamed("u", "v"), "v").select("u", F.col("to").alias("v"))
        edges = settled(second.where("u <> v").select(*ordered).distinct(), "edges")
        moved = found.join(jump.withColumnRenamed("u", "component"), "component", "left")
        found = settled(moved.select("node", F.coalesce("to", "component").alias("component")), "components")
    return found
