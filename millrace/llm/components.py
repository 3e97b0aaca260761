"""Connected components of a graph given as an edge table, by contraction.

In each round every node points to its smallest neighbour, pointers are followed once more, and
edges are rewritten to where they point; edges inside one node disappear. Rounds grow with the
logarithm of the longest chain, every round's tables go to the shared folder, and nothing is
collected but a count of the edges left. A node with very many edges is a joined key, which
adaptive execution splits, and a partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, no null); equal roots: one component."""
    left = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        far = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = scratch.save(near.join(far, "p").select("a", F.col("pp").alias("p")))
        steps.append(step)
        to_a, to_b = step.select("a", F.col("p").alias("pa")), step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        after = scratch.save(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        scratch.drop(left)
        left = after
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    out = scratch.save(labels)
    scratch.drop(left, *steps)
    return out
