"""Connected components of a graph whose edges may be many and whose hubs may be hot.

Labels shrink by the least neighbour's label and by pointer jumping; both are minimum
aggregates, which combine before they shuffle. Each round is kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b); nodes without edges are absent.

    Self loops, repeated and reversed edges change nothing; an empty table gives no rows;
    edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        ends = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(ends, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # A label is a node: its own label, where smaller, is as good. Its old label is taken too, so that whole trees move.
        jump = nearer.groupBy(F.col("was").alias("component")).agg(F.min("component").alias("lower"))
        moved = nearer.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("lower", "component")).alias("component"))
        moved = durable(moved)
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
