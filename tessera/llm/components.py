"""Connected components of a link table, with nothing but joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, forget, in_tasks, join_hot

def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    Alternates large-star and small-star steps until every edge points from a
    component's smallest node to a member. A step hands each node only the
    minimum of its neighbours, and those of hubs are told where they are, so a
    hub's neighbours are never gathered, and links stay distributed. Every round is checkpointed and the round before
    removed: lost executors cost one round. Self-links and links with a null end
    are ignored; repeated links count once; no links give an empty table.

    Each node's least neighbour is checkpointed, too: it tells whether a round was
    the last, and has the result then. From the first count on a stage has as many
    tasks as its rows ask for: plans, exchanges and tasks cost the driver memory.
    """
    ends = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    edges = checkpointed(ends.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct())
    n = None  # ends of edges; not known before the first count, and never more than there
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        near = checkpointed(in_tasks(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n))
        # In a forest of stars a node with a smaller neighbour has no other one.
        (seen,) = near.agg(F.max((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("deeper"), F.sum("n").alias("ends"), F.max("n").alias("most")).collect()
        n = seen["ends"] or 0
        least = in_tasks(near, n).withColumn("m", F.least("m", "u"))
        if not seen["deeper"]:
            forget(edges)
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = join_hot(in_tasks(both, n), least, "u", "n", n, seen["most"]).filter("v > u").select(F.col("m").alias("u"), "v")
        large = in_tasks(in_tasks(large, n).distinct(), n)
        low = in_tasks(large.groupBy("v").agg(F.min("u").alias("m")), n)
        moved = large.join(low, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        before, edges = edges, checkpointed(in_tasks(moved.unionByName(low.select(F.col("m").alias("u"), "v")).distinct(), n))
        forget(before, near)
