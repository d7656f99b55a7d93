"""Connected components of an edge table by repeated contraction to smaller neighbours.

Each round every node hooks on its smallest neighbour, hooks are followed by pointer jumping, and edges are
rewritten to the roots; edges inside a component vanish. Only aggregates with partial sums and joins are used,
so a hub with very many edges is no task of its own, and the state is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v). Returns (node, root) for each node of an edge; root is the component's smallest node.

    Self-loops and repeated edges do no harm; an empty table gives an empty table; null ends are left out.
    """
    e = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "cc-edges")
    labels = stage(e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root")), "cc-labels")
    while not e.isEmpty():
        # every root that has a smaller neighbour hooks on the smallest
        hooks = stage(e.groupBy(F.col("v").alias("a")).agg(F.min("u").alias("b")), "cc-hooks")
        while True:  # pointer jumping: chains of hooks halve in length
            nxt = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = stage(hooks.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "cc-hooks")
            hooks = jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        labels = stage(
            labels.join(hooks, labels.root == hooks.a, "left").select("node", F.coalesce("b", "root").alias("root")), "cc-labels"
        )
        hu, hv = hooks.toDF("u", "ru"), hooks.toDF("v", "rv")
        moved = e.join(hu, "u", "left").join(hv, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        e = stage(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    return labels
