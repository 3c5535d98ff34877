"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, root) refined by edges (a, b) between nodes: afterwards linked nodes have the same, smallest root.

    Each round hooks every root to the smallest root that an edge leads to, follows these hooks to their ends by
    doubling, and relabels; the number of rounds is logarithmic in the size of a component. All state is in tables.
    """
    labels, edges = c.saved(labels.select("node", "root"), "labels"), c.saved(edges.select("a", "b"), "edges")
    while True:
        ends = edges.join(labels.toDF("a", "ra"), "a").join(labels.toDF("b", "rb"), "b").where("ra <> rb")
        hooks = c.saved(ends.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to")), "hooks")
        if hooks.isEmpty():
            c.discard(edges, hooks)
            return labels
        while True:
            further = hooks.toDF("to", "end")
            longer = hooks.join(further, "to")
            if longer.isEmpty():
                break
            before, hooks = hooks, c.saved(hooks.join(further, "to", "left").select("root", F.coalesce("end", "to").alias("to")), "hooks")
            c.discard(before)
        before, labels = labels, c.saved(labels.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        c.discard(before, hooks)
