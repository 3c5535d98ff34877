"""Hierarchies held as tables of edges: ancestors and descendants, what is under a node, what is wrong with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fixed(df: DataFrame) -> DataFrame:
    """Cut off from its history: in the folder of spark.checkpoint.dir, or in memory where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) over edges (node, parent): every ancestor once, at the length of the shortest path, from 1.

    Path doubling on what is new: in each round the paths found last are joined with all paths, so that a hierarchy of
    depth d takes about log2(d) rounds, and what is known already goes. A node on a circle has itself as an ancestor; circles end
    the rounds like anything else. Repeated edges count once; edges with a null are left out.
    """
    found = edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    found = new = _fixed(found)
    while not new.isEmpty():
        up = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        longer = new.join(up, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        down = found.select(F.col("node"), F.col("ancestor").alias("middle"), F.col("distance").alias("less"))
        lower = new.withColumnRenamed("node", "middle").join(down, "middle").select("node", "ancestor", (F.col("distance") + F.col("less")).alias("distance"))
        reached = longer.unionByName(lower).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        known = found.withColumnRenamed("distance", "known")
        new = _fixed(reached.join(known, ["node", "ancestor"], "left").where("known IS NULL OR distance < known").drop("known"))
        kept = found.join(new.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        found = _fixed(kept.unionByName(new))
    return found


def circles(closed: DataFrame) -> DataFrame:
    """(node, length) of the nodes that are their own ancestors, with the length of the shortest circle through each."""
    return closed.where("node = ancestor").select("node", F.col("distance").alias("length"))


def projected(values: DataFrame, closed: DataFrame, value: str) -> DataFrame:
    """(node, total): the sum of a value over a node and all that is below it; values (node, value), one or more rows a node."""
    own = values.groupBy("node").agg(F.sum(value).alias("total"))
    below = own.join(closed.where("node <> ancestor"), "node").select(F.col("ancestor").alias("node"), "total")
    return own.unionByName(below).groupBy("node").agg(F.sum("total").alias("total"))


def problems(nodes: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, problem) of nodes (node) and edges (node, parent): unknown nodes and parents, several parents, circles."""
    pairs = edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", "parent").distinct()
    known = nodes.select("node").distinct()
    name = lambda df, problem: df.select("node", F.lit(problem).alias("problem"))
    out = name(pairs.join(known, "node", "left_anti").distinct(), "unknown node")
    out = out.unionByName(name(pairs.join(known.toDF("parent"), "parent", "left_anti").select("node").distinct(), "unknown parent"))
    out = out.unionByName(name(pairs.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "several parents"))
    return out.unionByName(name(circles(closed), "on a circle"))
