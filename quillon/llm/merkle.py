"""A Merkle manifest of a dataset: digests of all rows, a tree of threes per group, a tree over the groups, and a proof for every row.

Built bottom up: each level is a table of its own, in which up to three children of the level below have become their parent.
Proofs are pushed top down: a level's nodes meet their parents, put their own siblings before the proof that the parent has
inherited, and hand it on. Every join and grouping is by (group, place of the parent), so three rows share a key at most, however
large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common as c

WIDTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """The digest of a row: for each value ``-`` if it is null, else its length in UTF-8 bytes, a colon and the value itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings in a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with pos, their place from 0 in their group, and n, the size of the group; equal rows are ranked in any order.

    Rows are dealt by range of (group, order), so a group of any size, even one of equal rows, is spread over many tasks; the places
    of a range's first rows come from a table with one row per range and group in it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    dealt = c.saved(dealt.drop("_tie").withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()}), "dealt")
    bounds = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    bounds = bounds.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    out = c.saved(dealt.join(bounds, [group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift"), "ranked")
    c.discard(dealt)
    return out


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes (grp, pos, n, hash, ...): (grp, pos, n, hash, kids), each saved; a group ends where it has one node left."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
        below = levels[-1].where("n > 1").select("grp", F.floor(F.col("pos") / WIDTH).alias("up"), "pos", F.ceil(F.col("n") / WIDTH).alias("n"), "hash")
        up = below.groupBy("grp", F.col("up").alias("pos"), "n").agg(kids.alias("kids"))
        levels.append(c.saved(up.withColumn("hash", F.sha2(F.array_join("kids", ""), 256)), "level"))
        most = -(-most // WIDTH)
    return levels


def push(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """levels[0] with top and proof: tops (grp, top, proof) say what the last node of each group inherits."""
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].drop("kids")
        ended = own.where("n = 1").join(tops, "grp")
        if above is not None:
            parents = above.select("grp", F.col("pos").alias("up"), "kids", "top", F.col("proof").alias("rest"))
            i = F.pmod("pos", F.lit(WIDTH)).cast("int")
            step = F.struct(F.array_join(F.slice("kids", F.lit(1), i), "").alias("left"), F.array_join(F.slice("kids", i + 2, F.lit(WIDTH)), "").alias("right"))
            inner = own.where("n > 1").withColumn("up", F.floor(F.col("pos") / WIDTH)).join(parents, ["grp", "up"])
            inner = inner.withColumn("proof", F.concat(F.array(step), F.col("rest"))).drop("up", "kids", "rest")
            ended = ended.unionByName(inner)
        if k == 0:
            return ended
        above = c.saved(ended.join(levels[k].select("grp", "pos", "kids"), ["grp", "pos"]), "proofs")
    raise AssertionError("levels are never empty")


@dataclass
class Manifest:
    """proofs: a row for every row of the dataset (key, kept columns, leaf, subroot, proof); root: the digest of all, None without rows."""

    proofs: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. keep: further columns of docs to hand through, by name.

    Leaves ascend by key inside their group, null keys first, equal keys by digest; groups ascend bytewise, the null group first.
    Empty texts are values, null ones are marked as such; equal rows are leaves of their own with equal digests; an empty table has
    no proofs and no root. Only the named columns are read, so others may have any name.
    """
    keep = keep or {}
    kept = [F.struct(*(v.alias(k) for k, v in keep.items())).alias("kept")] if keep else [F.lit(None).cast("int").alias("kept")]
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, and in the order of the groups
    rows = c.saved(docs.select(F.col(key).alias("key"), grp.alias("grp"), leaf(*(F.col(x) for x in fields)).alias("hash"), *kept), "leaves")
    levels = climb(ranked(rows, "grp", ["key", "hash"]))
    c.discard(rows)
    roots = levels[0].where("n = 1").select("grp", "hash")
    for level in levels[1:]:
        roots = roots.unionByName(level.where("n = 1").select("grp", "hash"))
    over = climb(ranked(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "hash"), "grp", ["name"]))
    last = over[-1].where("n = 1").select("hash").first()
    none = F.array().cast(STEP)
    subroots = push(over, over[-1].where("n = 1").select("grp", F.col("hash").alias("top"), none.alias("proof")))
    subroots = c.saved(subroots.select(F.col("name").alias("grp"), F.col("hash").alias("top"), "proof"), "subroots")
    done = push(levels, subroots)
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).cast(docs.schema[group].dataType)
    proofs = done.select(F.col("key").alias(key), *(F.col(f"kept.{k}").alias(k) for k in keep), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "proof")
    return Manifest(proofs, subroots.select(name.alias(group), F.col("top").alias("subroot"), "proof"), last[0] if last else None)


def verified(own: Manifest, digest: Column | None = None) -> DataFrame:
    """The proofs with folded_root, from a column of digests (the leaves themselves if none is named), and whether it is the root."""
    folded = fold(F.col("leaf") if digest is None else digest, F.col("proof"))
    return own.proofs.withColumn("root", F.lit(own.root)).withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
