"""Joins of tables of spans: overlap, containment and points, without comparing all spans of a document.

A span has a class by its length, up to 16, 256, 4096 ... positions. Two spans meet at the class of the longer one, in bins as wide as
that class: a span is dealt, for its own class and every longer one that the other table has, to the two bins at most that it touches
there. A pair counts in the first bin that both touch. So a table is multiplied by twice the number of classes at most, whatever the
lengths, and rows that share a bin are near each other on the scale of the longer one. Bins of one document are dealt to many tasks.

Null keys and null ends never match; a span whose end isn't behind its start touches nothing. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 16
Span = tuple[str, str]
SPAN: Span = ("start_char", "end_char")


def _class(size: Column) -> Column:
    """0 for up to BASE positions, 1 for up to BASE squared, and so on; by comparison, as logarithms aren't exact."""
    out = F.lit(15)
    for i in reversed(range(15)):
        out = F.when(size <= BASE ** (i + 1), i).otherwise(out)
    return out


def _classes(df: DataFrame, span: Span) -> list[int]:
    """The classes that occur, 16 at most."""
    size = F.col(span[1]) - F.col(span[0])
    return sorted(r[0] for r in df.where(size > 0).select(_class(size).alias("c")).distinct().collect())


def _dealt(df: DataFrame, span: Span, side: str, other: list[int]) -> DataFrame:
    """df with its class, and for each bin that it is dealt to the level, the bin and the first bin of that level."""
    start, end = (F.col(x).cast("long") for x in span)
    own = _class(end - start)
    width = lambda level: F.lit(BASE).cast("long") ** (level + 1)
    levels = F.filter(F.array(*(F.when((own == c) & F.lit(any(x <= c for x in other)), F.lit(c)).when((own < c) & F.lit(c in other), F.lit(c)) for c in range(16))), lambda x: x.isNotNull())
    out = df.where(end > start).withColumn(f"_{side}class", own).withColumn("_level", F.explode(levels)).withColumn("_width", width(F.col("_level")).cast("long"))
    out = out.withColumn(f"_{side}first", F.floor(start / F.col("_width")))
    return out.withColumn("_bin", F.explode(F.sequence(F.col(f"_{side}first"), F.floor((end - 1) / F.col("_width"))))).drop("_width")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: Span = SPAN, right_span: Span = SPAN, within: bool = False) -> DataFrame:
    """Every pair of a left and a right row with equal keys whose spans share a position; with ``within``, whose left span lies in the right one.

    The tables' other columns need different names. The driver learns which classes of length occur, nothing else.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    a = _dealt(left, left_span, "l", _classes(right, right_span))
    b = _dealt(right, right_span, "r", _classes(left, left_span))
    ls, le, rs, re = (F.col(x) for x in (*left_span, *right_span))
    touch = (rs <= ls) & (le <= re) if within else (ls < re) & (rs < le)
    once = (F.col("_level") == F.greatest("_lclass", "_rclass")) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    pairs = a.join(b, [*keys, "_level", "_bin"]).where(touch & once)
    return pairs.select(*keys, *(x for x in left.columns if x not in keys), *(x for x in right.columns if x not in keys))


def _same(left: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    named = hits.select(*(F.col(x).alias(f"_hit{i}") for i, x in enumerate(left.columns))).distinct()
    on = F.lit(True)
    for i, x in enumerate(left.columns):
        on &= F.col(x).eqNullSafe(F.col(f"_hit{i}"))
    return left.join(named, on, how)


def touched(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: Span = SPAN, right_span: Span = SPAN, within: bool = False, anti: bool = False) -> DataFrame:
    """The left rows that have a partner in ``overlapping``; with ``anti``, those that have none. Other columns of right are ignored."""
    places = right.select(*keys, F.col(right_span[0]).alias("_rs"), F.col(right_span[1]).alias("_re"))
    hits = overlapping(left, places, keys, left_span, ("_rs", "_re"), within).select(left.columns)
    return _same(left, hits, "left_anti" if anti else "left_semi")


def located(points: DataFrame, right: DataFrame, keys: Sequence[str], point: str, right_span: Span = SPAN) -> DataFrame:
    """Every point with the right rows whose span holds it; a point that none holds stays once, with nulls."""
    spans = points.withColumns({"_at": F.col(point), "_behind": F.col(point) + 1})
    hits = overlapping(spans, right, keys, ("_at", "_behind"), right_span, within=True).drop("_at", "_behind")
    return hits.unionByName(_same(points, hits.select(points.columns), "left_anti"), allowMissingColumns=True)
