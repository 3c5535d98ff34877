import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals


def made(seed, n, longest):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(3000)
        out.append((r.choice([1, 1, 1, 2, None]), i, a, a + r.choice([0, 1, 2, 5, 16, 17, 40, 256, 257, longest])))
    return [*out, (1, n, None, 5), (1, n + 1, 7, None), (2, n + 2, 9, 3), (1, n + 3, -40, 12)]


LEFT, RIGHT = made(1, 150, 900), made(2, 120, 5000)


@pytest.fixture(scope="module")
def tables(spark):
    left = spark.createDataFrame(LEFT, "doc long, l long, ls int, le int")
    return left, spark.createDataFrame(RIGHT, "doc long, r long, rs int, re int").withColumn("text", F.lit("x"))


def brute(within):
    out = []
    for d, i, a, b in LEFT:
        for e, j, x, y in RIGHT:
            if None in (d, e, a, b, x, y) or d != e or a >= b or x >= y:
                continue
            if x <= a and b <= y if within else a < y and x < b:
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("within", [False, True])
def test_pairs(tables, within):
    got = intervals.overlapping(*tables, ["doc"], ("ls", "le"), ("rs", "re"), within)
    assert sorted((r.l, r.r) for r in got.collect()) == brute(within) and len(brute(within)) > 100


@pytest.mark.parametrize("within", [False, True])
def test_semi_and_anti(tables, within):
    left, right = tables
    twice = left.unionByName(left.limit(20))
    hit = {i for i, _ in brute(within)}
    for anti in (False, True):
        got = intervals.touched(twice, right.withColumnRenamed("r", "l"), ["doc"], ("ls", "le"), ("rs", "re"), within, anti)
        want = [r.l for r in twice.collect() if (r.l in hit) != anti]
        assert sorted(r.l for r in got.collect()) == sorted(want)


def test_points(spark, tables):
    points = [(1, 5), (1, 2999), (2, 100), (None, 3), (1, 10**9), (1, None), (1, 5)]
    got = intervals.located(spark.createDataFrame(points, "doc long, at long"), tables[1].drop("text"), ["doc"], "at", ("rs", "re"))
    want = []
    for d, at in points:
        own = [j for e, j, x, y in RIGHT if None not in (d, at, e, x, y) and e == d and x <= at < y]
        want += [(d, at, j) for j in own] or [(d, at, None)]
    assert sorted(((r.doc, r.at, r.r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables_and_clashes(spark, tables):
    left, right = tables
    assert intervals.overlapping(left.limit(0), right, ["doc"], ("ls", "le"), ("rs", "re")).collect() == []
    assert intervals.touched(left, right.limit(0), ["doc"], ("ls", "le"), ("rs", "re"), anti=True).count() == len(LEFT)
    with pytest.raises(ValueError, match="both tables"):
        intervals.overlapping(left, left, ["doc"], ("ls", "le"), ("ls", "le"))


def test_a_span_over_everything_and_many_short_ones(spark):
    words = spark.range(20_000).select(F.lit(1).alias("doc"), (F.col("id") * 5).alias("a"), (F.col("id") * 5 + 4).alias("b"))
    whole = spark.createDataFrame([(1, 0, 100_000), (1, 50_000, 50_010)], "doc int, c long, d long")
    out = intervals.overlapping(words, whole, ["doc"], ("a", "b"), ("c", "d"))
    assert out.count() == 20_000 + 2
    dealt = intervals._dealt(words, ("a", "b"), "l", [0, 4])
    assert dealt.count() <= 4 * 20_000
