import numpy as np
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import cluster, terms


def plain(x, keys, k, seed, first, turns=5, rounds=20):
    """The same draws and rounds on one array of whole numbers."""
    dist = lambda c: (((x[:, None, :] - c[None]) ** 2).sum(2)).astype(object)
    c = np.array([first])
    for turn in range(turns):
        d = dist(c).min(1)
        cost = sum(d)
        if not cost:
            break
        lot = cluster.draw(seed, turn, keys)
        take = [int(u) * cost < 2 * k * int(v) * cluster.DRAWS for u, v in zip(lot, d, strict=True)]
        c = np.unique(np.vstack([c, x[take]]), axis=0)
    near = dist(c).argmin(1)
    c = cluster.reduced(c.astype(float), np.bincount(near, minlength=len(c)).astype(float), k, seed).astype(np.int64)
    for _ in range(rounds):
        near = dist(c).argmin(1)
        new = np.array([np.rint(x[near == i].mean(0)) if (near == i).any() else c[i] for i in range(len(c))]).astype(np.int64)
        if (new == c).all():
            break
        c = new
    return c, sum(dist(c).min(1))


def vectors(spark, n=300, groups=6, dims=8):
    r = np.random.default_rng(2)
    x = r.normal(size=(groups, dims))[np.arange(n) % groups] + 0.1 * r.normal(size=(n, dims))
    x = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * cluster.UNIT).astype(np.int64)
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<int>")


def test_equals_the_plain_version_under_any_partitioning(spark):
    x, df = vectors(spark)
    first = df.orderBy(F.xxhash64(F.lit(3), F.col("id"))).first().v
    want, cost = plain(x, list(range(len(x))), 6, 3, first)
    for parts in (1, 5):
        got = cluster.fit(df.repartition(parts), 6, "id", seed=3)
        assert (got.centres == want).all() and got.costs[-1] == cost
        assert got.costs == sorted(got.costs, reverse=True)
    near = {r.id: r.cluster for r in cluster.assigned(df, got.centres, "id").collect()}
    assert len({near[i] for i in range(6)}) == 6 and all(near[i] == near[i % 6] for i in near)


def test_edges(spark):
    _, df = vectors(spark, 1)
    assert cluster.fit(df.limit(0), 3, "id") is None
    same = spark.createDataFrame([(i, [cluster.UNIT, 0]) for i in range(9)] + [(None, [0, 0])], "id long, v array<int>")
    got = cluster.fit(same, 4, "id")
    assert sorted(map(tuple, got.centres.tolist())) == [(0, 0), (cluster.UNIT, 0)] and got.costs[-1] == 0
    weighted = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 4.0), (2, "b", 2.0), (3, "c", 1.0)], "id long, term string, weight double").withColumns({"h": F.lit(1), "v": F.lit(2)})
    rows = {r.id: r.v for r in cluster.hashed(weighted, "id", 16).collect()}
    assert rows[1] == rows[2] != rows[3] and sum(map(abs, rows[3])) == cluster.UNIT
    near = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    best = cluster.suggestions(weighted, near, 1, "id").orderBy("cluster").collect()
    assert [tuple(r) for r in best] == [(0, 1, "a", 2, 6.0), (1, 1, "c", 1, 1.0)]


def test_documents(spark):
    rows = catalog.category_suggestions(spark, "/root/testdata/sf0.001").collect()
    assert {r["rank"] for r in rows} <= set(range(1, 11)) and len({r.cluster for r in rows}) == 8
    assert len({(r.cluster, r.term) for r in rows}) == len(rows)


def test_suggestions_from_lists_equal_those_from_rows(spark):
    r = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["a", "b", "c", "é", "dd", *map(str, range(20))], 12))) for i in range(60)] + [(60, None)], "id long, text string").repartition(5)
    weighted, listed = terms.weights(terms.counts(docs, "id"), 61, "id"), terms.listed(docs, 61, "id")
    rows = cluster.hashed(weighted, "id", 16)
    assert sorted(map(tuple, cluster.hashed_lists(listed, "id", 16).collect())) == sorted(map(tuple, rows.collect()))
    centres = np.array([x.v for x in rows.orderBy("id").limit(3).collect()], np.float64)
    made = cluster.suggested(listed, centres, 4)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, cluster.suggestions(weighted, cluster.assigned(rows, centres, "id"), 4, "id").collect()))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
