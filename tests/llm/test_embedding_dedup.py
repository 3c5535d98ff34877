import numpy as np
from pyspark.sql import functions as F

from quillon.llm import embedding_dedup, queries


def brute(ids, x, threshold=0.9):
    x = np.asarray(x, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], label[:, None]).min(1))
        if (new == label).all():
            return link.sum(1), label
        label = new


def made(n=1500, clusters=40, size=12, dim=32, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    at = n
    for k in range(clusters):
        centre = x[k]
        for _ in range(size if k else 900):
            x = np.vstack([x, centre + r.normal(size=dim) * np.linalg.norm(centre) / np.sqrt(dim) * r.uniform(0.01, 0.28)])
            at += 1
    return r.permutation(len(x)).tolist(), x


def test_recall_and_precision(spark):
    ids, x = made()
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<float>").withColumn("node", F.lit("x")).withColumn("v", F.lit(0))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.repartition(4)).collect()}
    links, label = brute(ids, x)
    assert len(got) == len(ids)
    assert all(got[i].n_links <= n for i, n in zip(ids, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label, strict=True)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [2.0, 0.1]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 10)] + [(7, 3, 7, True)] * 2 + [(9, 3, 7, False), (None, 3, 7, True)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.where("vec_id = 1")).collect()] == [(1, 0, 1, True)]


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    links, label = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: r for r in queries.op5_embedding_dedup(spark, d).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * links.sum()
    assert all(got[r.vec_id].n_links <= n for r, n in zip(rows, links, strict=True))


def test_visits_are_the_nearest_cells():
    r = np.random.default_rng(3)
    own = embedding_dedup.Index((r.normal(size=(7, 4)), r.normal(size=(7, 4))))
    x = r.normal(size=(20, 8))
    a, b = own._distances(x)
    full = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    got = own.visit(x, 49)
    assert (np.sort(got, 1) == np.arange(49)).all()
    assert np.allclose(np.take_along_axis(full, got, 1), np.sort(full, 1))


def test_recall_of_other_links_among_many_copies(spark):
    """A third of all rows is one vector, or one tight cluster: the links of the others must not suffer."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = r.normal(size=(2000, 64))
    turn -= (turn * x[:2000]).sum(1, keepdims=True) * x[:2000]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cos = r.uniform(0.9, 0.99, (2000, 1))
    pairs = np.vstack([x, cos * x[:2000] + np.sqrt(1 - cos**2) * turn])
    hub = r.normal(size=64)
    for spread in (0, 0.02):
        rows = np.vstack([pairs, hub + spread * r.normal(size=(3000, 64))])
        links, _ = brute(range(len(rows)), rows)
        df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>")
        got = {v.vec_id: v.n_links for v in embedding_dedup.near_duplicates(df.repartition(4)).collect()}
        others = sum(got[i] for i in range(len(pairs)))
        assert links[: len(pairs)].sum() >= 3900
        assert 0.97 * links[: len(pairs)].sum() <= others <= links[: len(pairs)].sum()


def test_doubles_beyond_the_range_of_floats(spark):
    rows = [(0, [1e39, 0.0]), (1, [1e39, 0.0]), (2, [0.0, 1e-50]), (3, [0.0, 1e-50]), (4, [1e300, -1e300]), (5, [1e200, -1e200]), (6, [float("inf"), 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(1, 0), (1, 0), (1, 2), (1, 2), (1, 4), (1, 4), (0, 6)]


def test_copies_cost_one_vector(spark):
    """16,000 equal vectors among others: every copy is linked with all others and with the near vectors; the clock is that of the rest."""
    r = np.random.default_rng(7)
    hub, far = r.normal(size=16), r.normal(size=(50, 16))
    near = [(hub * 2 + 0.05 * k * r.normal(size=16)).tolist() for k in (1, 2)]
    rows = [(i, hub.tolist()) for i in range(10, 16_010)] + [(3, near[0]), (4, near[1])] + [(20_000 + i, v) for i, v in enumerate(far.tolist())]
    links, label = brute([3, 4, 10, *range(20_000, 20_050)], [near[0], near[1], hub, *far])
    assert links[:3].tolist() == [2, 2, 2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = {v.vec_id: v for v in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert {(got[i].n_links, got[i].component_id) for i in (3, 4, *range(10, 16_010))} == {(16_001, 3)}
    assert all(got[20_000 + i].n_links == links[3 + i] for i in range(50) if label[3 + i] >= 20_000)


def test_links_between_blobs_of_one_cell(spark):
    """A cell of several blobs, all its vectors different and linked: each pair counts once."""
    r = np.random.default_rng(8)
    x = np.ones(8) + 0.01 * r.normal(size=(1400, 8))
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    assert {(v.n_links, v.component_id) for v in got} == {(1399, 0)}
