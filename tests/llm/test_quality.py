import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality, queries


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_query(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op13_quality(spark, d)
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert auc([(r.score, r.quality) for r in rows]) >= 0.99
    assert sum(r.predicted for r in rows if r.quality) >= 0.99 * sum(r.quality for r in rows)
    assert sum(r.predicted for r in rows if not r.quality) <= 0.1 * sum(1 - r.quality for r in rows)


def test_normal_equations_equal_plain_ridge(spark):
    rng = np.random.default_rng(1)
    x, model = rng.normal(size=(500, len(quality.STATISTICS))), quality.Model(features=24)
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 0).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(w)) for v, w in zip(x, y, strict=True)], "x array<double>, label double").repartition(7)
    left, right = quality._equations(rows, model)
    z = model.mapped(x)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)


def test_features_approximate_a_gaussian_kernel():
    model = quality.Model(features=20_000)
    x = np.random.default_rng(2).normal(size=(6, len(quality.STATISTICS)))
    z = model.mapped(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * model.width**2))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(3)
    x, n = np.arange(40.0), rng.integers(1, 9, 40).astype(float)
    y = np.clip(x / 40 + rng.normal(size=40) * 0.3, 0, 1)
    centre, value = quality.isotonic(x, y, n)
    assert (np.diff(value) >= 0).all() and (np.diff(centre) > 0).all()
    # the minimax formula of isotonic regression
    mean = lambda i, j: np.average(y[i : j + 1], weights=n[i : j + 1])
    want = [max(min(mean(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(sorted({round(v, 9) for v in value}), sorted({round(v, 9) for v in want}))


EDGES = [(1, None), (2, ""), (None, "words here"), (3, "x " * 200_000), (3, "x"), (3, "x"), (4, "\x00\n \n"), (5, "é" * 70_000), (6, "one\r\nline")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"x": F.lit("clash"), "score": F.lit(1), "label": F.lit(2), "_key": F.lit(3)})
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (None, 1), (4, None), (5, 0), (6, 1), (9, 1)], "doc_id long, quality int")
    stats = quality.statistics(docs, keep={"doc_id": F.col("doc_id")})
    rows = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    for x in ([], [(2, 1), (3, 1)]):
        model = quality.fit(stats, spark.createDataFrame(x, "doc_id long, quality int"))
        assert {r.score for r in quality.score(stats, model).collect()} == {1.0 if x else 0.5}
    none = quality.statistics(docs.limit(0), keep={"doc_id": F.col("doc_id")})
    assert quality.score(none, quality.fit(none, labels)).collect() == []


def test_statistics_cover_whole_texts():
    plain, junk = b"plain words in a row. " * 4000, b"### $$$ %%% " * 400
    a, b = np.array(quality.describe(plain)), np.array(quality.describe(plain + junk))
    assert abs(a - b)[quality.STATISTICS.index("symbols")] > 0.02 and quality.describe(b" \n") == [0.0] * len(quality.STATISTICS)
