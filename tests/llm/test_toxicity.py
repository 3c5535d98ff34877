import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, toxicity
from tests.llm import brute

BAD = ["loathsome", "dimwit", "vermin", "wretched", "crook"]


def made(n=900, seed=0):
    r = random.Random(seed)
    syllables = ["ba", "tor", "li", "men", "sh", "on", "qua", "re", "st", "ing"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(r.randrange(30, 300))], i % 6 == 0
        if bad:
            for _ in range(max(3, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = made()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i] >= 0.5, y) for i, y in labels if i % 5 == 0]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.03 * len(held)
    edges = [(1, None), (2, ""), (None, "dimwit"), (3, "x " * 50_000), (3, "x"), (3, "x")]
    rows = toxicity.score(spark.createDataFrame(edges, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)), model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_no_labels_of_a_kind(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (1, None), (None, 1)]):
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(df, model).collect()] == [0.0, 0.0]


def test_query(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, d)
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in bad) >= 0.6 * len(bad) and sum(r.predicted for r in good) <= 0.05 * len(good)


def test_scores_by_their_definition(spark):
    docs, labels = made(400, seed=3)
    docs += [(1000, None), (1001, ""), (1002, "dimwit " * 3000), (1003, "\u00c9t\u00c9 vermin")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert model.weights and model.toxic != model.ordinary
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    want = {i: brute.toxicity(model, t) for i, t in docs[::7] + docs[-4:]}
    assert {i: got[i] for i in want} == pytest.approx(want, abs=1e-12)
    kept = {r.doc_id for r in toxicity.reject(df, model).select("doc_id").collect()}
    assert kept == {i for i in got if got[i] < 0.5}


def test_query_by_definition(spark):
    """The registered query over a whole table: contract columns, and scores by the plain version from a model fitted on the labels it may see."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, d).collect()}
    model = toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    for i in list(texts)[::5]:
        assert rows[i].score == pytest.approx(brute.toxicity(model, texts[i]), abs=1e-12)
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


def test_repeated_labels_and_long_texts(spark):
    docs, labels = made(300, seed=5)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    same = lambda a, b: (a.ordinary, a.toxic, a.weights, a.prior) == (b.ordinary, b.toxic, b.weights, b.prior)
    model = toxicity.fit(df, lab)
    doubled = lab.unionByName(lab).unionByName(lab.select("doc_id", F.lit(0).alias("toxic")))
    assert same(toxicity.fit(df, doubled), model)  # one row that says toxic is enough
    long = [(2000 + i, f"{'dimwit ' * 20}{i} " * 20) for i in range(40)]
    more = df.unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    every = lab.unionByName(spark.createDataFrame([(i, 0) for i, _ in long], "doc_id long, toxic int"))
    assert same(toxicity.fit(more, every, longest=2000), toxicity.fit(df, lab, longest=2000))
    assert not same(toxicity.fit(more, every), model)
