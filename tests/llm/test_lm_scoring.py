import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lm_scoring, queries
from tests.llm import brute

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def base(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs if i is not None}
    counts = Counter(t for i, x in docs if not held.get(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, bool(held.get(i)), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in docs]


def test_base_columns_and_gain(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op1_lm_scoring(spark, d).collect()))
    want = sorted(base(docs))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base on text it has not seen
    assert all(g[6] < 0 for g in got)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_score_against_dictionaries(spark, order):
    r = random.Random(order)
    docs = [(i, None if i == 3 else " ".join(r.choice("abcdefgh") + str(int(r.expovariate(0.7))) for _ in range(r.choice([0, 1, 3, 8, 30])))) for i in range(150)]
    docs += [(500 + i, docs[20 + i % 4][1]) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 5 != 2
    row = F.struct("doc_id", F.xxhash64("text"))
    flags = {x.doc_id: (x.t, x.h) for x in df.select("doc_id", train.alias("t"), (F.pmod(F.xxhash64(row, F.lit("held")), F.lit(8)) == 0).alias("h")).collect()}
    want = dict(zip((i for i, _ in docs), brute.language_model([(t, *flags[i]) for i, t in docs], order, lm_scoring.grid_of(order)), strict=True))
    got = {x.doc_id: x.score for x in lm_scoring.score(df, train, order=order).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), rtol=1e-6)


def test_probabilities_add_up(spark):
    """The words seen, the end and one word that was never seen have probabilities that make 1."""
    docs = [(i, " ".join("abca"[i % 3 : i % 3 + 2] if i % 2 else "abc")) for i in range(300)]
    ask = [(1000 + j, w) for j, w in enumerate(["", "a", "b", "c", "zzz"])]
    df = spark.createDataFrame(docs + ask, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score(df, F.col("doc_id") < 1000, order=1).collect()}
    end = got[1000]
    assert 10**end + sum(10 ** (got[1000 + j] - end) for j in range(1, 5)) == pytest.approx(1)
    assert got[0] == got[6]


def test_em_recovers_weights():
    rng = np.random.default_rng(1)
    p = rng.uniform(0.001, 1, (400, 3))
    want = np.array([0.2, 0.5, 0.3])
    got = lm_scoring.expectation_maximisation(p, 1e6 * (p @ want) / p.sum(1))
    assert got.sum() == pytest.approx(1) and (got > 0).all()
    assert lm_scoring.expectation_maximisation(np.array([[0.1, 0.9]]), np.array([1e6]))[1] > 0.99


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\x00 \x1c x"), (None, "a B a b"), (4, "A b"), (4, "A b"), (4, "c"), (5, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash")).withColumn("score", F.lit(0))
    out = lm_scoring.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = sorted(base(rows), key=str)
    assert [(g[0], not g[1], *g[2:5]) for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(empty, F.lit(True)).count() == 0
