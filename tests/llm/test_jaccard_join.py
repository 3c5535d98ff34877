import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, queries
from tests.llm import brute


ROWS = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("next", pa.bool_()), ("sketch", pa.binary())]))


def made(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "x\x1cy"]
    docs = [(5, None), (4, ""), (3, " "), (None, "One two"), (2, "one TWO"), (1, "one"), (1, "one"), (0, "a b c d"), (9, "A b c d"), (7, "a a a a a a a a")]
    base = [[r.choice(vocab) for _ in range(r.choice([5, 8, 12, 20, 40, 90, 300]))] for _ in range(12)]
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1])
            words = words or ["w"]
        docs.append((1000 + r.randrange(10_000), r.choice([" ", "\n"]).join(words)))
    docs += [(20_000 + i, docs[30][1]) for i in range(40)]
    docs.append((30_000, " ".join(vocab[i % 2999] for i in range(12_000))))
    docs.append((30_001, " ".join(vocab[i % 2999] for i in range(12_100))))
    return docs


def result(df, **more):
    return sorted((tuple(r)[:3] for r in jaccard_join.similar(df, **more).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_lose_no_pair(percent):
    """Pairs at the very edge of the threshold share a signature, whatever their size."""
    rng = np.random.default_rng(5)
    for size in [*range(1, 60), *range(60, 200, 7), 333, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = max(d for d in range(size + 1) if 100 * (size - d) >= percent * (size + d))  # so many replaced
            b = np.concatenate([a[most:], rng.integers(0, 1 << 63, most, dtype=np.uint64)])
            fewer = a[: -(-size * percent // 100)]
            for other in (b, fewer):
                if len(set(other.tolist()) & set(a.tolist())) == size:
                    continue
                doc = np.repeat([0, 1], [size, len(other)])
                docs, keys, steps, sketches = jaccard_join.signatures(doc, np.concatenate([a, other]), np.array([size, len(other)]), percent)
                shared = set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist())
                assert shared, (size, most)
                rows = [{"node": i, "root": i, "n": n, "next": bool(steps[(keys == min(shared)) & (docs == i)][0])} for i, n in ((0, size), (1, len(other)))]
                lists = pa.array([[r | {"sketch": sketches[r["next"]][r["node"]]} for r in rows]], ROWS)
                assert jaccard_join._near(lists, pa.array([None], ROWS), percent) == [(0, 1)]


def test_brute_force(spark):
    for seed, rounds in ((1, 3), (2, 0), (3, 1)):
        docs = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("root", F.lit("x"))
        assert result(df.repartition(3), rounds=rounds) == sorted(brute.linked(docs), key=str)


def test_empty(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_ngram_jaccard(spark, d).collect())) == sorted(brute.linked(docs))


def test_one_row_of_each_component(spark):
    docs = [(i, t) for i, (_, t) in enumerate(made(4))]
    rows = docs + [(None, "no id here at all"), docs[20], docs[20]]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    want = {g for d, n, g in brute.linked(docs) if n or d == g} | {None}
    assert sorted((r.doc_id for r in kept), key=str) == sorted(want, key=str)
