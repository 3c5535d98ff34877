import random

from pyspark.sql import functions as F

from quillon.llm import queries, substring_dedup
from tests.llm import brute


def test_covers_are_difference_covers():
    for period, members in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))


def digest(df):
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", size, F.sha2("kept_text", 256)).collect()), key=str)


def made(seed=0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", " x", "\x1cy"]
    passage = [[r.choice(vocab) for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    docs = [(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (4, "only once"), (4, "only once")]
    for i in range(120):
        parts = [[r.choice(vocab) for _ in range(r.randrange(0, 60))] for _ in range(3)]
        for p in r.sample(passage, r.randrange(0, 3)):
            parts.insert(r.randrange(3), p)
        docs.append((10 + i, r.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    docs += [(500 + i, docs[40][1]) for i in range(30)]
    docs.append((900, " ".join(["same"] * 200)))
    docs.append((901, " ".join(vocab[i % 37] for i in range(20_000))))
    return docs


def test_brute_force(spark):
    for window in (35, 8, 3):
        docs = made(window)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("data", F.lit(None).cast("int"))
        assert digest(substring_dedup.repeated_passages(df.repartition(3), window=window)) == sorted(brute.substring(docs, window), key=str)


def test_empty_table(spark):
    assert digest(substring_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_substring_dedup(spark, d).collect())) == sorted(brute.substring(docs))
