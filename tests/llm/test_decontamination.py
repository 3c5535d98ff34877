import random

from pyspark.sql import functions as F

from quillon.llm import decontamination, queries
from tests.llm import brute


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "a_b", "X9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(2, 14) if True]
    items = [(i, t) for i, t in items if len(t) > 12] + [(90, None), (91, ""), (92, "--- !"), (None, " ".join(vocab[:12])), (93, "solo99x")]
    docs = [(1, None), (2, ""), (3, "... --"), (None, "w1 w2"), (4, "solo99x"), (4, "solo99x"), (4, "w1")]
    for i in range(150):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 40))) for _ in range(2)]
        if r.random() < 0.5:
            words = (r.choice(items)[1] or "").upper().split()
            parts.insert(1, "-".join(words[: r.randrange(0, len(words) + 1)]))
        docs.append((10 + i, "\n".join(parts)))
    docs.append((900, " ".join(vocab[i % 7] for i in range(20_000)) + " " + items[0][1]))
    return docs, items


def digest(out):
    return sorted((tuple(r) for r in queries.decontamination_digest(out).collect()), key=str)


def test_brute_force(spark):
    for seed in range(3):
        docs, items = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("id", F.lit("x"))
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
        want = sorted(brute.contamination(docs, items), key=str)
        assert digest(decontamination.find_passages(df, bench)) == want
        assert digest(decontamination.find_passages(df, bench, shard_bytes=300)) == want  # several passes


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_passages(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert digest(decontamination.find_passages(one, items)) == brute.contamination([(1, "a b")], [])


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, queries.op9_decontamination(spark, d).collect()))
    assert got == sorted(brute.contamination(docs, items)) and any(r[5] for r in got)


def test_tables_of_many_patterns_are_small():
    r = random.Random(0)
    text = " ".join(f"{r.randrange(1 << 30):x}" for _ in range(150_000)).encode()
    own = decontamination.Tables([(1, text), (2, text[:5000])], 10)
    arrays = [x for m, bounds, owners in own.matchers() for x in (*vars(m).values(), bounds, owners) if hasattr(x, "nbytes")]
    assert sum(x.nbytes for x in arrays) < 18 * len(text)
    assert len(__import__("pickle").dumps(own)) < 1.01 * (len(text) + 6000)


def test_three_shards(spark):
    r = random.Random(1)
    items = [(i, " ".join(f"v{r.randrange(3000)}" for _ in range(60))) for i in range(90)]
    docs = [(i, " ".join(f"v{r.randrange(3000)}" for _ in range(40)) + " " + items[i % 90][1][: 20 * (i % 9)]) for i in range(120)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    assert decontamination.Shards(bench, "item_id", "text", 10, -(-size // 3)).count == 3
    assert digest(decontamination.find_passages(df, bench, shard_bytes=-(-size // 3))) == sorted(brute.contamination(docs, items), key=str)
    clean = decontamination.clean(df, bench, shard_bytes=-(-size // 3))
    assert sorted(x.doc_id for x in clean.collect()) == sorted(x[0] for x in brute.contamination(docs, items) if not x[5])
