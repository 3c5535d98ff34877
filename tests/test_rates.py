from pyspark.sql import functions as F

from quillon import catalog
from quillon.config import Settings
from quillon.functions import text
from quillon.operators import detectors, evaluate
from quillon.streaming import rates

DIR = "/root/testdata/sf0.001"


def docs(spark):
    return catalog.documents(spark, DIR).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("corpus"), "text")


def plain(rows):
    return sorted(((r.corpus or "", r.category or "", r.findings, r.words, r.per_1000) for r in rows if r.findings), key=repr)


def whole(rows):
    words = rows.select("id", "corpus", text.word_count(F.col("text")).alias("word_count"))
    return plain(evaluate.corpus_rates(words, detectors.findings(rows, catalog.bench().taxonomy, "id")).collect())


def test_three_batches_one_replayed(spark, tmp_path):
    """A stream of three files, with documents of the first again in the third, and a batch that runs twice, equals the batch query."""
    rows, path, settings = docs(spark).where("corpus is not null and text is not null"), str(tmp_path / "sums"), catalog.bench()
    split = F.crc32("id") % 3
    for n in range(3):
        part = rows.where(split == n)
        part = part.unionAll(rows.where(split == 0).limit(20)) if n == 2 else part
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = rates.run(stream, path, str(tmp_path / "state"), settings)
        query.awaitTermination()
        assert query.exception() is None
    want = whole(rows)
    assert want and plain(rates.rates(spark, path).collect()) == want
    second = rates._numbers(spark, path, "batch")[1]
    rates.add(rows.where(split == 1), second, path, settings)
    assert plain(rates.rates(spark, path).collect()) == want
    rates.compact(spark, path)
    rates.add(rows.where(split == 1), second, path, settings)  # after the compaction that holds it
    assert plain(rates.rates(spark, path).collect()) == want
    rates.add(rows.where(split == 1).withColumn("id", F.concat(F.lit("x"), "id")), 99, path, settings)
    assert sum(r[2] for r in plain(rates.rates(spark, path).collect())) > sum(r[2] for r in want)


def test_edges(spark, tmp_path):
    path, settings = str(tmp_path), catalog.bench()
    assert rates.rates(spark, path).count() == 0
    rows = spark.createDataFrame([("a", None, "You idiot, you idiot"), ("a", None, "You idiot, you idiot"), (None, "c", None), ("b", "c", ""), ("d", "e", "idiot")], "id string, corpus string, text string").withColumns({"findings": F.lit("clash"), "r": F.lit(1), "words": F.lit(2)})
    rates.add(rows, 0, path, settings)
    rates.add(rows.limit(0), 1, path, settings)
    got = {(r.corpus, r.category): (r.findings, r.words, r.per_1000) for r in rates.rates(spark, path).collect()}
    assert got == {(None, None): (2, 4, 500.0), (None, "slur"): (2, 4, 500.0), ("c", None): (0, 0, 0.0), ("e", None): (1, 1, 1000.0), ("e", "slur"): (1, 1, 1000.0)}


def test_sums_with_every_kind_of_rule(spark):
    rows = [("a", "x", "It was a vile trick. The crook left."), ("b", "x", "Rain fell."), ("c", None, None)]
    got = rates.partial(spark.createDataFrame(rows, "id string, corpus string, text string"), Settings.load())
    assert {(r.corpus, r.category): (r.findings, r.documents, r.words) for r in got.collect()} == {
        ("x", None): (0, 2, 10), (None, None): (0, 1, 0), ("x", "loaded_language"): (1, 0, 0), ("x", "name_calling"): (1, 0, 0),
    }
