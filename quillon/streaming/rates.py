"""Rates of corpora, kept up to date from a stream: sums that merge, a folder per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.config import Settings
from quillon.functions import text
from quillon.operators import detectors, evaluate

PARTIAL = "corpus string, category string, findings long, documents long, words long"


def merged(parts: DataFrame) -> DataFrame:
    """The sums of rows of ``partial``; it doesn't matter how documents were split, nor in which order parts are merged."""
    return parts.groupBy("corpus", "category").agg(*(F.sum(x).alias(x) for x in ("findings", "documents", "words")))


def partial(docs: DataFrame, settings: Settings, key: str = "id", corpus: str = "corpus", body: str = "text") -> DataFrame:
    """(corpus, category, findings, documents, words): a row per corpus (category null), and one per category found there.

    Rows with one key are one document, the first by corpus and text; a null key is the empty one, a null corpus a corpus of its own, a null text empty.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.struct(F.col(corpus).cast("string").alias("corpus"), F.coalesce(F.col(body), F.lit("")).alias("text")).alias("r"))
    rows = rows.groupBy("_key").agg(F.min("r").alias("r")).select("_key", "r.*")
    found = detectors.findings(rows, settings.taxonomy, "_key").groupBy("_key", "category").agg(F.count("*").alias("n"))
    found = found.join(rows.select("_key", "corpus"), "_key").groupBy("corpus", "category").agg(F.sum("n").alias("findings"))
    zero = F.lit(0).cast("long")
    whole = rows.groupBy("corpus").agg(F.count("*").alias("documents"), F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))
    whole = whole.select("corpus", F.lit(None).cast("string").alias("category"), zero.alias("findings"), "documents", "words")
    return whole.unionByName(found.select("corpus", "category", "findings", zero.alias("documents"), zero.alias("words")))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=<number>`` that are complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """All sums that count: those up to the last compaction, and one folder per later micro-batch."""
    upto = max(_numbers(spark, path, "upto"), default=-1)
    folders = [f"{path}/upto={upto}"] * (upto >= 0) + [f"{path}/batch={n}" for n in _numbers(spark, path, "batch") if n > upto]
    return spark.read.schema(PARTIAL).parquet(*folders) if folders else spark.createDataFrame([], PARTIAL)


def add(batch: DataFrame, number: int, path: str, settings: Settings, **columns: str) -> None:
    """The sums of a micro-batch. One that runs again replaces its own; one that a compaction holds already is left out."""
    if number > max(_numbers(batch.sparkSession, path, "upto"), default=-1):
        merged(partial(batch, settings, **columns)).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def compact(spark: SparkSession, path: str) -> None:
    """One folder for all micro-batches up to the last; a few rows per corpus. Not while a stream writes there. What it sums up stays, unread."""
    done = _numbers(spark, path, "batch")
    if done and done[-1] > max(_numbers(spark, path, "upto"), default=-1):
        merged(parts(spark, path)).coalesce(1).write.mode("overwrite").parquet(f"{path}/upto={done[-1]}")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, category, findings, words, per_1000) as evaluate.corpus_rates gives them; a corpus without findings has its row with 0."""
    sums = merged(parts(spark, path))
    words = sums.where("category is null").select(F.col("corpus").alias("_corpus"), F.col("words").alias("_words"))
    levels = sums.select("corpus", "category", "findings").unionAll(sums.where("category is not null").select("corpus", F.lit(None).cast("string").alias("category"), "findings"))
    levels = levels.groupBy("corpus", "category").agg(F.sum("findings").alias("findings"))
    out = levels.join(words, F.col("corpus").eqNullSafe(F.col("_corpus")))
    return out.select("corpus", "category", "findings", F.col("_words").alias("words"), evaluate.rate(F.col("findings"), F.col("_words")).alias("per_1000"))


def run(stream: DataFrame, path: str, checkpoint: str, settings: Settings, key: str = "id", corpus: str = "corpus", body: str = "text", event_time: str | None = None, once: bool = True) -> StreamingQuery:
    """Keeps the sums of a stream in ``path``. A document that comes again in a later batch counts once: its key is in the state store,
    for good, or while the watermark of ``event_time``, set on the stream, lets it come."""
    seen = stream.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    seen = seen.dropDuplicatesWithinWatermark([key]) if event_time else seen.dropDuplicates([key])
    writer = seen.writeStream.foreachBatch(lambda batch, number: add(batch, number, path, settings, key=key, corpus=corpus, body=body))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
