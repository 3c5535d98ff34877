"""A gold set from end to end: examples with the categories that they should fire, what did fire, rates, a report and a gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.functions import text
from quillon.operators import detectors, evaluate
from quillon.sources import readers


@dataclass
class Evaluation:
    """Tables by category and by example, and the figures over all; code: 1 where micro F1 is missing or below the least that was asked."""

    counts: DataFrame
    examples: DataFrame
    unmeasured: DataFrame
    summary: dict
    markdown: str
    code: int


def gold(spark: SparkSession, path: str, settings: Settings | None = None, least_f1: float | None = None) -> Evaluation:
    """The evaluation of a JSONL file of (id, text, categories).

    Texts are analysed in NFC; quotes are held against the texts as they were submitted, so one that NFC has changed may not be verbatim.
    The verbatim rate is null without findings. Expected categories that the taxonomy doesn't have count as missed.
    """
    settings = settings or Settings.load()
    rows = readers.gold(spark, path)
    found = detectors.findings(rows.select("id", text.nfc(F.col("text")).alias("text")), settings.taxonomy, "id")
    fired = found.select("id", "category").distinct()
    expected = rows.select("id", F.explode("categories").alias("category")).distinct()
    counts, examples = evaluate.confusion(fired, expected), evaluate.by_example(fired, expected, rows.select("id"))
    every = spark.createDataFrame([(c,) for c in settings.taxonomy.ids], "category string")
    one = evaluate.summary(counts).first().asDict()
    one["verbatim_rate"] = evaluate.verbatim_rate(found, rows).first()[0]
    one["exact_rate"] = examples.agg(F.bround(F.avg(F.col("exact").cast("int")), 6)).first()[0]
    note = f"micro F1 {one['micro_f1']}, exact {one['exact_rate']}, verbatim {one['verbatim_rate']}"
    return Evaluation(counts, examples, evaluate.unmeasured(counts, every), one, evaluate.report(counts, note), evaluate.gate(one["micro_f1"], least_f1))
