"""From texts to records: one declarative plan for a table, a stream's micro-batch, a folder or a single text."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.errors import InvalidInputError, NoTextFoundError
from quillon.functions import text
from quillon.functions.batches import small_batches
from quillon.operators import detectors, hierarchy, records


def prepare(df: DataFrame, settings: Settings) -> DataFrame:
    """(document_id, text, source_type, title, author, language): NFC, then the digest of the text as its id."""
    small_batches(df.sparkSession)
    have = set(df.columns)
    column = lambda name, default: F.col(name) if name in have else F.lit(default).cast("string")
    body = text.nfc(F.col("text"))
    df = df.where(F.trim("text") != "")  # NFC makes no space and takes none away; asked of its result, the filter would have it made twice
    df = df.select(body.alias("text"), column("source_type", "api_rest").alias("source_type"), column("title", None).alias("title"), column("author", None).alias("author"), F.coalesce(column("language", None), F.lit(settings.pipeline.get("language", "en"))).alias("language"))
    return df.select(text.document_id(F.col("text")).alias("document_id"), "*")


def analyze(df: DataFrame, settings: Settings | None = None, distinct: bool = False) -> DataFrame:
    """Records of all texts of df that aren't blank, one per row. The id is the digest of the text, so rows with equal texts have
    equal ids; with ``distinct`` they give one record.

    Each text is analysed once: findings and scores are made on distinct texts, and joined with the rows that hold them. Distinct texts,
    their findings and their statistics are kept, as several parts of a record are made of each.
    """
    settings = settings or Settings.load()
    rows = prepare(df, settings)
    docs = hierarchy._fixed(rows.dropDuplicates(["document_id"]))
    found = hierarchy._fixed(detectors.findings(docs, settings.taxonomy))
    made = records.validated(records.build(docs, found, settings), len(settings.taxonomy.categories))
    if distinct:
        return made
    source = F.struct(F.col("source_type").alias("type"), "title", "author", "language").alias("source")
    return made.drop("source").join(rows.select("document_id", source), "document_id").select(made.columns)


def analyze_one(spark: SparkSession, body: str, settings: Settings | None = None, **fields: str) -> dict:
    """The record of one text as a dict; NoTextFoundError where it is blank, InvalidInputError where it is no text."""
    if not isinstance(body, str):
        raise InvalidInputError(f"text expected, not {type(body).__name__}")
    if not body.strip():
        raise NoTextFoundError("the text is blank")
    row = spark.createDataFrame([(body, *fields.values())], ", ".join(f"{k} string" for k in ("text", *fields)))
    return json.loads(analyze(row, settings).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def analyze_batch(spark: SparkSession, bodies: list[str], settings: Settings | None = None) -> list[dict]:
    """Records in the order of the texts, by one job for all; one bad text fails the batch, and so does an empty batch."""
    if not bodies:
        raise InvalidInputError("no documents")
    for b in bodies:
        if not isinstance(b, str):
            raise InvalidInputError(f"text expected, not {type(b).__name__}")
        if not b.strip():
            raise NoTextFoundError("the text is blank")
    rows = analyze(spark.createDataFrame([(b,) for b in bodies], "text string"), settings, distinct=True).select("document_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    made = {i: json.loads(r) for i, r in rows}
    return [made[hashlib.sha256(unicodedata.normalize("NFC", b).encode()).hexdigest()] for b in bodies]


def health(settings: Settings | None = None) -> dict:
    settings = settings or Settings.load()
    return {"status": "ok", "categories": len(settings.taxonomy.categories), **settings.hashes}


def classify_folder(spark: SparkSession, folder: str, pattern: str = "*", settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, failures): every file of the folder that matches; failures are rows (file, error_type, error), no exception."""
    from quillon.sources import readers

    read, failed = readers.read_folder(spark, folder, pattern)
    return analyze(read, settings), failed


def batch_summary(done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: processed, failed, gate (OK, or why the run doesn't count). The ids stay rows: done.select("document_id").orderBy(...)."""
    a = done.agg(F.count("*").alias("processed"))
    b = failed.agg(F.count("*").alias("failed"))
    gate = F.when(F.col("processed") == 0, "nothing processed").when(F.col("failed") > F.col("processed"), "more failed than processed").otherwise("OK")
    return a.join(b, how="cross").select("processed", "failed", gate.alias("gate"))  # a row with a row
