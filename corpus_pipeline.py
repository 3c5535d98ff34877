"""A training corpus from raw documents: five stages, each a table read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontamination, jaccard_join, line_dedup, packing, queries, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, by a model fitted on the labelled rows that op6 learns from."""
    labels = queries.table(spark, sf_dir, "labels").where(queries.crc() % 5 != 0)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines of earlier documents. A document that loses all its lines goes, as nothing of it is left."""
    carry = [x for x in docs.columns if x not in ("doc_id", "text")]
    out = line_dedup.remove_lines(docs, carry=carry, blocks=True).where((F.size("removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    if "n_chars" in carry:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five-word shingles, similarity 0.8."""
    return jaccard_join.one_of_each(docs, width=5, percent=80).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word run of a benchmark item."""
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_json(), keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity, alignment, PartEnum and packing have no equivalent in SQL; tests/llm/test_pipeline.py has a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
