"""Corpora side by side: what fires in each, where, how often, and whether a neutral one stays quiet.

Command line: python -m quillon.plans.corpus --corpus FOLDER [--report FILE] [--out FOLDER] [--conf FOLDER] [--max-neutral-rate RATE]
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import CONF, Settings
from quillon.errors import InvalidInputError
from quillon.functions import text
from quillon.functions.batches import small_batches
from quillon.operators import detectors, evaluate, hierarchy
from quillon.sources import readers


@dataclass
class CorpusRun:
    """documents: (key, corpus, title, words, findings, per_1000, categories), a row for each, also without findings.
    findings: (key, corpus, title, category, rule_id, start_char, text, context).
    rates: (corpus, category, findings, words, per_1000), totals with a null category. silent: categories that fire in no corpus."""

    documents: DataFrame
    findings: DataFrame
    rates: DataFrame
    silent: DataFrame
    key: str


def run(docs: DataFrame, settings: Settings, key: str = "id", corpus: str = "corpus", title: str = "title", body: str = "text", margin: int = 60) -> CorpusRun:
    """The run over docs (key, corpus, title, text); keys are unique. Blank and null texts are left out, as ``skipped`` says.

    Texts are analysed in NFC, and contexts are cut from that. Findings are kept once for all results. For the contexts, all findings of a
    document meet its text as one array, so a text moves once however many findings it has. A finding that isn't what stands at its
    place stops the job.
    """
    small_batches(docs.sparkSession)
    named = docs.where(F.col(body).rlike(r"\S"))  # NFC makes no white space and takes none away; asked of its result, the filter would have it made twice
    rows = named.select(F.col(key).alias("_key"), F.col(corpus).alias("corpus"), F.col(title).alias("title"), text.nfc(F.col(body)).alias("_text"))
    found = hierarchy._fixed(detectors.findings(rows, settings.taxonomy, "_key", "_text").select("_key", "category", "rule_id", "start_char", "end_char", "text"))
    words = rows.select("_key", "corpus", "title", text.word_count(F.col("_text")).cast("long").alias("words"))
    counts = found.groupBy("_key", "category").agg(F.count("*").alias("n")).groupBy("_key").agg(F.sum("n").alias("findings"), F.sort_array(F.collect_list("category")).alias("categories"))
    each = words.join(counts, "_key", "left").select(
        "_key", "corpus", "title", "words", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories")
    )
    each = each.withColumn("per_1000", evaluate.rate(F.col("findings"), F.col("words")))
    hits = found.groupBy("_key").agg(F.collect_list(F.struct("category", "rule_id", "start_char", "end_char", "text")).alias("hits"))
    placed = rows.join(hits, "_key").select("_key", "corpus", "title", "_text", F.explode("hits").alias("h"))
    start, end = F.col("h.start_char"), F.col("h.end_char")
    stands = F.substring(F.col("_text"), start + 1, end - start) == F.col("h.text")
    quote = F.when(stands, F.col("h.text")).otherwise(F.raise_error(F.concat(F.lit("a finding isn't at its place in document "), F.col("_key").cast("string"))))
    placed = placed.select("_key", "corpus", "title", "h.category", "h.rule_id", "h.start_char", quote.alias("text"), text.context(F.col("_text"), start, end, margin).alias("context"))
    rates = evaluate.corpus_rates(words.withColumnRenamed("words", "word_count"), found, "_key")
    ids = docs.sparkSession.createDataFrame([(c,) for c in settings.taxonomy.ids], "category string")
    name = lambda df: df.withColumnRenamed("_key", key)
    return CorpusRun(name(each), name(placed), rates, evaluate.silent(ids, found), key)


def skipped(docs: DataFrame, key: str = "id", corpus: str = "corpus", title: str = "title", body: str = "text") -> DataFrame:
    """(key, corpus, title, reason) of the rows that ``run`` leaves out: missing, where there is no text, or blank."""
    reason = F.when(F.col(body).isNull(), F.lit("missing")).otherwise(F.lit("blank"))
    return docs.where(F.col(body).isNull() | ~F.col(body).rlike(r"\S")).select(key, corpus, title, reason.alias("reason"))


def from_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(id, corpus, title, text) of the files that manifest.json lists: {corpus: {"documents": [{"title", "file"}]}}, each in the folder of its corpus.

    A listed file that isn't there or can't be read has a null text, an empty one an empty text. Files that aren't listed aren't read
    into the table. The id is corpus/file.
    """
    raw = "\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect())  # one small file
    try:
        listed = [(c, e.get("title") or e["file"], e["file"].replace("\\", "/").rsplit("/", 1)[-1]) for c, v in json.loads(raw).items() for e in v["documents"]]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise InvalidInputError(f"{folder}/manifest.json: {e!r}") from e
    entries = spark.createDataFrame(listed, "corpus string, title string, file_name string").dropDuplicates(["corpus", "file_name"])
    present = {x for x in {c for c, _, _ in listed} if _exists(spark, f"{folder}/{x}")}
    read = None
    for c in sorted(present):
        one = readers.read_files(spark, f"{folder}/{c}").select(F.lit(c).alias("corpus"), "file_name", F.when(F.col("error_type") == "NoTextFoundError", F.lit("")).otherwise(F.col("text")).alias("text"))
        read = one if read is None else read.unionByName(one)
    rows = entries.withColumn("text", F.lit(None).cast("string")) if read is None else entries.join(read, ["corpus", "file_name"], "left")
    return rows.select(F.concat_ws("/", "corpus", "file_name").alias("id"), "corpus", "title", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def report(made: CorpusRun, left_out: int = 0, neutral: str = "neutral", loaded: str = "rhetorical", most: int = 15) -> str:
    """Markdown: totals, rates by category, silent categories, the documents with most findings. It collects a row per category and
    corpus and ``most`` documents; the findings of the neutral corpus, each a possible false alarm, are the table ``findings``."""
    rates = made.rates.collect()
    total = {r.corpus: r for r in made.documents.groupBy("corpus").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("findings").alias("findings")).collect()}
    per = lambda r: round(r.findings / r.words * 1000, 4) if r.words else 0.0
    lines = ["# Findings by corpus", "", "| corpus | documents | words | findings | per 1,000 words |", "|-|-|-|-|-|"]
    lines += [f"| {c} | {r.documents} | {r.words} | {r.findings} | {per(r)} |" for c, r in sorted(total.items(), key=lambda x: str(x[0]))]
    if left_out:
        lines += ["", f"{left_out} listed documents were missing or blank."]
    calm, loud = (per(total[c]) if c in total else 0.0 for c in (neutral, loaded))
    lines += ["", f"{loaded} fires {loud / calm:.1f} times as often as {neutral}." if calm else f"Nothing fires in {neutral}."]
    by = {(r.category, r.corpus): r for r in rates if r.category is not None}
    show = lambda r: f"{r.findings} | {r.per_1000}" if r else "0 | 0.0"
    lines += ["", f"| category | {neutral} | per 1,000 | {loaded} | per 1,000 |", "|-|-|-|-|-|"]
    lines += [f"| {c} | {show(by.get((c, neutral)))} | {show(by.get((c, loaded)))} |" for c in sorted({c for c, _ in by})]
    quiet = sorted(r.category for r in made.silent.collect())
    if quiet:
        lines += ["", "Silent in all corpora: " + ", ".join(quiet)]
    top = made.documents.where("findings > 0").orderBy(F.desc("findings"), "corpus", made.key).limit(most).collect()
    lines += ["", "| document | corpus | words | findings | categories |", "|-|-|-|-|-|"]
    lines += [f"| {r.title} | {r.corpus} | {r.words} | {r.findings} | {', '.join(r.categories)} |" for r in top]
    return "\n".join(lines) + "\n"


def neutral_rate(made: CorpusRun, neutral: str = "neutral") -> float:
    """Findings per 1,000 words of a corpus; 0 without words."""
    one = made.documents.where(F.col("corpus") == neutral).agg(F.sum("findings").alias("n"), F.sum("words").alias("w"))
    return one.select(F.coalesce(evaluate.rate(F.col("n"), F.col("w")), F.lit(0.0))).first()[0]


def main(arguments: list[str] | None = None) -> int:
    """0, or 1 where the neutral corpus fires more often than it may, or the manifest can't be read."""
    p = argparse.ArgumentParser(prog="quillon.plans.corpus", description=__doc__)
    p.add_argument("--corpus", required=True)
    p.add_argument("--report")
    p.add_argument("--out", help="a folder for the tables documents, findings and skipped")
    p.add_argument("--conf", default=str(CONF))
    p.add_argument("--max-neutral-rate", type=float)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        docs = from_manifest(spark, a.corpus)
    except InvalidInputError as e:
        print(e, file=sys.stderr)
        return 1
    made, left_out = run(docs, Settings.load(a.conf)), skipped(docs)
    body = report(made, left_out.count())
    print(body)
    if a.report:
        Path(a.report).write_text(body, encoding="utf-8")
    if a.out:
        for name, df in (("documents", made.documents), ("findings", made.findings), ("skipped", left_out)):
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    return evaluate.gate(neutral_rate(made), most=a.max_neutral_rate)


if __name__ == "__main__":
    sys.exit(main())
