"""The output record: assembly, checks, and flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.functions import text
from quillon.operators import detectors, hierarchy, scoring
from quillon.operators.segment import sentence_array

SCHEMA_VERSION = "1.0.0"
NOTES = (
    "Findings are verbatim stretches of the text, marked by fixed rules; they say that a wording occurs, not that it is wrong.",
    "Scores follow from the findings, the length of the text and the stated configuration alone.",
    "Nothing here has been calibrated against labelled data.",
)
WARNING = "Uncalibrated: the weights are chosen, not fitted. Read the inputs rather than the totals."


def stats(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """(key, char_count in code points, word_count of tokens, sentence_count)."""
    return docs.select(key, F.length(body).alias("char_count"), text.word_count(F.col(body)).alias("word_count"), F.size(sentence_array(F.col(body))).alias("sentence_count"))


def build(docs: DataFrame, found: DataFrame, settings: Settings, key: str = "document_id") -> DataFrame:
    """One record per document of docs (key, text, source_type, title, author, language), all parts by shuffles on the key only."""
    s, t = settings.scoring, settings.taxonomy
    counts = hierarchy._fixed(stats(docs, key))
    scores = scoring.category_scores(counts, found, t, s, key)
    worst = scoring.severity(scores, t, s, key)
    flow = scoring.disruption(counts, worst, s, key)
    whole = scoring.composites(scores, t, s, key)
    by_category = scores.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct(F.col("count").cast("int").alias("count"), "raw", "score", F.lit(False).alias("calibrated")))))).alias("category_scores")
    )
    one = F.struct(F.col("instances").cast("int").alias("instances"), "max_instance_severity", "accumulated_severity", "severity_weight")
    per = worst.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", one)))).alias("per_category"))
    spans = detectors.canonical(found, key)
    empty = F.array().cast(dict(spans.dtypes)["findings"])
    none = F.create_map().cast(dict(per.dtypes)["per_category"])
    rows = docs.join(counts, key).join(spans, key, "left").join(by_category, key).join(per, key, "left").join(flow, key).join(whole, key)
    inputs = lambda value, names, **more: F.struct(value.alias("value"), *(v.alias(k) for k, v in more.items()), names.alias("inputs"))
    gamma = F.lit(float(s.gamma)) if s.method == "smooth_max" else F.lit(None).cast("double")
    index = F.create_map(*(x for k in ("prop_score", "fallacy_score", "bias_signal") for x in (F.lit(k), F.col(k))))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col(key).alias("document_id"),
        F.struct(F.col("source_type").alias("type"), "title", "author", "language").alias("source"),
        F.struct(*(F.lit(settings.hashes[k]).alias(k) for k in ("pipeline_hash", "taxonomy_hash", "scoring_hash"))).alias("config_hashes"),
        F.struct("char_count", "word_count", "sentence_count").alias("stats"), F.coalesce("findings", empty).alias("findings"), "category_scores", "composite",
        F.struct(F.coalesce("per_category", none).alias("per_category"), "logical_flow_disruption", "disruption_driven_by", "coherence").alias("severity"),
        F.struct(
            F.lit(False).alias("calibrated"), F.lit(WARNING).alias("warning"),
            inputs(F.col("prop_score"), F.col("prop_inputs"), method=F.lit(s.method), gamma=gamma).alias("prop_score"), inputs(F.col("fallacy_score"), F.col("fallacy_inputs")).alias("fallacy_score"),
            inputs(F.col("bias_signal"), F.col("bias_inputs")).alias("bias_signal"),
            F.struct(F.col("additive_manipulation").alias("value"), "band", "breakdown", "clipped").alias("additive_manipulation"),
            inputs(F.col("manipulation_index"), index, method=F.lit("noisy_or")).alias("manipulation_index"),
            F.struct(F.col("article_score").alias("value"), F.lit("weighted_mean_of_category_scores").alias("method")).alias("article_score"), "logical_flow_disruption", "coherence",
        ).alias("composites"),
        F.array(*(F.lit(x) for x in NOTES)).alias("notes"),
    )


def evidence_mismatches(found: DataFrame, docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """Findings whose quote isn't what stands at their place in the text; none in a sound run."""
    return found.withColumnRenamed("text", "quote").join(docs.select(key, F.col(body).alias("_text")), key).where(F.substring(F.col("_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("quote"))


def _rules(categories: int) -> dict[str, Column]:
    """What the types can't promise: a problem's name, and when a record has it."""
    scores = F.map_values("category_scores")
    return {
        "document_id isn't 64 hex digits": ~F.col("document_id").rlike("^[0-9a-f]{64}$"),
        "negative statistics": (F.col("stats.char_count") < 0) | (F.col("stats.word_count") < 0) | (F.col("stats.sentence_count") < 0),
        "a finding without extent": F.exists("findings", lambda f: (f["start_char"] < 0) | (f["end_char"] <= f["start_char"])),
        "a confidence outside 0 to 1": F.exists("findings", lambda f: (f["confidence"] < 0) | (f["confidence"] > 1)),
        "a score outside 0 to 1": F.exists(scores, lambda c: (c["score"] < 0) | (c["score"] > 1)),
        "categories missing": F.size("category_scores") != categories,
        "no source type": F.col("source.type").isNull(),
    }


def violations(records: DataFrame, categories: int) -> DataFrame:
    """(document_id, problem) of the records that break a rule."""
    problems = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in _rules(categories).items())))
    return records.select("document_id", F.explode(problems).alias("problem"))


def validated(records: DataFrame, categories: int) -> DataFrame:
    """The same records; a job over them fails at the first one that breaks a rule."""
    checked = F.lit(None).cast("string")
    for name, broken in _rules(categories).items():
        checked = F.when(broken, F.raise_error(F.concat(F.lit(f"record breaks the schema ({name}): "), "document_id")).cast("string")).otherwise(checked)
    return records.withColumn("document_id", F.coalesce(checked, F.col("document_id")))


def flat(records: DataFrame) -> DataFrame:
    """Thirteen scalar columns, nested parts as JSON."""
    to = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return records.select(
        "document_id", "schema_version", F.col("source.type").alias("source_type"), F.col("source.title").alias("title"), F.col("source.language").alias("language"), "stats.char_count", "stats.word_count",
        "stats.sentence_count", F.size("findings").alias("finding_count"), to("findings").alias("findings_json"), to("category_scores").alias("category_scores_json"), to("config_hashes").alias("config_hashes_json"), "composite",
    )
