"""Scores of categories, severity, and the composites with their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import Scoring, Taxonomy


def saturate(raw: Column, words: Column, s: Scoring) -> Column:
    """1 - exp(-lambda * raw / words**beta); 0 without evidence."""
    density = raw / F.pow(F.greatest(words, F.lit(1)).cast("double"), F.lit(float(s.beta)))
    return F.when(raw <= 0, F.lit(0.0)).otherwise(1 - F.exp(-F.lit(float(s.lam)) * density))


def hybrid(rule: Column, model: Column | None, alpha: float) -> Column:
    """alpha * rule + (1 - alpha) * model; the rule alone where there is no model."""
    return rule if model is None or alpha >= 1 else F.coalesce(alpha * rule + (1 - alpha) * model, rule)


def band(value: Column, s: Scoring) -> Column:
    return F.when(value < float(s.bands.get("low", 0.3)), "low").when(value < float(s.bands.get("moderate", 0.7)), "moderate").otherwise("high")


def category_scores(words: DataFrame, found: DataFrame, taxonomy: Taxonomy, s: Scoring, key: str = "document_id") -> DataFrame:
    """(key, category, ord, family, count, raw, score, max_confidence): every category of every document in words (key, word_count), zeros included.

    The categories come from a literal array, so completing the grid needs no join with them; findings are summed before they move.
    """
    one = found.groupBy(key, "category").agg(F.count("*").alias("n"), F.sum("confidence").alias("total"), F.max("confidence").alias("top"))
    held = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "total", "top")))).alias("held"))
    grid = F.array(*(F.struct(F.lit(c.id).alias("category"), F.lit(i).alias("ord"), F.lit(c.family).alias("family"), F.lit(float(s.weights.get(c.id, 1.0))).alias("weight")) for i, c in enumerate(taxonomy.categories)))
    rows = words.select(key, "word_count").join(held, key, "left").select("*", F.inline(grid)).withColumn("h", F.try_element_at("held", F.col("category")))
    raw = F.coalesce(F.col("h.total") * F.col("weight"), F.lit(0.0))
    return rows.select(
        key, "category", "ord", "family", F.coalesce("h.n", F.lit(0)).cast("long").alias("count"), F.bround(raw, s.places).alias("raw"),
        F.bround(saturate(raw, F.col("word_count"), s), s.places).alias("score"), F.col("h.top").alias("max_confidence"),
    )


def severity(scores: DataFrame, taxonomy: Taxonomy, s: Scoring, key: str = "document_id") -> DataFrame:
    """(key, category, ord, instances, max_instance_severity, accumulated_severity, severity_weight, disruption) of categories with findings."""
    known = F.create_map(*(x for c in taxonomy.categories for x in (F.lit(c.id), F.struct(F.lit(float(c.severity_weight)).alias("weight"), F.lit(float(c.disruption)).alias("disruption")))))
    rows = scores.where("count > 0").withColumn("k", F.element_at(known, F.col("category")))
    top = F.col("max_confidence") * F.col("k.weight")
    return rows.select(
        key, "category", "ord", F.col("count").alias("instances"), F.bround(top, s.places).alias("max_instance_severity"), F.bround(1 - F.exp(-F.col("count").cast("double")), s.places).alias("accumulated_severity"),
        F.col("k.weight").alias("severity_weight"), (top * F.col("k.disruption")).alias("disruption"),
    )


def disruption(words: DataFrame, severities: DataFrame, s: Scoring, key: str = "document_id") -> DataFrame:
    """(key, logical_flow_disruption, disruption_driven_by, coherence): the first category in taxonomy order wins a tie; none at 0."""
    worst = severities.where("disruption > 0").groupBy(key).agg(F.max_by("category", F.struct("disruption", -F.col("ord"))).alias("driver"), F.max("disruption").alias("worst"))
    value = F.coalesce("worst", F.lit(0.0))
    return words.select(key).join(worst, key, "left").select(key, F.bround(value, s.places).alias("logical_flow_disruption"), F.col("driver").alias("disruption_driven_by"), F.bround(1 - value, s.places).alias("coherence"))


def noisy_or(values: Column) -> Column:
    return 1 - F.aggregate(values, F.lit(1.0), lambda a, v: a * (1 - v))


def smooth_max(values: Column, gamma: float) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(gamma * v))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.ln(total / F.size(values)) / gamma)


def composites(scores: DataFrame, taxonomy: Taxonomy, s: Scoring, key: str = "document_id") -> DataFrame:
    """One row per document: all composites, built on the rounded category scores, in taxonomy order."""
    row = F.struct("ord", "category", "family", "count", "score")
    docs = scores.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all"))
    part = lambda name: F.filter("all", lambda x: x["category"].isin(*(s.members(taxonomy, name) or [""])))
    values = lambda rows: F.transform(rows, lambda x: x["score"])
    inputs = lambda rows: F.map_from_entries(F.transform(rows, lambda x: F.struct(x["category"], x["score"])))
    mean = lambda rows: F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(F.aggregate(values(rows), F.lit(0.0), lambda a, v: a + v) / F.size(rows))
    cut = lambda x: F.bround(x, s.places)
    present = F.filter(values(part("prop_score")), lambda v: v > 0)
    prop = noisy_or(present) if s.method == "noisy_or" else smooth_max(present, float(s.gamma))
    excluded = s.members(taxonomy, "excluded") or [""]
    step = F.create_map(*(x for c in taxonomy.categories for x in (F.lit(c.id), F.lit(float(s.increments.get(c.id, 0.1))))))
    counted = F.filter("all", lambda x: (x["count"] > 0) & ~x["category"].isin(*excluded))
    added = F.aggregate(F.transform(F.array_sort(F.transform(counted, lambda x: x["category"])), lambda k: F.element_at(step, k)), F.lit(0.0), lambda a, v: a + v)
    weight = F.create_map(*(x for c in taxonomy.categories for x in (F.lit(c.id), F.lit(float(s.weights.get(c.id, 1.0))))))
    weights = sum(float(s.weights.get(c.id, 1.0)) for c in taxonomy.categories)
    docs = docs.select(
        key, cut(F.greatest(F.least(prop, F.lit(1.0)), F.lit(0.0))).alias("prop_score"), inputs(part("prop_score")).alias("prop_inputs"), cut(mean(part("fallacy_score"))).alias("fallacy_score"),
        inputs(part("fallacy_score")).alias("fallacy_inputs"), cut(mean(part("bias_signal"))).alias("bias_signal"), inputs(part("bias_signal")).alias("bias_inputs"), added.alias("_added"),
        F.map_from_entries(F.transform(F.array_sort(F.transform(counted, lambda x: x["category"])), lambda k: F.struct(k, cut(F.element_at(step, k))))).alias("breakdown"),
        cut(F.aggregate(F.transform("all", lambda x: F.element_at(weight, x["category"]) * x["score"]), F.lit(0.0), lambda a, v: a + v) / weights).alias("article_score"),
    )
    total = F.least("_added", F.lit(1.0))
    docs = docs.select("*", cut(total).alias("additive_manipulation"), band(total, s).alias("band"), (F.col("_added") > 1).alias("clipped")).drop("_added")
    docs = docs.withColumn("manipulation_index", cut(noisy_or(F.array("prop_score", "fallacy_score", "bias_signal"))))
    return docs.withColumn("composite", F.col("additive_manipulation") if s.expose_composite else F.lit(None).cast("double"))
