"""Scores made into probabilities, and rules blended with a learned model where they aren't sure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.scoring import hybrid


def bin_of(score: Column, bins: int) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.least(F.floor(score * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))


def pooled(n: list[int], positive: list[int]) -> list[float]:
    """The non-decreasing values nearest to the rates by weighted squares: neighbours out of order are pooled."""
    blocks: list[list[int]] = []  # rows, positive, bins
    for rows, ones in zip(n, positive, strict=True):
        blocks.append([rows, ones, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [ones / rows for rows, ones, width in blocks for _ in range(width)]


@dataclass
class Calibration:
    """The probability in each of the equal bins of scores from 0 to 1."""

    values: list[float]

    def probability(self, score: Column) -> Column:
        """Null for a null score; scores outside 0 to 1 count as the nearest bound."""
        return F.try_element_at(F.lit(self.values), bin_of(score, len(self.values)) + 1)


def fit(rows: DataFrame, score: str = "score", label: str = "label", bins: int = 200) -> Calibration:
    """Isotonic, from rows with a score and a label of 0 or 1; others count nothing. The driver sees one sum per bin.

    A bin without rows has the value of the bin with rows below it, or else of the first above. Without any rows, scores stay as they are.
    """
    use = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isin(0, 1))
    sums = use.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positive")).orderBy("bin").collect()
    if not sums:
        return Calibration([(i + 0.5) / bins for i in range(bins)])
    value = dict(zip([r.bin for r in sums], pooled([r.n for r in sums], [r.positive for r in sums]), strict=True))
    out, last = [], value[sums[0].bin]
    for i in range(bins):
        last = value.get(i, last)
        out.append(last)
    return Calibration(out)


def calibration_error(rows: DataFrame, probability: str = "probability", label: str = "label", bins: int = 10) -> DataFrame:
    """One row (rows, error): the mean distance of probability and rate over equal bins, weighted by rows; null without rows."""
    each = rows.where(F.col(probability).isNotNull() & F.col(label).isNotNull()).groupBy(bin_of(F.col(probability), bins).alias("bin"))
    each = each.agg(F.count("*").alias("n"), F.avg(probability).alias("p"), F.avg(label).alias("rate"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("p") - F.col("rate"))), F.sum("n")).alias("error"))


def routed(rule: Column, model: Column | None, threshold: float, alpha: float) -> Column:
    """The rule where it reaches the threshold, else the blend: rules override the model."""
    return F.when(rule >= threshold, rule).otherwise(hybrid(rule, model, alpha))


def text_model(rows: DataFrame, body: str = "text", label: str = "label", features: int = 1 << 14, rounds: int = 30) -> PipelineModel:
    """A logistic model over hashed words of texts labelled 0 or 1, fitted by all executors; null texts count as empty."""
    use = rows.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(body), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    stages = [words, HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True)]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=rounds, regParam=0.01, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")]).fit(use)


def model_scores(docs: DataFrame, model: PipelineModel, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, model): the model's probability of label 1 for every row."""
    rows = model.transform(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(body), F.lit("")).alias("_text")))
    return rows.select(F.col("_key").alias(key), vector_to_array("_probability")[1].alias("model"))
