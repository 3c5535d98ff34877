"""Agreement of fired categories with expected ones, and firing rates by corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(fired: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """(category, tp, fp, fn) from two sets of (key, category)."""
    a = fired.select(key, "category").distinct().withColumn("fired", F.lit(1))
    b = expected.select(key, "category").distinct().withColumn("wanted", F.lit(1))
    both = a.join(b, [key, "category"], "full")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    f, w = F.col("fired").isNotNull(), F.col("wanted").isNotNull()
    return both.groupBy("category").agg(count(f & w).alias("tp"), count(f & ~w).alias("fp"), count(w & ~f).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1: null without a denominator; f1 is 0 where one of the two is null or 0 and null where both are null."""
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when(p.isNull() & r.isNull(), F.lit(None)).otherwise(0.0)
    return counts.select("*", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(f1, 6).alias("f1"))


def summary(counts: DataFrame) -> DataFrame:
    """One row: micro rates from summed counts, macro ones as means over categories that have one."""
    total = with_rates(counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")))).toDF("tp", "fp", "fn", "micro_precision", "micro_recall", "micro_f1")
    mean = with_rates(counts).agg(*(F.bround(F.avg(x), 6).alias(f"macro_{x}") for x in ("precision", "recall", "f1")))
    return total.join(mean, how="cross")  # a row with a row


def by_example(fired: DataFrame, expected: DataFrame, examples: DataFrame, key: str = "id") -> DataFrame:
    """(key, fired, expected, missed, spurious, exact) for every example, sorted sets."""
    sets = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_set("category")).alias(name))
    none = F.array().cast("array<string>")
    rows = examples.select(key).join(sets(fired, "fired"), key, "left").join(sets(expected, "expected"), key, "left")
    rows = rows.select(key, F.coalesce("fired", none).alias("fired"), F.coalesce("expected", none).alias("expected"))
    return rows.select("*", F.array_except("expected", "fired").alias("missed"), F.array_except("fired", "expected").alias("spurious"), (F.col("fired") == F.col("expected")).alias("exact"))


def unmeasured(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories neither expected nor fired anywhere."""
    return categories.join(counts.where(F.col("tp") + F.col("fp") + F.col("fn") > 0), "category", "left_anti")


def verbatim_rate(found: DataFrame, submitted: DataFrame, key: str = "id", body: str = "text") -> DataFrame:
    """The share of findings whose quote stands at its place in the text as it was submitted."""
    rows = found.withColumnRenamed("text", "quote").join(submitted.select(key, F.col(body).alias("_t")), key)
    same = F.substring(F.col("_t"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("quote")
    return rows.agg(F.bround(F.avg(same.cast("int")), 6).alias("verbatim_rate"))


def rate(n, words):
    """Per 1,000 words; 0 without words."""
    return F.when(words > 0, F.bround(n / words * 1000, 4)).otherwise(0.0)


def corpus_rates(words: DataFrame, found: DataFrame, key: str = "id", corpus: str = "corpus") -> DataFrame:
    """(corpus, category, findings, words, per_1000): both levels in one rollup; a null category is the whole corpus."""
    total = words.groupBy(corpus).agg(F.sum("word_count").alias("words"))
    one = found.join(words.select(key, corpus), key).rollup(corpus, "category").agg(F.count("*").alias("findings"), F.grouping(corpus).alias("_all")).where("_all = 0").drop("_all")
    return one.join(total, corpus).select(corpus, "category", "findings", F.col("words").cast("long").alias("words"), rate(F.col("findings"), F.col("words")).alias("per_1000"))


def separation(rates: DataFrame, neutral: str, loaded: str, corpus: str = "corpus") -> DataFrame:
    """One row per category (null: all): both rates side by side and their ratio, null where the neutral one is 0."""
    side = rates.groupBy("category").pivot(corpus, [neutral, loaded]).agg(F.first("per_1000"))
    side = side.select("category", F.coalesce(neutral, F.lit(0.0)).alias("neutral"), F.coalesce(loaded, F.lit(0.0)).alias("loaded"))
    return side.withColumn("ratio", F.bround(F.try_divide(F.col("loaded"), F.col("neutral")), 4))


def silent(categories: DataFrame, found: DataFrame) -> DataFrame:
    return categories.join(found.select("category").distinct(), "category", "left_anti")


def top_documents(words: DataFrame, found: DataFrame, key: str = "id", corpus: str = "corpus", n: int = 15) -> DataFrame:
    """The documents with most findings; ties by corpus, then key."""
    counts = found.groupBy(key).agg(F.count("*").alias("findings"))
    rows = words.join(counts, key).select(key, corpus, "findings", F.col("word_count").cast("long").alias("words"), rate(F.col("findings"), F.col("word_count")).alias("per_1000"))
    return rows.orderBy(F.desc("findings"), corpus, key).limit(n)


def gate(value: float | None, least: float | None = None, most: float | None = None) -> int:
    """An exit code: 1 where the value is missing or outside the bounds."""
    return int(value is None or (least is not None and value < least) or (most is not None and value > most))


def report(counts: DataFrame, settings_note: str = "") -> str:
    """A Markdown table of the rates by category."""
    lines = ["| category | tp | fp | fn | precision | recall | f1 |", "|-|-|-|-|-|-|-|"]
    show = lambda x: "-" if x is None else f"{x:.3f}"
    for r in with_rates(counts).orderBy("category").collect():  # one row per category of the configuration
        lines.append(f"| {r.category} | {r.tp} | {r.fp} | {r.fn} | {show(r.precision)} | {show(r.recall)} | {show(r.f1)} |")
    return "\n".join([settings_note, *lines] if settings_note else lines)
