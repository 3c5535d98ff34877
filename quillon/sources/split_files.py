"""Files of many records, read in splits: a row per line of JSON or per row of a table, faulty ones kept as rows, profiles by aggregation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.errors import InvalidInputError

DELIMITERS = ",;\t|"
#: Types of a column of strings, the narrowest first.
KINDS = ("boolean", "bigint", "double", "date", "timestamp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in that of spark.checkpoint.dir; without one, on a single machine, in its temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise InvalidInputError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- lines of JSON


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _string(value: Column, keys: Column, key: str) -> Column:
    """The member ``key`` if it is a string; numbers and the like give null."""
    there = F.array_contains(keys, key)
    member = F.when(there, F.try_variant_get(value, f"$['{key}']", "variant"))
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(value, f"$['{key}']", "string"))


def json_lines(spark: SparkSession, path: str, pattern: str = "*", field: str = "content") -> DataFrame:
    """(path, split, at, value, keys, text, error, start): a row per line that isn't blank.

    value is the line as a variant; keys are an object's member names, sorted, null for other values; text is the member ``field``, or
    ``text`` where ``field`` is missing, null unless a string that isn't blank. A line that isn't JSON has only its error and its first
    100 characters. Lines end by LF, CRLF or CR. Files are cut into splits by Spark; split and at tell where a line stood (``numbered``).
    """
    if "'" in field or "\\" in field:
        raise InvalidInputError(f"no name of a member: {field!r}")
    rows = _lines(spark, path, pattern).where(F.col("value").rlike(r"\S"))
    rows = rows.select("path", "split", "at", F.col("value").alias("line_text"), F.try_parse_json("value").alias("value"))
    rows = rows.withColumn("keys", F.when(F.col("value").isNotNull(), F.array_sort(F.json_object_keys("line_text"))))
    value, keys = F.col("value"), F.col("keys")
    body = _string(value, keys, field)
    if field != "text":
        body = F.when(F.array_contains(keys, field), body).otherwise(_string(value, keys, "text"))
    broken = value.isNull()
    return rows.select(
        "path", "split", "at", "value", "keys", F.when(body.rlike(r"\S"), body).alias("text"),
        F.when(broken, F.lit("not JSON")).alias("error"), F.when(broken, F.substring("line_text", 1, 100)).alias("start"),
    )


def numbered(rows: DataFrame, spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """rows of ``json_lines`` with line, counted from 1 in each file, blank lines too.

    The files are counted once more, a number per split; only these few rows are ordered, and the rows meet them by (path, split), so a
    file of any size is in as many groups as it has splits.
    """
    splits = _lines(spark, path, pattern).groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    shift = splits.select("path", "split", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("_shift"))
    return rows.join(shift, ["path", "split"]).withColumn("line", F.col("at") + F.col("_shift")).drop("_shift")


def errors(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, line, error, start) of the lines that aren't JSON."""
    return numbered(json_lines(spark, path, pattern).where("error is not null"), spark, path, pattern).select("path", "line", "error", "start")


def json_profile(rows: DataFrame) -> DataFrame:
    """(path, rows, errors, texts, shapes, consistent): a row per file; shapes counts different sets of keys among objects.

    Partial counts per shape come first, so a file with a third of all lines costs a task its shapes, not its lines.
    """
    one = rows.groupBy("path", "keys").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("rows"), F.count("error").alias("errors"), F.count("text").alias("texts")
    )
    out = one.groupBy("path").agg(*(F.sum(x).alias(x) for x in ("rows", "errors", "texts")), F.count("keys").alias("shapes"))
    return out.withColumn("consistent", F.col("shapes") <= 1)


def first_rows(rows: DataFrame, n: int = 10) -> DataFrame:
    """(path, place, value): the first n good rows of each file as JSON; Spark keeps n rows of a file per task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("split", "at"))
    return rows.where("error is null").withColumn("place", place).where(F.col("place") <= n).select("path", "place", F.to_json("value").alias("value"))


# ---------------------------------------------------------------- tables


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def delimiter(lines: list[str]) -> str:
    """The candidate that stands in all lines outside of quotes, equally often, and most often; the first of DELIMITERS among equals."""
    bare = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in lines if x.strip()]
    counts = {d: [x.count(d) for x in bare] for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (min(counts[d], default=0) > 0, len(set(counts[d]) - {0}) == 1, sum(counts[d])))


def table_rows(spark: SparkSession, path: str, pattern: str = "*", sep: str | None = None, wrapped: bool = False) -> DataFrame:
    """The rows of CSV or TSV files with a header, all columns strings, empty ones null, and _faulty: the line where it has too few or too many fields.

    The delimiter is found in the first kilobyte of lines. Files are read in splits, unless ``wrapped`` says that quoted fields hold line ends.
    """
    reader = lambda: spark.read.option("pathGlobFilter", pattern)
    if sep is None:
        seen, size = [], 0
        for r in reader().text(path).head(20):
            seen.append(r.value)
            size += len(r.value)
            if size >= 1024:
                break
        sep = delimiter(seen)
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": wrapped}
    names = reader().options(**options).csv(path).columns
    schema = ", ".join(f"{_quoted(x)} string" for x in (*names, "_faulty"))
    return reader().options(**options, columnNameOfCorruptRecord="_faulty").schema(schema).csv(path)


def table_profile(rows: DataFrame, samples: int = 5) -> DataFrame:
    """(column, dtype, nulls, distinct_values, samples) of a table of strings: a row per column.

    dtype is the narrowest of KINDS that all values of a column have, else string; a column without values is string. Samples are the
    smallest values. Values are counted per column before they are shuffled, so one that fills a column costs a row per task.
    """
    names = [x for x in rows.columns if x != "_faulty"]
    cells = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(_quoted(n)).cast("string").alias("value")) for n in names))))
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    is_kind = [F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), F.col("value").try_cast(k).isNotNull())), F.lit(False)).alias(f"is_{k}") for k in KINDS]
    whole = counted.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"), *is_kind)
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = counted.where("value is not null").withColumn("place", place).where(F.col("place") <= samples)
    few = few.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    dtype = F.coalesce(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in KINDS), F.lit("string"))
    none = F.array().cast("array<string>")
    return whole.join(few, "column", "left").select("column", dtype.alias("dtype"), "nulls", "distinct_values", F.coalesce("samples", none).alias("samples"))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """One row: how many rows are equal to one before them."""
    names = [_quoted(x) for x in rows.columns if x != "_faulty"]
    return rows.groupBy(*names).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
