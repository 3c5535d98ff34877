"""Entities from a list of names of any length: longest matches, and short names that stand for a full one of the same text."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.segment import sentence_spans, text_udf

WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}’'&-]*")


def plain(name):
    """A name as it is compared: lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def _phrases(t: str, longest: int) -> list[tuple[int, int, int, int, str, str]]:
    """(run, start, end, sentence, text, plain text) of the runs of up to ``longest`` words that begin with a capital, none over a sentence's end.

    Words of a phrase are parted by white space only; run numbers the stretches of such words.
    """
    out, run = [], 0
    for number, (a, b) in enumerate(sentence_spans(t)):
        words = [m.span() for m in WORD.finditer(t, a, b)]
        for i, (start, stop) in enumerate(words):
            if i and t[words[i - 1][1] : start].strip():
                run += 1
            if not t[start].isupper():
                continue
            parts, last = [], start
            for x, y in words[i : i + longest]:
                if t[last:x].strip():
                    break
                parts.append(t[x:y])
                last = y
                out.append((run, start, y, number, t[start:y], " ".join(parts).lower()))
        run += 1
    return out


def entities(docs: DataFrame, names: DataFrame, key: str = "document_id", body: str = "text", longest: int = 6, people: str = "PERSON") -> DataFrame:
    """(key, text, label, start_char, end_char, sentence_id, name, model): names (name, label) found in the texts, in any case but
    beginning with a capital, from left to right the longest first.

    The phrases of the texts are joined with the names by hash, so the list may have any length; Catalyst broadcasts a short one. A
    capitalised word that is no name itself is a mention of the last full name before it in the text that ends with it, if that
    is labelled ``people``; name says which entity a mention is of. A name with several labels has the first in alphabetical
    order; null names and labels, and names of more than ``longest`` words, find nothing. model identifies the list. Keys are unique;
    null texts have no entities. A document's rows can be ordered by start, end, label.
    """
    fields = {"run": pa.int32(), "start": pa.int32(), "end": pa.int32(), "sentence_id": pa.int32(), "text": pa.string(), "plain": pa.string()}
    found = text_udf(lambda t: _phrases(t, longest), "array<struct<run:int,start:int,end:int,sentence_id:int,text:string,plain:string>>", **fields)
    listed = names.where("name IS NOT NULL AND label IS NOT NULL").groupBy(plain(F.col("name")).alias("plain")).agg(F.min("label").alias("_label"))
    stamp = listed.agg(F.concat(F.lit("gazetteer:"), F.hex(F.coalesce(F.bit_xor(F.xxhash64("plain", "_label")), F.lit(0)))).alias("model"))
    rows = docs.select(F.col(key).alias("_key"), F.inline(found(F.col(body)))).join(listed, "plain", "left")
    rows = rows.where(F.col("_label").isNotNull() | ~F.contains("plain", F.lit(" ")))
    # the longest name at a place, then from left to right what doesn't overlap the one before
    hits = rows.where("_label IS NOT NULL").groupBy("_key", "run", "start").agg(F.max(F.struct("end", "sentence_id", "text", "plain", "_label")).alias("x"))
    hit = F.struct("start", "x.end", "x.sentence_id", "x.text", "x.plain", F.col("x._label").alias("label"))
    chain = F.aggregate(
        F.array_sort(F.collect_list(hit)), F.array().cast("array<struct<start:int,end:int,sentence_id:int,text:string,plain:string,label:string>>"),
        lambda out, h: F.when((F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["end"] <= h["start"]), F.array_append(out, h)).otherwise(out),
    )
    kept = hits.groupBy("_key", "run").agg(chain.alias("kept"))
    full = kept.select("_key", F.inline("kept")).withColumn("name", F.col("plain"))
    covered = full.select(F.col("_key"), F.col("sentence_id"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    short = rows.where("_label IS NULL").select("_key", "start", "end", "sentence_id", "text", "plain").join(covered, ["_key", "sentence_id"], "left")
    inside = F.coalesce(F.max((F.col("_from") <= F.col("start")) & (F.col("end") <= F.col("_to"))), F.lit(False))
    short = short.groupBy("_key", "start", "end", "sentence_id", "text", "plain").agg(inside.alias("inside")).where("NOT inside").drop("inside")
    owner = full.where((F.col("label") == people) & F.contains("plain", F.lit(" "))).select("_key", F.element_at(F.split("plain", " "), -1).alias("last"), "start", F.col("plain").alias("owner"))
    both = short.select("_key", "start", F.col("plain").alias("last"), F.lit(None).cast("string").alias("owner"), F.struct("end", "sentence_id", "text").alias("m"))
    both = both.unionByName(owner.withColumn("m", F.lit(None).cast("struct<end:int,sentence_id:int,text:string>")))
    earlier = F.last("owner", ignorenulls=True).over(Window.partitionBy("_key", "last").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    short = both.withColumn("name", earlier).where("m IS NOT NULL AND name IS NOT NULL").select("_key", "start", "m.end", "m.sentence_id", "m.text", F.lit(people).alias("label"), "name")
    out = full.drop("plain").unionByName(short).join(F.broadcast(stamp), how="cross")  # rows with a row
    return out.select(F.col("_key").alias(key), "text", "label", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "sentence_id", "name", "model")
