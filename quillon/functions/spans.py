"""Regular-expression matches with code-point offsets, in built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dialect of all rules: Unicode classes, any case.
FLAGS = "(?iU)"
SPAN = "array<struct<start:int,end:int,text:string>>"


def lowered(pattern: str) -> str:
    """A pattern for text in lower case: letters that aren't part of an escape in lower case."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def any_of(patterns) -> str:
    """One test for all patterns, on text in lower case. What they begin with, a word boundary as a rule, is looked for once for all."""
    low = [lowered(p) for p in patterns]
    at_word, other = [p[2:] for p in low if p.startswith(r"\b")], [p for p in low if not p.startswith(r"\b")]
    head = [rf"\b(?U:{'|'.join(f'(?:{p})' for p in at_word)})"] if at_word else []
    return "|".join([*head, *(f"(?U:{p})" for p in other)])


def words_pattern(terms) -> str:
    """One alternation of whole words, in the order of the list."""
    return r"\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms) + r")\b"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """All matches of a pattern that never matches empty, as (start, end, text), end exclusive; text is a SQL expression.

    Match i starts after the first i+1 gaps and the first i matches: one fold over both lists. (Positions from regexp_instr count
    UTF-16 units; lengths count code points.) Written as SQL because a plan of hundreds of rules is parsed much faster than built by calls.
    """
    p, none = sql_string(pattern), f"cast(array() as {SPAN})"
    span = "named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + length(x.m), 'text', x.m)"
    step = f"(acc, x) -> CASE WHEN x.m IS NULL THEN acc ELSE named_struct('at', acc.at + x.gap + length(x.m), 'out', array_append(acc.out, {span})) END"
    pairs = f"zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, g) -> named_struct('m', m, 'gap', length(g)))"
    return f"CASE WHEN {text} RLIKE {p} THEN aggregate({pairs}, named_struct('at', 0, 'out', {none}), {step}, acc -> acc.out) ELSE {none} END"


def matches(text: Column, pattern: str) -> Column:
    """The same for a Column."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


#: Stretches of 1 to 600 characters between double quotes, straight ones, then curly ones.
QUOTED = ('"[^"]{1,600}"', "“[^”]{1,600}”")


def quoted_regions(text: Column) -> Column:
    """(start, end) of stretches of 1 to 600 characters between double quotes, straight ones first, then curly ones."""
    bounds = lambda p: F.transform(matches(text, p), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.concat(*(bounds(p) for p in QUOTED))


def inside(regions: Column, start: Column, end: Column) -> Column:
    return F.exists(regions, lambda q: (q["start"] <= start) & (end <= q["end"]))
