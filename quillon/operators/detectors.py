"""The seven detector kinds: text to findings, each a verbatim span with its rule.

One Arrow pass cuts a document into sentences and marks in which of them a rule's literals stand, what is quoted, repeated or named
there; sentences with nothing of it end there. The rules themselves are SQL expressions on the sentences that are left. Rules over
a whole document (who is blamed in several sentences, who is praised and who scorned) are windows over the few rows that came
out, by document: texts are read once and never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import Category, Taxonomy
from quillon.functions import spans, text
from quillon.functions.batches import small_batches
from quillon.operators import entities as ent
from quillon.operators.literals import Automaton
from quillon.operators.segment import per_text, sentence_spans, text_udf

FINDING = "array<struct<category:string,rule_id:string,start:int,end:int,text:string,confidence:double,target:string,label:string,score:double>>"


def _rule(found: str, c: Category, rule: str, target: str = "cast(null as string)") -> str:
    head = f"'category', {spans.sql_string(c.id)}, 'rule_id', {spans.sql_string(f'{c.id}:{rule}')}"
    tail = f"'confidence', {float(c.base_confidence)}D, 'target', {target}, 'label', cast(null as string), 'score', cast(null as double)"
    return f"transform({found}, x -> named_struct({head}, 'start', x.start, 'end', x.end, 'text', x.text, {tail}))"


# ---------------------------------------------------------------- rules on one sentence: expressions, so that patterns are literals
# _s is the sentence, _low the same in lower case; _kinds names the rules whose literals stand in it, _mentions what the pass found in it.


def _matches(pattern: str) -> str:
    return spans.matches_sql("_s", spans.FLAGS + pattern)


def _cooccurrence(c: Category) -> str:
    hits = _matches(spans.words_pattern(c.terms))
    cut = "substring(_s, h[0].start + 1, element_at(h, -1).end - h[0].start)"
    one = f"transform(filter(array({hits}), h -> size(h) >= {c.min_hits}), h -> named_struct('start', h[0].start, 'end', element_at(h, -1).end, 'text', {cut}))"
    return _rule(one, c, "cooccurrence")


def _blame(c: Category) -> str:
    """Whoever is named in a blaming sentence; who is named in enough of them is decided over the document."""
    labels = ", ".join(map(spans.sql_string, c.entity_labels))
    named = f"filter(_mentions, m -> m.kind = 'entity' AND m.label IN ({labels}))" if labels else "filter(_mentions, m -> false)"
    found = _rule(named, c, "entity_blame", f"trim(regexp_replace(lower(x.text), {spans.sql_string('(?U)' + chr(92) + 's+')}, ' '))")
    groups = _rule(_matches(spans.words_pattern(c.group_terms)), c, "entity_blame", "lower(x.text)") if c.group_terms else f"cast(array() as {FINDING})"
    return f"CASE WHEN _s RLIKE {spans.sql_string(spans.FLAGS + spans.words_pattern(c.terms))} THEN concat({found}, {groups}) ELSE cast(array() as {FINDING}) END"


def _mentioned(c: Category, kind: str) -> str:
    head = f"'category', {spans.sql_string(c.id)}, 'rule_id', {spans.sql_string(f'{c.id}:{c.detector}')}"
    tail = f"'confidence', {float(c.base_confidence)}D, 'target', cast(null as string), 'label', x.label, 'score', x.score"
    return f"transform(filter(_mentions, m -> m.kind = {spans.sql_string(kind)}), x -> named_struct({head}, 'start', x.start, 'end', x.end, 'text', x.text, {tail}))"


WORDS = "size(filter(split(_s, '(?U)\\\\s+'), w -> w <> ''))"
SENTENCE_KINDS = ("lexicon", "regex", "regex_unless", "cooccurrence")


class Scan:
    """What the pass over a text has to find for a list of categories, and the expressions for what it finds."""

    def __init__(self, categories: list[Category], extract: bool = False):
        self.automaton, self.repeats, self.extract, self.moods, self.rules = Automaton(), [], extract, False, []
        for c in categories:
            if c.detector in ("lexicon", "cooccurrence", "entity_blame"):
                own = {"lexicon": lambda c: _rule(_matches(spans.words_pattern(c.terms)), c, "lexicon"), "cooccurrence": _cooccurrence, "entity_blame": _blame}[c.detector](c)
                self._add(own, lambda n, c=c: self.automaton.add_words(n, c.terms), f"{WORDS} <= {c.max_words}" if c.detector == "cooccurrence" else "")
            elif c.detector in ("regex", "regex_unless"):
                exceptions = [*([spans.words_pattern(c.unless_terms)] if c.unless_terms else []), *c.unless_patterns]
                unless = f"NOT (_low RLIKE {spans.sql_string(spans.any_of(exceptions))})" if c.detector == "regex_unless" else ""
                for i, p in enumerate(c.patterns):
                    self._add(_rule(_matches(p), c, f"{'regex' if c.detector == 'regex' else 'unless'}:{i}"), lambda n, p=p: self.automaton.add_pattern(n, p), unless)
            elif c.detector == "repetition":
                self.repeats.append((f"repetition {len(self.repeats)}", c.ngram_size, c.min_repeats))
                self.rules.append(_mentioned(c, self.repeats[-1][0]))
            elif c.detector == "entity_sentiment_split":
                self.moods = True
                self.rules.append(_mentioned(c, "entity"))

    def _add(self, rule: str, literals: Callable[[int], None], test: str) -> None:
        literals(len(self.rules))
        test = f"array_contains(_kinds, {len(self.rules)})" + (f" AND {test}" if test else "")
        self.rules.append(f"CASE WHEN {test} THEN {rule} ELSE cast(array() as {FINDING}) END")

    def sql(self) -> str:
        return f"concat({', '.join([f'cast(array() as {FINDING})', *self.rules])})"

    def mentions(self, t: str, starts: list[int], ends: list[int], named: list[dict] | None) -> dict[int, list[dict]]:
        """Entities and repeated phrases by the number of their sentence, places counted from its start."""
        out: dict[int, list[dict]] = defaultdict(list)
        if named is None:
            named = [{"start": a, "end": b, "text": t[a:b], "label": kind, "sentence": i} for i, (x, y) in enumerate(zip(starts, ends, strict=True)) for a, b, _, kind in _at(x, ent.found(t[x:y]))] if self.extract else []
        for e in named:
            i = e["sentence"]
            if i >= 0 and i < len(starts):
                out[i].append({"kind": "entity", "start": e["start"] - starts[i], "end": e["end"] - starts[i], "text": e["text"], "label": e["label"], "score": None})
        if self.moods:
            for i, own in out.items():
                mood = ent.compound(t[starts[i] : ends[i]])
                for e in own:
                    e["score"] = mood
        taken = [(e["start"], e["end"]) for e in named]
        for kind, size, least in self.repeats:
            for a, b in repetitions(t, size, least, taken):
                i = bisect_right(starts, a) - 1
                out[i].append({"kind": kind, "start": a - starts[i], "end": b - starts[i], "text": t[a:b], "label": None, "score": None})
        return out

    def sentences(self, t: str, named: list[dict] | None) -> list[tuple]:
        """(number, start, text, kinds, quotes, mentions) of the sentences in which something may be found; quotes that touch them."""
        cuts = sentence_spans(t)
        starts, ends = [a for a, _ in cuts], [b for _, b in cuts]
        kinds, mentions = self.automaton.hits(t, starts, ends), self.mentions(t, starts, ends, named)
        regions = [sorted(m.span() for m in p.finditer(t)) for p in _QUOTED] if kinds or mentions else []
        out = []
        for i in sorted({*kinds, *mentions}):
            reach = max([ends[i], *(starts[i] + m["end"] for m in mentions.get(i, ()))])  # a repeated phrase may go on behind its sentence
            near = [q for r in regions for q in r[max(0, bisect_left(r, (starts[i], 0)) - 1) : bisect_left(r, (reach, 0))]]
            out.append((i, starts[i], t[starts[i] : ends[i]], sorted(kinds.get(i, ())), [{"start": a, "end": b} for a, b in near], mentions.get(i, [])))
        return out


def _at(place: int, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    return [(place + a, place + b, x, kind) for a, b, x, kind in sorted(found, key=lambda x: (x[0], x[1], x[3]))]


_QUOTED = tuple(re.compile(p) for p in spans.QUOTED)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string()), ("score", pa.float64())])
SCANNED = "array<struct<sentence_id:int,start:int,text:string,kinds:array<int>,quotes:array<struct<start:int,end:int>>,mentions:array<struct<kind:string,start:int,end:int,text:string,label:string,score:double>>>>"


def scanned(scan: Scan, body: Column, named: Column) -> Column:
    """The sentences of a text in which something may be found. named: entities from elsewhere, or null."""

    fields = {"sentence_id": pa.int32(), "start": pa.int32(), "text": pa.string(), "kinds": pa.list_(pa.int32()), "quotes": pa.list_(_SPAN), "mentions": pa.list_(_MENTION)}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts, given in text.pieces(*batch):
                at = (x for x, t in zip(given.to_pylist(), texts, strict=True) if t.is_valid)
                yield per_text(texts, lambda t, at=at: scan.sentences(t, next(at)), **fields)

    return F.arrow_udf(run, SCANNED)(F.when(body.isNotNull(), body), named)


# ---------------------------------------------------------------- whole documents


class Grams:
    """The n-grams of a text's words across sentences, without those of stop words only."""

    WORD = regex.compile(r"[\p{L}\p{N}_\p{M}]+(?:['’][\p{L}\p{N}_\p{M}]+)*")
    PLAIN = re.compile(r"\w+(?:'\w+)*", re.ASCII)  # the same on ASCII
    SOUND = regex.compile(r"[\p{L}\p{N}]")

    def __init__(self, body: str, size: int):
        self.body, self.size, self.kept = body, size, None
        self.pattern = self.PLAIN if body.isascii() else self.WORD
        words = list(map(str.lower, self.pattern.findall(body)))
        if not all(map(str.isalnum, words)):  # underscores and marks alone are punctuation
            self.kept = [i for i, w in enumerate(words) if self.SOUND.search(w)]
            words = [words[i] for i in self.kept]
        self.words, self.all = words, list(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """Where the words are; most texts repeat nothing and are never asked."""
        found = [m.span() for m in self.pattern.finditer(self.body)]
        return found if self.kept is None else [found[i] for i in self.kept]

    def span(self, i: int) -> tuple[int, int]:
        return self.spans[i][0], self.spans[i + self.size - 1][1]

    def often(self, least: int, taken: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, phrase) of what occurs ``least`` times or more, without what touches a taken span."""
        many = {p for p, n in Counter(self.all).items() if n >= least}
        if not many:
            return []
        stops = [w in STOPS for w in self.words]
        rows = [(*self.span(i), p) for i, p in enumerate(self.all) if p in many and not (stops[i] and all(stops[i : i + self.size]))]
        if taken and rows:
            rows = [r for r in rows if not any(a < r[1] and r[0] < b for a, b in taken)]
            many = {p for p, n in Counter(p for *_, p in rows).items() if n >= least}
            rows = [r for r in rows if r[2] in many]
        return rows


STOPS = frozenset(text.STOP_WORDS)


def ngrams(docs: DataFrame, size: int, least: int, key: str, body: str) -> DataFrame:
    """(key, phrase, start, end): the n-grams that occur ``least`` times or more in their document. Counted inside the document: no shuffle."""

    small_batches(docs.sparkSession)
    found = text_udf(lambda t: Grams(t, size).often(least), "array<struct<start:int,end:int,phrase:string>>", start=pa.int32(), end=pa.int32(), phrase=pa.string())
    return docs.select(key, F.inline(found(F.col(body))))


def repetitions(t: str, size: int, least: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Phrases that occur often enough; from left to right, what overlaps the last one kept is skipped, whatever its phrase."""
    out, last = [], -1
    for a, b, _ in Grams(t, size).often(least, taken):
        if a >= last:
            out.append((a, b))
            last = b
    return out


# ---------------------------------------------------------------- over the rows of a document


def _blamed(rows: DataFrame, categories: list[Category], key: str) -> DataFrame:
    """Without those of an entity_blame category who are named in too few sentences."""
    n = F.size(F.collect_set("sentence_id").over(Window.partitionBy(key, "category", "target")))
    enough = F.lit(True)
    for c in categories:
        enough = F.when(F.col("category") == c.id, n >= c.min_blamed_sentences).otherwise(enough)
    return rows.withColumn("_enough", enough).where("_enough").drop("_enough")


def _divided(rows: DataFrame, categories: list[Category], key: str) -> DataFrame:
    """Of an entity_sentiment_split category only all mentions of the warmest and of the coldest entity, if both are extreme.

    Scores go by keys without leading article, mentions by keys with it: "The X" is scored but not quoted.
    """
    rows = rows.withColumn("_entity_key", F.when(F.col("category").isin(*(c.id for c in categories)), text.entity_key(F.col("text"))))
    one = Window.partitionBy(key, "category", "_entity_key")
    first = F.row_number().over(Window.partitionBy(key, "category", "_entity_key", "sentence_id").orderBy("start", "end")) == 1
    rows = rows.withColumn("_first", first)
    rows = rows.withColumns({"_mood": F.bround(F.avg(F.when(F.col("_first"), F.col("score"))).over(one), 6), "_times": F.count("*").over(one), "_label": F.min(F.struct("_at", "start", "end", "label")).over(one)["label"]})
    apart = F.lit(True)
    whole = Window.partitionBy(key, "category")
    for c in categories:
        able = F.when(F.col("_label").isin(*c.entity_labels) & (F.col("_times") >= c.min_mentions), F.struct("_mood", "_entity_key"))
        warm, cold, n = F.max(able).over(whole), F.min(able).over(whole), F.size(F.collect_set(able["_entity_key"]).over(whole))
        fires = (n >= c.min_entities) & (warm["_mood"] >= c.positive_threshold) & (cold["_mood"] <= c.negative_threshold) & text.plain_key(F.col("text")).isin(warm["_entity_key"], cold["_entity_key"])
        apart = F.when(F.col("category") == c.id, F.coalesce(fires, F.lit(False))).otherwise(apart)
    return rows.withColumn("_apart", apart).where("_apart").drop("_apart", "_entity_key", "_first", "_mood", "_times", "_label")


def _found(docs: DataFrame, live: list[Category], key: str, body: str, named: DataFrame | bool) -> DataFrame:
    small_batches(docs.sparkSession)
    scan = Scan(live, extract=named is True)
    rows = docs.select(key, F.col(body).alias("_text"))
    kind = "array<struct<start:int,end:int,text:string,label:string,sentence:int>>"
    if isinstance(named, DataFrame):
        whole = F.struct(F.col("start_char").cast("int").alias("start"), F.col("end_char").cast("int").alias("end"), "text", "label", F.col("sentence_id").cast("int").alias("sentence"))
        rows = rows.join(named.groupBy(key).agg(F.array_sort(F.collect_list(whole)).alias("_named")), key, "left").withColumn("_named", F.coalesce("_named", F.array().cast(kind)))
    else:
        rows = rows.withColumn("_named", F.lit(None).cast(kind))
    laid = rows.select(key, F.explode(scanned(scan, F.col("_text"), F.col("_named"))).alias("s"))
    laid = laid.select(key, "s.sentence_id", F.col("s.start").alias("_at"), F.col("s.quotes").alias("_quotes"), F.col("s.text").alias("_s"), F.lower("s.text").alias("_low"), F.col("s.kinds").alias("_kinds"), F.col("s.mentions").alias("_mentions"))
    return laid.select(key, "sentence_id", "_at", "_quotes", F.expr(f"inline({scan.sql()})"))


def _finding(found: DataFrame, key: str) -> DataFrame:
    start, end = F.col("_at") + F.col("start"), F.col("_at") + F.col("end")
    return found.select(key, "category", "rule_id", "sentence_id", "text", start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), "confidence", spans.inside(F.col("_quotes"), start, end).alias("in_quotation"))


def sentence_findings(docs: DataFrame, taxonomy: Taxonomy, key: str, body: str) -> DataFrame:
    """Findings of the sentence-level kinds: a map without a shuffle."""
    return _finding(_found(docs, [c for c in taxonomy.categories if c.detector in SENTENCE_KINDS], key, body, False), key)


def findings(docs: DataFrame, taxonomy: Taxonomy, key: str = "document_id", body: str = "text", found: DataFrame | bool | None = None) -> DataFrame:
    """(key, category, rule_id, sentence_id, text, start_char, end_char, confidence, in_quotation) of all rules at or above the threshold.

    ``found`` holds entities; without it they are extracted if a category needs them, and only then; False: there are none.
    Rows of docs with equal keys count as one document for the rules over whole documents. Null texts have no findings.
    """
    live = [c for c in taxonomy.categories if c.base_confidence >= taxonomy.default_threshold]
    rows = _found(docs, live, key, body, taxonomy.needs_entities if found is None else found)
    blame, split = ([c for c in live if c.detector == kind] for kind in ("entity_blame", "entity_sentiment_split"))
    if blame or split:
        rows = rows.repartition(key)  # findings, not texts; both rules below go by it
    if blame:
        rows = _blamed(rows, blame, key)
    if split:
        rows = _divided(rows, split, key)
    return _finding(rows, key)


def canonical(found: DataFrame, key: str = "document_id") -> DataFrame:
    """One ordered array of findings per document: by start, end, rule."""
    s = F.struct("start_char", "end_char", "rule_id", "category", "sentence_id", "text", "confidence", "in_quotation")
    return found.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("findings"))
