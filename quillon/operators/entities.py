"""Named entities by rules and word lists, sentence sentiment, and both joined by entity."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators.segment import sentence_spans, text_udf

LABELS = ("PERSON", "ORG", "NORP", "GPE")
VERSION = "rules:1.0.0"
CAPITALISED = regex.compile(r"\b\p{Lu}[\p{L}\p{N}&’'-]*(?:[ \t\r\n]+(?:of[ \t\r\n]+(?:the[ \t\r\n]+)?)?\p{Lu}[\p{L}\p{N}&’'-]*)*")
NATIONS = "african american arab asian australian british buddhist canadian catholic chinese christian democrat dutch european french german greek hindu indian irish israeli italian japanese jewish korean mexican muslim palestinian polish protestant republican russian scottish spanish swedish syrian turkish ukrainian welsh".split()
PEOPLES = [*NATIONS, *(f"{x}s" for x in NATIONS), "jews", "the french", "the british", "the dutch", "the irish"]
PLACES = "africa america argentina asia australia austria belgium berlin brazil britain canada chicago china cuba denmark egypt england europe finland france germany greece india iran iraq ireland israel italy japan kenya london madrid mexico moscow nigeria norway pakistan paris poland portugal rome russia scotland spain sweden switzerland syria tokyo turkey ukraine wales washington".split()
BODIES = "agency association authority bank board bureau church club college commission committee company corp corporation council department foundation group hospital inc institute laboratory ltd ministry museum office parliament party press society trust union university".split()
TITLES = "mr mrs ms dr prof professor judge president senator minister sir lord lady king queen captain general mayor".split()

#: Words by how strongly they praise or blame, graded for this project: each grade has one value, from 3 (strong) to 1 (faint).
PRAISE = {
    3.0: "brilliant excellent magnificent marvellous outstanding perfect superb wonderful",
    2.0: "admirable amazing beautiful best celebrated delightful fantastic great hero impressive love loved praised proud remarkable respected splendid success triumph",
    1.0: "admired calm fair generous good happy helpful honest hope kind pleasant polite sound support trusted useful win",
}
BLAME = {
    3.0: "appalling atrocious cruel disgusting dreadful horrible killed murderous scum vicious worst worthless",
    2.0: "abuse awful bad condemned corrupt crisis dangerous dead disastrous disgraceful evil failure fraud hate liar pathetic scandal shameful stupid terrible ugly war",
    1.0: "angry criminal criticised criticized doubtful fail failed idiot poor sad threat trash unfair weak wrong",
}
VALENCE = {w: v for v, words in PRAISE.items() for w in words.split()} | {w: -v for v, words in BLAME.items() for w in words.split()}
NEGATIONS = "not no never none nobody nothing neither nor cannot can't don't doesn't didn't isn't wasn't won't wouldn't without hardly".split()
#: Fixed values of the published valence-aware formula (Hutto and Gilbert, 2014): what a booster adds, what a negation multiplies by, and the constant of the normalisation.
BOOST, TURN, NORM = 0.293, -0.74, 15
BOOSTERS = {**dict.fromkeys("absolutely completely extremely really so very".split(), BOOST), **dict.fromkeys("barely slightly somewhat".split(), -BOOST)}


_PEOPLES, _PLACES, _BODIES, _TITLES, _NEGATIONS = map(frozenset, (PEOPLES, PLACES, BODIES, TITLES, NEGATIONS))
_WORD = regex.compile(text.TOKEN.removeprefix("(?U)"))
_SOUND = regex.compile(r"[\p{L}\p{N}]")


def label(words: list[str], opens: bool) -> str | None:
    """The label of a run of capitalised words, given in lower case; two or more that don't open the sentence are a person."""
    whole, single = " ".join(words), " ".join(w for w in words if w != "the")
    if whole in _PEOPLES or single in _PEOPLES:
        return "NORP"
    if single in _PLACES:
        return "GPE"
    if len(words) > 1 and words[-1] in _BODIES:
        return "ORG"
    return "PERSON" if len(words) > 1 and (words[0] in _TITLES or not opens) else None


def found(sentence: str) -> list[tuple[int, int, str, str]]:
    """(start, end, text, label) of a sentence's entities, from left to right."""
    out = []
    for m in CAPITALISED.finditer(sentence):
        kind = label(m[0].lower().split(), m.start() == 0)
        if kind:
            out.append((*m.span(), m[0], kind))
    return out


def compound(sentence: str) -> float:
    """Sentiment in [-1, 1]: valences, turned by a negation in the three words before, moved by a booster just before; s / sqrt(s*s + 15)."""
    words = [w for w in map(str.lower, _WORD.findall(sentence)) if _SOUND.search(w)]
    total, hit = 0.0, False
    for i, w in enumerate(words):
        v = VALENCE.get(w)
        if v is None:
            continue
        hit = True
        if i:
            v += (1 if v > 0 else -1) * BOOSTERS.get(words[i - 1], 0.0)
            if not _NEGATIONS.isdisjoint(words[max(0, i - 3) : i]):
                v *= TURN
        total += v
    return total / (total * total + NORM) ** 0.5 if hit else 0.0


def _sentences(t: str) -> list[tuple[int, float]]:
    return [(i, compound(t[a:b])) for i, (a, b) in enumerate(sentence_spans(t))]


def _mentions(t: str) -> list[tuple[str, str, int, int, int, float]]:
    """(text, label, start, end, sentence, its compound) in order of start, end and label."""
    out = []
    for i, (a, b) in enumerate(sentence_spans(t)):
        if own := found(t[a:b]):
            mood = compound(t[a:b])
            out += [(x, kind, a + s, a + e, i, mood) for s, e, x, kind in sorted(own, key=lambda x: (x[0], x[1], x[3]))]
    return out


def mention_array(body: Column) -> Column:
    """All entities of a text with the sentiment of their sentences, in order of start, end, label: one Arrow pass."""
    kind = "array<struct<text:string,label:string,start_char:int,end_char:int,sentence_id:int,compound:double>>"
    return text_udf(_mentions, kind, text=pa.string(), label=pa.string(), start_char=pa.int32(), end_char=pa.int32(), sentence_id=pa.int32(), compound=pa.float64())(body)


def entities(docs: DataFrame, key: str = "document_id", body: str = "text", labels=LABELS) -> DataFrame:
    """(key, text, label, start_char, end_char, sentence_id), a document's in order of start, end and label. Any other extractor with
    these columns can take its place. No shuffle."""
    return docs.select(key, F.inline(mention_array(F.col(body)))).drop("compound").where(F.col("label").isin(*labels))


def sentence_sentiment(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    mood = text_udf(_sentences, "array<struct<sentence_id:int,compound:double>>", sentence_id=pa.int32(), compound=pa.float64())(F.col(body))
    return docs.select(key, F.inline(mood)).select(key, "sentence_id", F.bround("compound", 6).alias("compound"))


def entity_sentiment(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """(key, entity_key, label of the first mention, mentions, sentence_ids, average_sentiment over the distinct sentences): one pass over the texts."""
    named = docs.select(key, F.inline(mention_array(F.col(body)))).withColumn("entity_key", text.entity_key(F.col("text")))
    by_sentence = named.groupBy(key, "entity_key", "sentence_id").agg(F.count("*").alias("n"), F.min(F.struct("start_char", "end_char", "label")).alias("first"), F.first("compound").alias("compound"))
    return by_sentence.groupBy(key, "entity_key").agg(
        F.min("first")["label"].alias("label"), F.sum("n").alias("mentions"), F.sort_array(F.collect_set("sentence_id")).alias("sentence_ids"), F.bround(F.avg("compound"), 6).alias("average_sentiment")
    )
