"""Paragraphs, sentences and tokens with exact offsets into the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.functions.batches import small_batches

PIECES = "array<struct<start:int,text:string>>"
_TOKEN = regex.compile(text.TOKEN.removeprefix("(?U)"))

PARAGRAPH_GAP = r"\n[ \t]*\n\s*"
#: A sentence ends at a full stop, question or exclamation mark, closers after it, and white space.
BOUNDARY = r"""[.!?]["')]*\s+"""
MASK = "\ue000"  # a private character, as long as the stop whose place it takes
#: Words whose stop doesn't end a sentence. Weekdays and months are left out, as they may end one.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Rev Hon St Sr Jr Gen Col Capt Lt Sgt Gov Sen Rep vs etc Inc Ltd Co Corp No Vol Fig approx cf al".split()


_ABBREVIATED = re.compile(r"\b([A-Za-z]+)\.")
_DOTTED = re.compile(r"\b(e\.g|i\.e|a\.m|p\.m)\.")
_INITIAL = re.compile(r"\b([A-Z])\.")
_SPEAKER = re.compile(r"""[.!?](["')]+\s+[a-z])""", re.ASCII)  # a quoted sentence, and the one around it goes on
_DECIMAL = re.compile(r"([0-9])\.([0-9])")
_GAP, _BOUNDARY = re.compile(PARAGRAPH_GAP, re.ASCII), re.compile(BOUNDARY, re.ASCII)
_KNOWN = frozenset(ABBREVIATIONS)
#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def masked(t: str) -> str:
    """The same text, of the same length, without the stops that end no sentence."""
    t = _ABBREVIATED.sub(lambda m: m[1] + (MASK if m[1] in _KNOWN else "."), t)
    t = _DECIMAL.sub(rf"\1{MASK}\2", _INITIAL.sub(rf"\1{MASK}", _DOTTED.sub(rf"\1{MASK}", t)))
    return _SPEAKER.sub(rf"{MASK}\1", t)


def paragraph_spans(t: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks between blank lines, without empty ones."""
    cuts = [x for m in _GAP.finditer(t) for x in m.span()]
    return [(a, b) for a, b in zip([0, *cuts[1::2]], [*cuts[::2], len(t)], strict=True) if a < b]


def sentence_spans(t: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, trimmed: each paragraph is cut where its masked text has a boundary."""
    out = []
    for start, stop in paragraph_spans(t):
        own = t[start:stop]
        ends = [m.end() for m in _BOUNDARY.finditer(masked(own))]
        for a, b in zip([0, *ends], [*ends, len(own)], strict=True):
            whole = own[a:b]
            left = whole.lstrip(WHITE)
            if left := left and (len(whole) - len(left), left.rstrip(WHITE)):
                out.append((start + a + left[0], start + a + left[0] + len(left[1])))
    return out


def per_text(texts: pa.Array, found: Callable[[str], list[tuple]], **fields: pa.DataType) -> pa.Array:
    """An array of structs for each text of a batch, null for a null."""
    sizes, rows = [0], []
    for t in texts.to_pylist():
        if t is not None:
            rows += found(t)
        sizes.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, fields.values(), strict=True)], list(fields))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=texts.is_null() if texts.null_count else None)


def text_udf(found: Callable[[str], list[tuple]], kind: str, **fields: pa.DataType):
    """A function of a column of texts: per_text, slice by slice."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in text.pieces(batch):
                yield per_text(texts, found, **fields)

    return F.arrow_udf(run, kind)


def _sliced(spans: Callable[[str], list[tuple[int, int]]]):
    return text_udf(lambda t: [(a, t[a:b]) for a, b in spans(t)], PIECES, start=pa.int32(), text=pa.string())


def paragraphs(t: Column) -> Column:
    """(start, text) of the blocks between blank lines, without empty ones."""
    return _sliced(paragraph_spans)(t)


def sentence_array(t: Column) -> Column:
    """(start, text) of the sentences. One Arrow pass: built-in functions would cut every piece from the text several times."""
    return _sliced(sentence_spans)(t)


def sentences(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """(key, sentence_id, text, start_char, end_char): dense ids from 0 over the document; text[start:end] is the sentence. No shuffle."""
    small_batches(docs.sparkSession)
    laid = docs.select(key, F.posexplode(sentence_array(F.col(body))).alias("sentence_id", "s"))
    return laid.select(key, "sentence_id", F.col("s.text").alias("text"), F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.text")).alias("end_char"))


def sentence_at(sentences: Column, position: Column) -> Column:
    """The number of the sentence that holds a position in the text, -1 between sentences; sentences as of sentence_array."""
    inside = F.transform(sentences, lambda s, i: F.when((s["start"] <= position) & (position < s["start"] + F.length(s["text"])), i))
    return F.coalesce(F.array_max(inside), F.lit(-1))


def _tokens(t: str) -> list[tuple[int, int, str, int]]:
    out = []
    for number, (a, b) in enumerate(sentence_spans(t)):
        out += [(number, pos, m[0], m.start()) for pos, m in enumerate(_TOKEN.finditer(t, a, b))]
    return out


def tokens(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """(key, sentence_id, pos, text, lower, idx, is_stop, is_punct, lemma); pos counts inside the sentence, idx is the offset in the text.

    The lemma is the word in lower case; a lemmatiser can replace the column. No shuffle.
    """
    small_batches(docs.sparkSession)
    found = text_udf(_tokens, "array<struct<sentence_id:int,pos:int,text:string,idx:int>>", sentence_id=pa.int32(), pos=pa.int32(), text=pa.string(), idx=pa.int32())(F.col(body))
    laid = docs.select(key, F.inline(found)).withColumn("lower", F.lower("text"))
    return laid.select(key, "sentence_id", "pos", "text", "lower", "idx", text.is_stop(F.col("lower")).alias("is_stop"), text.is_punct(F.col("text")).alias("is_punct"), F.col("lower").alias("lemma"))
