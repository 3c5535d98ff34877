"""Scalar functions over text, as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words of English, by part of speech: articles, pronouns, prepositions, conjunctions, auxiliaries, other small words.
STOP_WORDS = (
    "a an the "
    "he her hers herself him himself his i it its itself me mine my myself one our ours ourselves she their theirs them themselves they this that these those us we what which who whom whose you your yours yourself "
    "about across after against along among around at before behind beside between beyond by down during for from in into of off on onto out over past per through to toward under until up upon with within without "
    "although and as because but if nor or since so than though unless whether while yet "
    "am are be been being can could did do does doing done had has have having is may might must shall should was were will would "
    "again all also any both each even ever every few here how more most much no not now only other own same some such there then too very when where why"
).split()

#: A word with inner apostrophes, or one other character that is no white space.
TOKEN = r"(?U)[\p{L}\p{N}_\p{M}]+(?:['’][\p{L}\p{N}_\p{M}]+)*|[^\p{L}\p{N}_\p{M}\s]"
#: Names of text columns, the first that isn't blank wins.
TEXT_KEYS = ("raw_content", "full_raw_text", "extracted_text", "plain_text", "text", "content")


#: Bytes of text whose results are Python objects at the same time; a batch of Spark's has 10,000 texts, whatever their size.
PIECE = 1 << 18


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch in slices of about PIECE bytes in the first of them: what Python makes of one is gone before the next."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
        yield tuple(c.slice(at, end - at) for c in columns)
        at = end


def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (texts,) in pieces(batch):
            yield pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """NFC; Spark has no function for it. Only texts that aren't pure ASCII are sent through Arrow, the others as nulls."""
    return F.coalesce(F.arrow_udf(_nfc, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def document_id(text: Column) -> Column:
    return F.sha2(text, 256)


def file_digest(document: Column) -> Column:
    return F.substring(document, 1, 16)


def is_punct(token: Column) -> Column:
    """No letter or digit in it; a lone underscore counts as punctuation."""
    return ~token.rlike(r"[\p{L}\p{N}]")


def is_stop(lower: Column) -> Column:
    return lower.isin(*STOP_WORDS)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Tokens that aren't punctuation."""
    return F.size(F.filter(tokens(text), lambda t: ~is_punct(t)))


def white_words(text: Column) -> Column:
    """Runs between white space."""
    return F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")))


def line_endings(text: Column) -> Column:
    """CRLF, LF, CR or Unknown, by the first 1,000 characters."""
    head = F.substring(text, 1, 1000)
    return F.when(F.contains(head, F.lit("\r\n")), "CRLF").when(F.contains(head, F.lit("\n")), "LF").when(F.contains(head, F.lit("\r")), "CR").otherwise("Unknown")


def html_version(html: Column) -> Column:
    low = F.lower(html)
    return F.when(F.contains(low, F.lit("<!doctype html>")), "HTML5").when(F.contains(low, F.lit("xhtml")), "XHTML").when(F.contains(low, F.lit("html 4")), "HTML4").otherwise("Unknown")


def entity_key(text: Column) -> Column:
    """Lower case, single spaces, then a leading the, a, an taken off one after the other."""
    key = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    for article in ("the ", "a ", "an "):
        key = F.regexp_replace(key, "^" + article, "")
    return key


def plain_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def context(text: Column, start: Column, end: Column, margin: int = 60) -> Column:
    """The stretch around a span, clamped to the text, line ends as spaces."""
    low = F.greatest(start - margin, F.lit(0))
    return F.replace(F.substring(text, low + 1, end + margin - low), F.lit("\n"), F.lit(" "))


def slug(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def trim_at_paragraph(text: Column, most: int) -> Column:
    """At most so many characters, cut back to the last blank line."""
    cut = F.substring(text, 1, most)
    blocks = F.split(cut, "\n\n", -1)
    whole = F.when(F.size(blocks) > 1, F.array_join(F.slice(blocks, F.lit(1), F.size(blocks) - 1), "\n\n")).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(whole)


def first_text(columns: dict[str, Column]) -> Column:
    """The first column of TEXT_KEYS that isn't blank; null if none."""
    return F.coalesce(*(F.when(F.trim(columns[k]) != "", columns[k]) for k in TEXT_KEYS if k in columns), F.lit(None).cast("string"))


def round_to(value: Column, places: int = 6) -> Column:
    return F.bround(value, places)


def bucket_of(position: Column, n: int) -> Column:
    """Round-robin: item i goes to bucket i mod n."""
    return F.pmod(position, F.lit(n))
