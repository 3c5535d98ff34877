"""Variant spellings of words: pairs one edit apart, found by letter-parity masks, and the usual form that each rare one stands for.

A word's mask has a bit for each letter class, set if the word has an odd number of its letters. One inserted or deleted letter flips
one bit, one replaced letter two at most; so of three bands of bits one at least is the same in both words. Words of one band value
are still far too many at scale. What the edit leaves alone splits them further without losing a pair: it stands either
behind or before the middle, so the first or the last half of both words agrees too. Joined are hence words that share a band, a
length (of the shorter one) and a half; a pair counts at the first band and half that it shares, so no pair is made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c

BITS, BANDS = 60, 3
#: The letters of each band stand BANDS apart, so that frequent and rare ones are spread evenly.
BAND_MASKS = [sum(1 << i for i in range(b, BITS, BANDS)) for b in range(BANDS)]
LETTERS = "[A-Za-zÀ-ÿ]"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, no other letter changed."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(text.rlike("[A-Z]"), F.translate(text, upper, upper.lower())).otherwise(text)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, letters: str = LETTERS) -> DataFrame:
    """(key, run): every maximal run of at least ``least`` letters in the whole texts, A-Z in lower case, as often as it occurs."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{letters}{{{least},}}+"), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(found).alias("run")).select("key", lower_ascii(F.col("run")).alias("run"))


def mask(word: str = "word") -> Column:
    return F.expr(f"aggregate(split({word}, ''), 0L, (m, x) -> m ^ shiftleft(1L, ascii(x) % {BITS}))")


def _signatures(words: DataFrame, longer: bool) -> DataFrame:
    """(sig, band, side, word, mask, n), six rows a word: as a word of its own length, or as the longer one of a pair."""
    size = F.length("word") - (1 if longer else 0)
    half = F.floor(size / 2).cast("int")
    sides = [F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), half + (2 if longer else 1), size)]
    made = [
        F.struct(F.lit(b).alias("band"), F.lit(s).alias("side"), F.xxhash64(F.lit(b), F.col("mask").bitwiseAND(F.lit(bits)), size, F.lit(s), own).alias("sig"))
        for b, bits in enumerate(BAND_MASKS)
        for s, own in enumerate(sides)
    ]
    return words.select("word", "mask", "n", F.inline(F.array(*made)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) for every two of the distinct words (word, n) that one inserted, deleted or replaced code point makes equal; each pair once."""
    masked = words.select("word", "n", mask().alias("mask"))
    left = _signatures(masked, longer=False)
    right = left.withColumn("longer", F.lit(False)).unionByName(_signatures(masked, longer=True).withColumn("longer", F.lit(True)))
    a, b = left.alias("a"), right.alias("b")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(flips.bitwiseAND(F.lit(BAND_MASKS[i])) == 0, i).otherwise(first)
    half = F.floor(F.length("a.word") / 2).cast("int")
    head = F.substring(F.col("a.word"), F.lit(1), half) == F.substring(F.col("b.word"), F.lit(1), half)
    once = (F.col("a.band") == first) & (F.bit_count(flips) <= 2) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & (F.col("a.side") == F.when(head, 0).otherwise(1))
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.side") == F.col("b.side"))
    pairs = a.join(b, same & once & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the ends of the chains, by doubling; a form is always more frequent than its word, so there are no circles."""
    ends = c.saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = ends.toDF("root", "end")
        if ends.join(further, "root", "left_semi").isEmpty():
            return ends
        before, ends = ends, c.saved(ends.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root")), "forms")
        c.discard(before)


def group(occurrences: DataFrame, word: str = "word", least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word that occurs ``least`` times or more.

    The form is the most frequent near word (ties: the first in code-point order) if it is ``times`` as frequent as the word or more.
    Null words are left out; the table may be empty; no other column is read. Words are held once each, whatever their number.
    """
    counted = occurrences.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    words = c.saved(counted.where(F.col("n") >= least), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    linked = c.saved(words.join(best, "word", "left"), "near")
    usual = -F.col("best.less") >= times * F.col("n")
    rows = linked.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.other")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
