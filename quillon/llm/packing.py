"""Packs tokenised documents into sequences of bounded length: best fit over a histogram of lengths."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common as c


#: The normaliser and pre-tokeniser of a tokenizer file whose texts may be cut at white space and at punctuation.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
SPACE, LETTER, LATIN, MARK, OTHER = range(5)  # kinds of bytes; LATIN begins a letter of two bytes


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[list(b" \t\n\r\x0b\x0c")] = SPACE
    kind[97:123] = LETTER
    kind[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = MARK  # all but the apostrophe, which can begin a word's ending
    kind[0xC3] = LATIN
    return kind


KIND = _kinds()
LATIN_LETTER = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])  # U+00C0 to U+00FF but two signs
BREAK, HOLE = b"\n", b"\r"  # stand for the end of a text and for a run that is encoded by itself


def _word_engine(spec: dict):
    """Encodes many words at once: a byte-pair encoder with the file's own ranks, a space being the end of a word.

    Merging by the rank of the result equals merging by listed pairs where each result has one pair and ids follow the order of
    the merges: None where the file isn't so.
    """
    model = spec.get("model", {})
    vocab, merges = model.get("vocab"), model.get("merges")
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or len(vocab) <= len(merges) or len({"".join(x) for x in merges}) < len(merges):
        return None
    first = vocab["".join(merges[0])] if merges else 0
    if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)) or first < 512:
        return None
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte-level alphabet
    letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    ranks = {}
    for token, number in vocab.items():
        body = token.removesuffix("</w>")
        if number < first + len(merges) and all(x in letters for x in body):
            ranks[bytes(letters[x] for x in body) + (b" " if body != token else b"")] = number
    if any(bytes([b]) not in ranks or bytes([b, 32]) not in ranks for b in range(256)):
        return None
    import tiktoken

    signs = {x: ranks[x + b" "] for x in (BREAK, HOLE)}
    return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), signs


class Reader:
    """Token ids of many texts at once.

    Fast only for tokenizers whose file says that tokens never span white space, that case is dropped, and that letters stand apart
    from punctuation (SPLITTING): there the ids of a text are those of its runs between white space, one after the other, and
    those of a run of plain letters (ASCII, Latin-1: no normalisation changes them but lower case) with punctuation after it are
    those of the two. Such runs go to one byte-pair pass; any other run goes to the tokenizer by itself, and with any other file the whole text does.
    """

    LIMIT = 50_000  # other runs kept, of up to 64 bytes

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        added = [x.get("content", "") for x in spec.get("added_tokens", [])]
        free = all(spec.get(k) is None for k in ("post_processor", "truncation", "padding")) and all(x.startswith("<|") and x.split() == [x] for x in added)
        self.engine = _word_engine(spec) if free and all(spec.get(k) == v for k, v in SPLITTING.items()) else None
        self.kept: dict[bytes, np.ndarray] = {}

    def _alone(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _others(self, runs: list[bytes]) -> list[np.ndarray]:
        if len(self.kept) > self.LIMIT:
            self.kept.clear()
        known = self.kept
        new = list({x for x in runs if x not in known})
        found = dict(zip(new, self._alone(new), strict=True))
        known.update((x, v) for x, v in found.items() if len(x) <= 64)
        return [found[x] if x in found else known[x] for x in runs]

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """One array (little-endian, 32 bit) per text."""
        texts = [t or b"" for t in texts]
        if self.engine is None or not texts:
            return self._alone(texts)
        encoder, first = self.engine
        end = np.cumsum([len(t) + 3 for t in texts]) - 2  # the place of each text's BREAK, between spaces
        given = b"".join(t + b" \n " for t in texts)
        raw = np.frombuffer(given.lower(), np.uint8).copy()
        kind = KIND[raw]
        kind[end] = MARK
        latin = np.flatnonzero(kind == LATIN)
        latin = latin[LATIN_LETTER[raw[latin + 1]]]
        kind[latin] = kind[latin + 1] = LETTER
        upper = latin[raw[latin + 1] < 0x9F] + 1
        raw[upper] += 32
        raw[kind == SPACE] = 32
        raw[end] = 10
        odd = kind >= OTHER
        odd |= kind == LATIN
        odd[1:] |= (kind[1:] == LETTER) & (kind[:-1] == MARK)
        odd[1:] |= (raw[1:] == 0x7C) & (raw[:-1] == 0x3C)  # the name of a special token counts as it is written
        gap = kind == SPACE
        holes = []
        if odd.any():
            number = np.cumsum(gap)
            bounds = np.concatenate([[-1], np.flatnonzero(gap)])
            bad = np.unique(number[odd])
            a, b = bounds[bad] + 1, bounds[bad + 1]
            holes = self._others([given[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[a] += 1
            inside[b] -= 1
            keep = np.cumsum(inside[:-1]) == 0
            keep[a] = True
            raw[a], kind[a] = 13, MARK
            raw, kind = raw[keep], kind[keep]
        cuts = np.flatnonzero((kind[1:] == MARK) & (kind[:-1] == LETTER)) + 1  # a run of letters ends at punctuation
        ids = np.array(encoder.encode_ordinary(np.insert(raw, cuts, 32).tobytes().decode()), "<u4")
        at_hole = ids == first[HOLE]
        if holes:
            size = np.ones(len(ids), np.int64)
            size[at_hole] = [len(x) for x in holes]
            at_hole, ids = np.repeat(at_hole, size), np.repeat(ids, size)
            ids[at_hole] = np.concatenate(holes)
        stops = np.flatnonzero((ids == first[BREAK]) & ~at_hole).tolist()
        return [ids[x:y] for x, y in zip([0, *(x + 1 for x in stops[:-1])], stops, strict=True)]


_readers: dict[int, Reader] = {}


def _reader(tokenizer_json: str) -> Reader:
    key = hash(tokenizer_json)
    if key not in _readers:
        _readers[key] = Reader(tokenizer_json)
    return _readers[key]


def tokenised(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids): the pieces of each document's ids and its end id, capacity at most."""
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        for batch in c.chunks(batches, "text", 2 << 20):
            source, rows, bodies = [], [], []
            for i, ids in enumerate(reader.ids(batch["text"].to_pylist())):
                data = ids.tobytes() + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    source.append(i)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    bodies.append(part if keep_ids else None)
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            arrays = [batch["id"].take(pa.array(source, pa.int32())), pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, k]) for k in (1, 2, 3)), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(c.tidy(run), f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: runs (length, first rank, ranks, first sequence, per sequence, offset).

    The items of a length with ranks first..first+ranks-1 go ``per sequence`` at a time to consecutive sequences, side by side
    from ``offset``. Open sequences are kept as ranges by free space, so the work follows the number of lengths, not items.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    runs, opened = [], 0

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                insort(spaces, space)
                free[space] = []
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                fresh = -(-left // (capacity // length))
                put(capacity, opened, fresh)
                opened += fresh
                continue
            space = spaces[i]
            first, count = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(i)
            per = min(space // length, left)
            used = min(left // per, count)
            runs.append((length, rank, used * per, first, per, capacity - space))
            put(space - per * length, first, used)
            put(space, first + used, count - used)
            rank, left = rank + used * per, left - used * per
    return runs


RUN = "length long, first_rank long, ranks long, first_sequence long, per long, base long"


def pack(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = True, salts: int = 1024
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian, 32 bit) with keep_ids.

    A document is its token ids and ``end_id``; null and empty texts are the end id alone. Only documents longer than ``capacity``
    are cut. Sequences hold whole pieces, gapless from offset 0. Repeated rows and ids are packed each; other columns are ignored.
    Any tokenizer file will do: one that says that it splits at white space is applied to runs of text, any other to whole texts.

    The driver sees the histogram of lengths, ``capacity`` rows at most, and plans on counts. A piece's rank within its length is
    its rank within (length, salt) plus the sizes of the lesser salts, so a length that many share is ranked by many tasks.
    The plan's runs, a few per length, are broadcast: their number is bounded by the capacity, not by the documents.
    """
    spark = docs.sparkSession
    pieces = tokenised(docs, tokenizer_json, id_col, text_col, capacity, end_id, keep_ids).withColumn("row", F.monotonically_increasing_id())
    pieces = c.saved(pieces, "pieces").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))  # row numbers are fixed once written
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sizes = c.saved(sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), RUN)
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(sizes.drop("n"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("per") * F.col("length")).alias("offset"), *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary), from the rows of pack() with ids. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
