"""Finds benchmark passages in documents by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c

#: A-Z lowered; every other ASCII byte that is neither digit nor letter becomes a space.
FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))
SEGMENT = 512


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def folded(texts: list[bytes | None]) -> c.Words:
    """The words of some texts: 64-bit hashes in one array, and where each text's begin and end."""
    return c.Words([t.translate(FOLD) if t else b"" for t in texts])


def _codes(words: np.ndarray, block: int) -> np.ndarray:
    """A number for every run of ``block`` words, by its first place."""
    return c.mix(c.window_hash(words, block)) if len(words) >= block else np.empty(0, np.uint64)


class Matcher:
    """Wu-Manber tables for patterns of one length: runs of the items' words, held by their places only."""

    def __init__(self, words: np.ndarray, first: np.ndarray, length: int):
        self.words, self.first, self.length = words, first, length
        self.block = min(3, length)
        self.codes = _codes(words, self.block)
        most = length - self.block + 1
        self.mask = np.uint64((1 << max(12, int(np.ceil(np.log2(len(words) + 1))) + 3)) - 1)
        self.shift = np.full(int(self.mask) + 1, most, np.uint8 if most < 256 else np.int32)
        for j in range(most):  # a block that ends nearer to a pattern's end allows the smaller shift, and is entered later
            self.shift[(self.codes[first + j] & self.mask).astype(np.int64)] = most - 1 - j
        suffix = self.codes[first + most - 1]
        self.by_suffix = np.argsort(suffix, kind="stable").astype(np.int32)
        self.suffixes, self.at, self.count = np.unique(suffix[self.by_suffix], return_index=True, return_counts=True)

    def search(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence inside the documents words[start:end]; many cursors advance together."""
        windows = np.maximum(ends - starts - self.length + 1, 0)
        parts = -(-windows // SEGMENT)
        doc = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[doc] + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, (starts + windows)[doc])
        codes, places, found = _codes(words, self.block), [], []
        tail = self.length - self.block
        while len(at):
            code = codes[at + tail]
            shift = self.shift[(code & self.mask).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                place, pattern = self._verify(words, codes, at[hit], code[hit])
                places.append(place)
                found.append(pattern)
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(found)

    def _verify(self, words: np.ndarray, codes: np.ndarray, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix bucket gives the patterns, the prefix thins them out, comparing all words decides."""
        bucket = np.minimum(np.searchsorted(self.suffixes, code), len(self.suffixes) - 1)
        real = self.suffixes[bucket] == code
        at, bucket = at[real], bucket[real]
        n = self.count[bucket]
        place = np.repeat(at, n)
        pattern = self.by_suffix[np.repeat(self.at[bucket], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
        same = self.codes[self.first[pattern]] == codes[place]
        place, pattern = place[same], pattern[same]
        for k in range(self.length):
            same = self.words[self.first[pattern] + k] == words[place + k]
            place, pattern = place[same], pattern[same]
        return place, pattern


class Tables:
    """All patterns of a set of items: for each pattern length a matcher, and for each of its patterns the items that have it.

    Only the items themselves travel; the tables are arrays of some 10 bytes a word of theirs, built where they are used.
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.items, self.window, self._built = items, window, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    def matchers(self) -> list[tuple[Matcher, np.ndarray, np.ndarray]]:
        """(matcher, bounds, owners): owners[bounds[p] : bounds[p + 1]] are the numbers of the items with pattern p."""
        if self._built is None:
            own = folded([t for _, t in self.items])
            sizes, self._built = np.minimum(own.sizes, self.window), []
            for length in np.unique(sizes[sizes > 0]).tolist():
                short = sizes == length
                runs = np.where(short, own.sizes - length + 1, 0)
                owner = np.repeat(np.arange(len(runs)), runs)
                place = np.repeat(own.starts, runs) + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
                first, pattern, _ = c.unique_keys(*(c.window_hash(own.hashes, length, b)[place] for b in c.BASES))
                pairs = np.unique(np.stack([pattern, owner]), axis=1)
                self._built.append((Matcher(own.hashes, place[first], length), np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1].astype(np.int32)))
        return self._built


class Shards:
    """The benchmark in shards of bounded text, each broadcast for its pass over the documents."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text: str, window: int, shard_bytes: int):
        c.small_batches(benchmark.sparkSession)
        self.items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text")).where(F.col("text").isNotNull())
        self.count = max(1, -(-(self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
        self.window = window

    def passes(self, rows: DataFrame, step: Callable[[object, bool], Callable], schema) -> DataFrame:
        """The rows after every shard's step. Between two shards the rows are saved and what the first one needed is released."""
        before = None
        for s in range(self.count):
            part, last = self.items.where(F.pmod(F.xxhash64("text"), F.lit(self.count)) == s), s == self.count - 1
            shared = rows.sparkSession.sparkContext.broadcast(Tables([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()], self.window))
            rows = rows.mapInArrow(c.tidy(step(shared, last)), schema)
            if not last:
                rows = c.saved(rows, "searched")
                shared.destroy()
                if before is not None:
                    c.discard(before)
                before = rows
        return rows


class Search:
    """All occurrences in some texts: sizes and bounds of the texts in words, which words are inside one, items by text."""

    def __init__(self, own: Tables, texts: list[bytes | None]):
        words = folded(texts)
        self.sizes, self.starts, self.ends = words.sizes, words.starts, words.ends
        edges = np.zeros(len(words.hashes) + 1, np.int64)
        self.listed: dict[int, set] = defaultdict(set)
        for matcher, bounds, owners in own.matchers():
            place, pattern = matcher.search(words.hashes, self.starts, self.ends)
            edges += np.bincount(place, minlength=len(edges)) - np.bincount(place + matcher.length, minlength=len(edges))
            doc = np.searchsorted(self.ends, place, side="right")
            for d, p in zip(*np.unique(np.stack([doc, pattern]), axis=1).tolist(), strict=True):
                self.listed[d].update(own.items[i][0] for i in owners[bounds[p] : bounds[p + 1]].tolist())
        self.inside = np.cumsum(edges)[:-1] > 0
        self.touched = set(self.listed)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = 8 << 20
) -> DataFrame:
    """One row per row of docs: the id, n_words, hits (ranges [start, end) of words inside an occurrence), items found (distinct).

    Words: A-Z lowered, runs of bytes other than ASCII characters that are neither letter nor digit. An item's patterns are its
    runs of ``window`` words, or all its words where it has fewer; items without words have none. Null texts have no words. Items
    with a null id count as hits but are not listed. Repeated rows give repeated rows; other columns are ignored.

    No shuffle: the tables go to the tasks, for at most ``shard_bytes`` of benchmark text at a time. A larger benchmark
    is cut by a hash into such shards, each searched in a further pass over the same rows, which are saved in between.
    """
    shards = Shards(benchmark, item_col, item_text, window, shard_bytes)
    kind = dict(benchmark.dtypes)[item_col]
    schema = f"id {dict(docs.dtypes)[id_col]}, text binary, n_words long, hits array<struct<start:long,end:long>>, items array<{kind}>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"))
    rows = rows.selectExpr("*", "cast(array() as array<struct<start:long,end:long>>) hits", f"cast(array() as array<{kind}>) items")
    rows = shards.passes(rows, _searcher, schema)
    return rows.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def _searcher(tables, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "text"):
            own = Search(tables.value, batch["text"].to_pylist())
            old_hits, old_items = batch["hits"].to_pylist(), batch["items"].to_pylist()
            hits, items = [], []
            for d in range(batch.num_rows):
                if d not in own.touched:
                    hits.append(old_hits[d])
                    items.append(old_items[d])
                    continue
                mask = own.inside[own.starts[d] : own.ends[d]]
                for h in old_hits[d]:
                    mask[h["start"] : h["end"]] = True
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
                hits.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                items.append(sorted((own.listed[d] - {None}) | set(old_items[d])))
            text = pa.nulls(batch.num_rows, pa.binary()) if last else batch["text"]
            arrays = [batch["id"], text, pa.array(own.sizes), pa.array(hits, batch["hits"].type), pa.array(items, batch["items"].type)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "n_words", "hits", "items"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, that hold no occurrence."""
    shards = Shards(benchmark, item_col, item_text, window, shard_bytes)

    def keeper(tables, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in c.chunks(batches, text_col):
                found = Search(tables.value, [None if t is None else t.encode() for t in batch[text_col].to_pylist()]).touched
                yield batch.filter(pa.array([d not in found for d in range(batch.num_rows)], pa.bool_()))

        return run

    return shards.passes(docs, keeper, docs.schema)
