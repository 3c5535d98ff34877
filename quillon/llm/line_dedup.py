"""Removes blocks of lines that an earlier document has too, found by patience alignment of overlapping documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs (i, j) with a[i] == b[j], rising in both.

    Equal ends of a range match; between them the lines that are unique in both ranges are anchors, as far as their order agrees
    (longest increasing subsequence); the ranges between anchors are treated alike, until one has no anchor.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        where = {x: k for k, x in enumerate(b[j:n], j) if in_b[x] == 1}
        unique = [(k, where[x]) for k, x in enumerate(a[i:m], i) if in_a[x] == 1 and x in where]
        tails: list[int] = []
        links: list[tuple[int, int]] = []  # index of the tail, of the predecessor
        ends: list[int] = []
        for at, (_, y) in enumerate(unique):
            k = bisect_left(tails, y)
            links.append((k, ends[k - 1] if k else -1))
            tails[k : k + 1], ends[k : k + 1] = [y], [at]
        at, anchors = (ends[-1] if ends else -1), []
        while at >= 0:
            anchors.append(unique[at])
            at = links[at][1]
        if anchors:
            out += anchors
            for x, y in anchors:  # from the last to the first
                todo.append((x + 1, m, y + 1, n))
                m, n = x, y
            todo.append((i, m, j, n))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """The places in b of aligned lines, for runs that are unbroken in both documents and have ``least`` words or more."""
    gone: list[int] = []
    run: list[tuple[int, int]] = []
    for i, j in [*align(a, b), (-1, -1)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= least:
                gone += [y for _, y in run]
            run = []
        run.append((i, j))
    return gone


def _lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def _hash(line: bytes) -> int:
    line = line.strip()
    return xxhash.xxh3_64_intdigest(line) - (1 << 63) if line else 0


_BASE = 0x9E3779B97F4A7C15


def least_blocks(hashes: list[int], words: list[int], least: int) -> np.ndarray:
    """Hashes of the shortest blocks of two lines and ``least`` words or more, from each line on and up to each line.

    Any run of two lines and so many words has one of these blocks in it, so two documents with such a run in common share a hash.
    """
    n = len(hashes)
    at, before = np.arange(n), np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    ends = np.maximum(np.searchsorted(before, before[:-1] + least), at + 2)
    starts = np.minimum(np.searchsorted(before, before[1:] - least, side="right") - 1, at - 1)
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    pairs = np.unique(np.concatenate([ahead * (n + 1) + ends[ahead], starts[back] * (n + 1) + back + 1]))
    starts, ends = pairs // (n + 1), pairs % (n + 1)
    up, down = (np.cumprod(np.array([1] + [x] * n, c.U64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, c.U64), np.cumsum(np.array(hashes, np.int64).view(c.U64) * down[:n])])
    return np.unique(c.mix((sums[ends] - sums[starts]) * up[starts] + c.mix((ends - starts).astype(c.U64)))).view(np.int64)


class _Block:
    """A block's rows in a fixed order, whichever order they came in."""

    def __init__(self, table: pa.Table):
        docs = c.unpack(table)
        docs = docs.append_column("h", pa.array([xxhash.xxh3_64_intdigest(x or b"") for x in docs["text"].to_pylist()], pa.uint64()))
        self.docs = docs.sort_by([("id", "ascending"), ("h", "ascending")])
        self.first = np.int64(table["block"][0].as_py()) << 32

    def nodes(self) -> np.ndarray:
        return self.first + np.arange(self.docs.num_rows)


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, carry: Sequence[str] = (), blocks: bool = False) -> DataFrame:
    """One row per row of docs: the id, n_lines, removed (line numbers from 0), text (what stays, joined by line ends; null
    stays null), and the columns named in ``carry``.

    A line is compared without white space at its ends; blank lines are never shared. Documents are ordered by id (null last,
    equal ids and repeated rows in a fixed order). Each later holder of a shared line is aligned with the line's first holder, its
    representative, however many documents hold the line; the aligned runs of lines with ``least`` words or more are removed from the
    later one. Repetition inside one document stays. All decisions are made on the input, not on what is left.

    With ``blocks``, documents meet through rarer evidence: lines of ``least`` words or more, and hashes of the least blocks of two
    lines and so many words, at most two per line. The first holder of each is aligned with every later one. Hashes only propose
    pairs; what goes is what the alignment gives. Frequent short lines by themselves then form no pairs.

    A pair is formed with the first holder only, so pairs are as many as shared lines at most; the join that brings a first holder's
    lines to its pairs is one that Spark splits where a document is first holder for many. What moves is hashes; the
    text is dealt to blocks once, compressed, and meets its line numbers there.
    """
    n = c.block_count(docs, text_col)
    row = F.struct(F.col(id_col), F.xxhash64(F.col(text_col)))
    kind = dict(docs.dtypes)[id_col]
    dealt = c.pack(docs, c.block_of(row, n), n, id=F.col(id_col), text=F.col(text_col).cast("binary"), **{f"carry{i}": F.col(x) for i, x in enumerate(carry)}).groupBy("block")

    def describe(table: pa.Table) -> pa.Table:
        own = _Block(table)
        texts = [_lines(t) for t in own.docs["text"].to_pylist()]
        hashes, words = [[_hash(x) for x in t] for t in texts], [[len(x.split()) for x in t] for t in texts]
        keys = [least_blocks(*x, least) if blocks else [] for x in zip(hashes, words, strict=True)]
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(own.nodes()), own.docs["id"], pa.array(hashes, longs), pa.array(words, pa.list_(pa.int32())), pa.array(keys, longs)], ["node", "id", "hashes", "words", "keys"])

    base = c.saved(dealt.applyInArrow(c.tidy(describe), f"node long, id {kind}, hashes array<long>, words array<int>, keys array<long>"), "lines")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "node").alias("rank")
    lines = base.select("node", rank, F.explode(F.array_distinct(F.arrays_zip("hashes", "words"))).alias("line"))
    lines = lines.select("node", "rank", F.col("line.hashes").alias("h"), F.col("line.words").alias("n_words")).where("h <> 0")
    held = lines.groupBy("h").agg(F.count("*").alias("holders"), F.min("rank").alias("first")).where("holders > 1")
    if blocks:
        lines = lines.where(F.col("n_words") >= least)
    pairs = lines.join(held.select("h", F.col("first.node").alias("first")), "h").where("node <> first").select("node", "first")
    if blocks:
        named = base.select("node", rank, F.explode("keys").alias("h"))
        first = named.groupBy("h").agg(F.count("*").alias("holders"), F.min("rank").alias("first")).where("holders > 1")
        pairs = pairs.unionByName(named.select("node", "h").join(first.select("h", F.col("first.node").alias("first")), "h").where("node <> first").select("node", "first"))
    pairs = c.saved(pairs.distinct(), "pairs")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(*x, least) for x in zip(*(batch[k].to_pylist() for k in ("a", "b", "words")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(gone, pa.list_(pa.int64()))], ["node", "gone"])

    pairs = pairs.join(base.select(F.col("node").alias("first"), F.col("hashes").alias("a")), "first").join(base.select("node", F.col("hashes").alias("b"), "words"), "node")
    by_pair = pairs.select("node", "a", "b", "words").mapInArrow(c.tidy(aligned), "node long, gone array<long>").select("node", F.explode("gone").alias("place"))
    gone = by_pair.groupBy("node").agg(F.collect_set("place").alias("places"))
    gone = gone.withColumn("block", F.shiftright("node", 32).cast("int"))

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        own = _Block(table)
        by_node = {r["node"]: r["places"] for r in found.to_pylist()}
        count, removed, texts = [], [], []
        for node, text in zip(own.nodes().tolist(), own.docs["text"].to_pylist(), strict=True):
            lines = _lines(text)
            out = sorted(by_node.get(node, ()))
            count.append(len(lines))
            removed.append(out)
            drop = set(out)
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if out else text)
        arrays = [own.docs["id"], pa.array(count, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())]
        more = [f"carry{i}" for i in range(len(carry))]
        return pa.table([*arrays, *(own.docs[x] for x in more)], ["id", "n_lines", "removed", "text", *more])

    types = dict(docs.dtypes)
    schema = ", ".join([f"id {kind}, n_lines long, removed array<long>, text string", *(f"carry{i} {types[x]}" for i, x in enumerate(carry))])
    out = dealt.cogroup(gone.groupBy("block")).applyInArrow(c.tidy(remove), schema)
    return out.select(F.col("id").alias(id_col), "n_lines", "removed", F.col("text").alias(text_col), *(F.col(f"carry{i}").alias(x) for i, x in enumerate(carry)))
