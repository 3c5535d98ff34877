"""Removes passages that occur more than once, found through difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c

#: Perfect difference sets (Singer). Every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

OUT = "{id} {type}, n_words long, removed array<struct<start:long,end:long>>, kept_text string"


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, members, anchor width): the sparsest cover whose anchors keep at least a third of the window.

    Two equal windows at i and j have a shift s below the period with i+s and j+s both at cover positions; an anchor of
    window-period+1 words that starts there lies inside both windows, so both send the same anchor.
    """
    period = max(v for v in COVERS if window - v + 1 >= max(1, window // 3))
    return period, COVERS[period], window - period + 1


class _Block:
    """A block's words, its anchors and, once the repeated anchors are known, the windows that hold one."""

    def __init__(self, docs: pa.Table, window: int):
        self.docs, self.window = docs, window
        self.words = c.Words(docs["text"].to_pylist())
        period, members, width = cover(window)
        left, place = self.words.left(), self.words.place()
        here = np.isin(place % period, members) & (left >= width)
        self.at = np.flatnonzero(here)
        self.starts = np.flatnonzero(left >= window)
        self.period, self.width = period, width

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = c.mix(c.window_hash(self.words.hashes, self.width))[self.at] if len(self.at) else np.empty(0, np.uint64)
        first, inverse, times = c.unique_keys(h)
        return h[first], inverse, times

    def candidates(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows with a repeated anchor inside, and two lanes of the hash of each whole window."""
        _, inverse, _ = self.anchors()
        hit = c.reply_arrays(replies, 0)
        if not hit or not hit[0].any():
            return (np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 2)
        marks = np.zeros(len(self.words.hashes) + 1, np.int64)
        marks[self.at + 1] = hit[0][inverse]
        sums = np.cumsum(marks)
        near = sums[np.minimum(self.starts + self.period, len(sums) - 1)] > sums[self.starts]
        starts = self.starts[near]
        h = self.words.hashes
        return starts, c.mix(c.window_hash(h, self.window))[starts], c.window_hash(c.mix(h), self.window, c.BASES[1])[starts]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per row of docs: the id, n_words, the removed word ranges [start, end), and the kept words joined by one space.

    Words are the runs between ASCII white space, unchanged; null and empty texts have none. A word goes when a window of
    ``window`` words around it also starts elsewhere in docs (other rows, or the same row; repeated rows and repeated ids count
    as elsewhere). Documents shorter than a window keep everything. Other columns of docs are ignored.

    Blocks send their distinct anchors (only at cover positions) and learn which are repeated anywhere; the windows
    that hold a repeated anchor are the extension candidates, and their full 128-bit hashes are compared in the same way.
    The text is shuffled once, compressed: all three steps read the same exchange.
    """
    n = c.block_count(docs, text_col)
    buckets = c.bucket_count(n)
    id_type = dict(docs.dtypes)[id_col]
    row = F.struct(F.col(id_col), F.xxhash64(F.col(text_col)))  # repeated ids with other texts need not meet
    dealt = c.pack(docs, c.block_of(row, n), n, id=F.col(id_col), text=F.col(text_col).cast("binary"))

    def send_anchors(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        keys, _, times = _Block(c.unpack(table), window).anchors()
        c.to_buckets(rows, buckets, table["block"][0].as_py(), 0, keys, np.minimum(times, 2).astype(np.uint8))
        return c.blob_table(rows)

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            _, k1, k2 = _Block(c.unpack(table), window).candidates(replies)
            first, _, times = c.unique_keys(k1, k2)
            c.to_buckets(rows, buckets, table["block"][0].as_py(), 1, k1[first], k2[first], np.minimum(times, 2).astype(np.uint8))
        return c.blob_table(rows)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(c.unpack(table), window)
        starts, k1, k2 = block.candidates(replies)
        gone = np.zeros(len(block.words.hashes) + 1, np.int64)
        if len(starts):
            _, inverse, _ = c.unique_keys(k1, k2)
            starts = starts[c.reply_arrays(replies, 1)[0][inverse] > 0]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for text, a, b in zip(block.docs["text"].to_pylist(), block.words.starts.tolist(), block.words.ends.tolist(), strict=True):
            mask, words = gone[a:b], (text or b"").split()
            if mask.any():
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                words = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([block.docs["id"], pa.array(block.words.sizes), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "removed", "kept_text"])

    by_block = dealt.groupBy("block")
    anchors = c.answers(by_block.applyInArrow(c.tidy(send_anchors), c.BLOB_SCHEMA), n, c.repeated)
    windows = c.answers(by_block.cogroup(anchors.groupBy("block")).applyInArrow(c.tidy(send_windows), c.BLOB_SCHEMA), n, c.repeated)
    both = anchors.unionByName(windows)
    out = by_block.cogroup(both.groupBy("block")).applyInArrow(c.tidy(remove), OUT.format(id="id", type=id_type))
    return out.withColumnRenamed("id", id_col)
