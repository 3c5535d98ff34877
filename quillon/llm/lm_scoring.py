"""An n-gram language model by deleted interpolation, counted over the whole corpus, and its score of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c

BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
BEGIN_KEY = c.mix(np.array([BEGIN]))[0]
CELL = 1024  # values a probability takes in the histogram, 0 for none
ASKED = 2  # n-grams up to this length are sent whole; longer ones only where others may have them
SUMS = 0  # kind of the rows that carry a bucket's token and type counts


class _Block:
    """A block's token sequences (begin, words, end), and the index of each n-gram among the block's distinct ones."""

    def __init__(self, table: pa.Table, order: int):
        self.docs, self.order = c.unpack(table), order
        words = c.Words(self.docs["text"].to_pylist(), lower=True)
        size = words.sizes + 2
        ends = np.cumsum(size)
        s = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        inner = np.ones(len(s), bool)
        s[ends - size], s[ends - 1] = BEGIN, END
        inner[ends - size] = inner[ends - 1] = False
        s[inner] = words.hashes
        self.n_words, self.doc = words.sizes, np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(s)) - np.repeat(ends - size, size)
        left = np.repeat(size, size) - self.place
        self.grams = []
        for k in range(1, order + 1):
            at = np.flatnonzero(left >= k)
            keys = c.mix(c.window_hash(s, k))[at] if len(at) else np.empty(0, np.uint64)
            first, inverse, _ = c.unique_keys(keys)
            self.grams.append((at, keys[first], inverse))

    def times(self, k: int) -> np.ndarray:
        """How often each distinct k-gram occurs in the block's texts that are learned from."""
        at, keys, inverse = self.grams[k - 1]
        learned = self.docs["train"].to_numpy(zero_copy_only=False)[self.doc]
        return np.bincount(inverse, weights=learned[at], minlength=len(keys)).astype(np.int64)

    def totals(self, replies: pa.Table, k: int, held: bool) -> tuple[np.ndarray, np.ndarray]:
        """The corpus' count of each distinct k-gram, and for a held-out block how much of it is held out; held: is this block?

        What no other block has is counted as the block itself counts it.
        """
        total, asked = self.times(k), self.asked(replies, k)
        out = total * held
        if asked.any():
            flags, *counts = c.reply_arrays(replies, k)
            asked[asked] = flags.astype(bool)
            for own, whole in zip((total, out), counts, strict=False):
                own[asked] = whole
        return total, out

    def shared(self, replies: pa.Table, k: int) -> np.ndarray:
        """Which of the distinct k-grams other blocks have too. A long one that isn't asked for occurs in this block only."""
        out = self.asked(replies, k)
        if out.any():
            out[out] = c.reply_arrays(replies, k)[0].astype(bool)
        return out

    def asked(self, replies: pa.Table, k: int) -> np.ndarray:
        """Which of the distinct k-grams are sent: of the long ones those whose both (k-1)-grams other blocks have too, learned or not."""
        at, keys, inverse = self.grams[k - 1]
        if k <= ASKED:
            return np.ones(len(keys), bool)
        part, _, index = self.grams[k - 2]
        elsewhere = np.zeros(len(self.doc) + 1, bool)
        elsewhere[part] = self.shared(replies, k - 1)[index]
        mask = np.zeros(len(keys), bool)
        mask[inverse[elsewhere[at] & elsewhere[at + 1]]] = True
        return mask

    def counts(self, replies: pa.Table, held: bool, deleted: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each token but the beginnings, in the order of the text: the document, its n-grams' counts, their contexts'."""
        ended = []
        for k, (at, _, inverse) in enumerate(self.grams, 1):
            total, out = self.totals(replies, k, held)
            full = np.zeros(len(self.doc), np.int64)
            full[at + k - 1] = (total - out * deleted)[inverse]
            ended.append(full)  # by the place at which the n-gram ends
        target = np.flatnonzero(self.place > 0)
        context = [np.where(self.place[target] >= k, x[target - 1], 0) for k, x in enumerate(ended[:-1], 1)]
        return self.doc[target], [x[target] for x in ended], context


def _probabilities(tokens: int, types: int, counts: list[np.ndarray], context: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The estimates by order (0: uniform) as rows, the highest order whose context has been seen, log2 of that context's count."""
    p = [np.full(len(counts[0]), 1.0 / (types + 1)), counts[0] / max(tokens, 1)]
    top, bucket = np.ones(len(counts[0]), np.int64), np.zeros(len(counts[0]), np.int64)
    for k, seen in enumerate(context, 2):
        p.append(np.where(seen > 0, counts[k - 1] / np.maximum(seen, 1), 0.0))
        top = np.where(seen > 0, k, top)
        bucket = np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64), bucket)
    return np.stack(p), top, bucket


def expectation_maximisation(p: np.ndarray, times: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Mixture weights for rows of component probabilities p, each row seen ``times`` times; one pseudo-count per component."""
    weights, before = np.full(p.shape[1], 1.0 / p.shape[1]), -np.inf
    for _ in range(rounds):
        joint = p * weights
        total = joint.sum(1)
        likelihood = float(np.sum(times * np.log(total)))
        expected = (joint * (times / total)[:, None]).sum(0) + 1.0
        weights = expected / expected.sum()
        if likelihood - before <= tolerance * abs(likelihood):
            break
        before = likelihood
    return weights


def grid_of(order: int) -> int:
    """Steps of log2 of a probability in the histogram: fewer where it has more dimensions."""
    return 8 if order < 3 else 4


def _fit(cells: np.ndarray, times: np.ndarray, order: int, types: int) -> np.ndarray:
    """weights[top order, bucket, order]: EM in each context-frequency bucket; an unseen bucket takes its order's pooled weights."""
    weights, q, grid = np.zeros((order + 1, 64, order + 1)), [], grid_of(order)
    for _ in range(order):
        q.insert(0, cells % CELL)
        cells = cells // CELL
    p = np.stack([np.full(len(times), 1.0 / (types + 1)), *(np.where(x > 0, np.exp2((x - CELL + 1) / grid), 0.0) for x in q)], 1)
    for top in range(1, order + 1):
        own = cells // 64 == top
        weights[top, :, : top + 1] = 1.0 / (top + 1)
        if own.any():
            weights[top, :, : top + 1] = expectation_maximisation(p[own, : top + 1], times[own])
            for b in np.unique(cells[own] % 64):
                part = cells == top * 64 + b
                weights[top, b, : top + 1] = expectation_maximisation(p[part, : top + 1], times[part])
    return weights


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, held_share: int = 8) -> DataFrame:
    """One row per row of docs: id, train (bool), n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the runs between ASCII white space with A-Z lowered, then one end token; a null or empty text is its end
    token. ``train`` marks the rows that are learned from (null counts as true). Of these, one in ``held_share`` is held
    out: the mixture weights of each context-frequency bucket (log2 of the context's count) come from EM over
    its tokens, whose own counts are deleted from the estimates they are predicted with. The final estimates use all training
    counts. Repeated rows and ids count each; an empty table gives no rows; other columns are ignored.

    Counts travel through the exchange of ``common`` (one entry per block and distinct n-gram), words and pairs first. A longer n-gram
    can only be in two blocks if both n-grams one shorter inside it are: only such ones are sent, in an exchange for each
    length, and the counts of the others are their block's own. No n-gram is pruned. The driver sees a histogram of (bucket,
    log2 of the estimates in steps of 1/8, or 1/4 from order 3 on): its size is bounded by the grid, not by the corpus.
    """
    if not 1 <= order <= 5:
        raise ValueError("order must be from 1 to 5")
    n = c.block_count(docs, text_col)
    held_blocks = max(1, n // held_share)
    total = n + held_blocks
    buckets = c.bucket_count(total)
    train = F.coalesce(train, F.lit(True))
    row = F.struct(F.col(id_col), F.xxhash64(F.col(text_col)))
    held = train & (F.pmod(F.xxhash64(row, F.lit("held")), F.lit(held_share)) == 0)
    block = F.when(held, F.lit(n) + c.block_of(row, held_blocks)).otherwise(c.block_of(row, n))
    columns = {"id": F.col(id_col), "text": F.col(text_col).cast("binary"), "train": train}
    dealt = c.pack(docs, block, total, **columns)

    def send(table: pa.Table) -> pa.Table:
        own, number = _Block(table, min(order, ASKED)), table["block"][0].as_py()
        rows: list[tuple] = []
        for k, (_, keys, _) in enumerate(own.grams, 1):
            times = own.times(k).astype(np.uint32)
            c.to_buckets(rows, buckets, number, k, keys, times, times * np.uint32(number >= n))
        return c.blob_table(rows)

    def send_longer(k: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            own, number = _Block(table, k), table["block"][0].as_py()
            rows: list[tuple] = []
            asked, times = own.asked(answers, k), own.times(k).astype(np.uint32)
            c.to_buckets(rows, buckets, number, k, own.grams[k - 1][1][asked], times[asked], times[asked] * np.uint32(number >= n))
            return c.blob_table(rows)

        return run

    def merge(kind: int, columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple]]:
        keys = columns[0]
        first, inverse, blocks = c.unique_keys(keys)
        sums = [np.bincount(inverse, weights=x).astype(np.int64) for x in columns[1:]]
        more = []
        if kind == 1:
            real = keys[first] != BEGIN_KEY
            kept = sums[0] - sums[1]
            more = [(-1, -1, SUMS, c.pack_arrays(np.array([x[real].sum() for x in (sums[0], sums[0] > 0, kept, kept > 0)], np.int64)))]
        narrow = [x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x for x in sums]
        return [*(x[inverse] for x in narrow), (blocks > 1).astype(np.uint8)[inverse]], more

    def brief(block: int, arrays: list[np.ndarray]) -> list[np.ndarray]:
        """Which n-grams other blocks have too, and the counts of those; only held-out blocks need to know how much of them is held out."""
        shared = arrays[2].astype(bool)
        return [arrays[2], *(x[shared] for x in arrays[: 1 + (block >= n)])]

    replies = c.saved(c.answers(dealt.groupBy("block").applyInArrow(c.tidy(send), c.BLOB_SCHEMA), total, merge, brief), "counts")
    for k in range(ASKED + 1, order + 1):
        met = replies.where(F.col("block") >= 0).groupBy("block")
        longer = dealt.groupBy("block").cogroup(met).applyInArrow(c.tidy(send_longer(k)), c.BLOB_SCHEMA)
        replies = replies.unionByName(c.saved(c.answers(longer, total, merge, brief), f"counts{k}"))

    def read_sums(batches):
        for b in batches:
            got = np.array([c.unpack_arrays(x)[0] for x in b["data"].to_pylist()], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(4)], ["tokens", "types", "kept_tokens", "kept_types"])

    sums = replies.where(F.col("kind") == SUMS).select("data").mapInArrow(c.tidy(read_sums), "tokens long, types long, kept_tokens long, kept_types long")
    with c.shuffles_removed(docs.sparkSession):
        tokens, types, kept_tokens, kept_types = (int(x or 0) for x in sums.groupBy().sum().first())

    def histogram(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, counts, context = _Block(table, order).counts(answers, held=True, deleted=True)
        p, top, bucket = _probabilities(kept_tokens, kept_types, counts, context)
        cell = top * 64 + bucket
        for k in range(1, order + 1):
            real = (p[k] > 0) & (top >= k)
            cell = cell * CELL + np.where(real, CELL - 1 + np.round(np.log2(np.where(real, p[k], 1.0)) * grid_of(order)), 0).astype(np.int64)
        cells, times = np.unique(cell, return_counts=True)
        return pa.table([cells, times], ["cell", "times"])

    cells = c.pack(docs.where(held), block, total, **columns).groupBy("block").cogroup(replies.where(F.col("block") >= n).groupBy("block"))
    cells = cells.applyInArrow(c.tidy(histogram), "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    with c.shuffles_removed(docs.sparkSession):
        found = cells.toPandas()
    weights = _fit(found["cell"].to_numpy(np.int64), found["times"].to_numpy(float), order, kept_types)

    def scores(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, order)
        doc, counts, context = own.counts(answers, held=table["block"][0].as_py() >= n, deleted=False)
        p, top, bucket = _probabilities(tokens, types, counts, context)
        mixed = np.einsum("ij,ji->i", weights[top, bucket], p)
        base = (counts[0] + 1) / (tokens + types + 1)
        size = len(own.n_words)
        out = [own.docs["id"], own.docs["train"], pa.array(own.n_words + 1), pa.array(np.bincount(doc, counts[0] > 0, size).astype(np.int64)), pa.array(np.full(size, tokens))]
        out += [pa.array(np.bincount(doc, np.log10(x), size)) for x in (base, mixed)]
        return pa.table(out, ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {dict(docs.dtypes)[id_col]}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = replies.where(F.col("block") >= 0)
    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(c.tidy(scores), schema).withColumnRenamed("id", id_col)
