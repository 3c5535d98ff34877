import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quillon.llm import common as c
from quillon.llm import lm_scoring, substring_dedup
from tests.llm import brute
from tests.llm.test_lm_scoring import base


def test_words_are_runs_between_white_space():
    texts = [None, "", " ", "a  b\tc\x0bd\x0ce\rf\ng", "é\x1cx y\x85z w", "Ab aB " + "long" * 70 + " " + "long" * 70 + "x", "x" * (c.CHUNK + 5) + " tail"]
    own = c.Words([t if t is None else t.encode() for t in texts], lower=True)
    want = [(t or "").encode().lower().split() for t in texts]
    assert own.sizes.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(flat)) == len(set(own.hashes.tolist())) == len(set(zip(flat, own.hashes.tolist(), strict=True)))


def test_blobs_at_two_sizes():
    assert [c.bucket_count(n) for n in (1, 8, 256, 300, 4096, 5000, 125_000)] == [1, 8, 256, 256, 256, 313, 7813]


@pytest.mark.parametrize("few", [1, 2])
def test_buckets_in_slices_give_the_same(spark, monkeypatch, few):
    """Many small blocks, few buckets."""
    monkeypatch.setattr(c, "FEW_BLOCKS", few)
    monkeypatch.setattr(c, "BLOCK_BYTES", 400)
    r = random.Random(few)
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(40))) + (f" {passage}" if i % 3 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert sorted((x.doc_id, x.n_words, sum(s["end"] - s["start"] for s in x.removed)) for x in rows) == sorted(x[:3] for x in brute.substring(docs))
    from pyspark.sql import functions as F

    got = sorted(lm_scoring.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect())
    assert np.allclose([x.base_score for x in got], [w[5] for w in sorted(base(docs))])


def shuffled_bytes(spark):
    """Bytes of the shuffle files that now lie in Spark's local folders."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*") if f.exists())


def test_no_shuffle_files_are_left_between_steps(spark):
    """What one step shuffled is gone before the next one runs: disk is the largest step's, not the sum of all."""
    r = random.Random(5)
    docs = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(300))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    setting, before = spark.conf.get(c.CLEANUP, None), shuffled_bytes(spark)
    c.saved(df.repartition(4, "doc_id"), "test")
    assert shuffled_bytes(spark) <= before
    out = lm_scoring.score(df, F.col("doc_id") % 7 != 2)
    assert shuffled_bytes(spark) - before < 0.05 * sum(len(t) for _, t in docs)
    assert spark.conf.get(c.CLEANUP, None) == setting
    assert out.count() == out.count() == len(docs)


def test_brief_replies(spark):
    """Counts only of keys that two blocks have; the second column for one block only."""

    def send(table):
        rows, block = [], table["block"][0].as_py()
        keys = np.arange(block, block + 3, dtype=np.uint64) << np.uint64(61)  # 0 1 2, 1 2 3
        c.to_buckets(rows, 2, block, 1, keys, np.full(3, block + 1))
        return c.blob_table(rows)

    def merge(kind, columns):
        _, inverse, blocks = c.unique_keys(columns[0])
        total = np.bincount(inverse, weights=columns[1]).astype(np.int64)
        return [total[inverse], columns[1], (blocks > 1).astype(np.uint8)[inverse]], []

    def brief(block, arrays):
        shared = arrays[2].astype(bool)
        return [arrays[2], *(x[shared] for x in arrays[: 1 + block])]

    blobs = spark.range(2).select(F.col("id").cast("int").alias("block")).groupBy("block").applyInArrow(send, c.BLOB_SCHEMA)
    got = c.answers(blobs, 2, merge, brief).toArrow()
    of = {b: got.filter(pa.compute.equal(got["block"], b)) for b in (0, 1)}
    assert [x.tolist() for x in c.reply_arrays(of[0], 1)] == [[0, 1, 1], [3, 3]]
    assert [x.tolist() for x in c.reply_arrays(of[1], 1)] == [[1, 1, 0], [3, 3], [2, 2]]
