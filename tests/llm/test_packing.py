import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = Path(PATH).read_text()


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_item_once(seed):
    r = random.Random(seed)
    capacity = 50
    histogram = {n: r.choice([1, 2, 7, 1000]) for n in r.sample(range(1, 51), r.randrange(1, 40))}
    slots: dict = {}
    for length, first, ranks, sequence, per, base in packing.plan(histogram, capacity):
        for k in range(ranks):
            slots.setdefault(length, {})[first + k] = (sequence + k // per, base + k % per * length)
    rows = sorted((*at, length) for length, own in slots.items() for at in own.values())
    assert {n: sorted(x) for n, x in slots.items()} == {n: list(range(m)) for n, m in histogram.items()}
    end: dict = {}
    for sequence, offset, length in rows:
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert max(end.values()) <= capacity
    assert len(end) <= max(1.25 * sum(n * m for n, m in histogram.items()) / capacity + 1, sum(m for n, m in histogram.items() if 2 * n > capacity))


def check(docs, rows, capacity):
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    end: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values(), default=0) <= capacity
    return len(end), sum(x[3] for x in want)


def test_edges_and_sequences(spark):
    docs = [(1, None), (2, ""), (None, "Hello  World's"), (3, "a b\u0085c ́x é é İ ΑΣ 12'34 don't\tI'LL\x0b\x1c.."), (4, "x"), (4, "x"), (5, "long words " * 8000), (6, "<|endoftext|> in<|endoftext|>side")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("row", F.lit(0))
    out = packing.pack(df, JSON, capacity=64)
    rows = out.collect()
    check(docs, rows, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(out).collect()}
    assert all(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    used, tokens = check(docs, queries.op4_best_fit_packing(spark, d).collect(), 4096)
    assert used == -(-tokens // 4096)


def test_words_by_rank_equal_the_tokenizer(spark):
    words = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        words.update((r.text or "").encode().lower().split())
    words |= {b"Don't", b"x'll,", "ÉCOLE".encode(), "straße!?".encode(), b"a.b", b"...", "a×b".encode(), b"it's***", b"<|endoftext|>", b"x<|", b"12ab"}
    words |= {"Âî÷ÿ.".encode(), b"a.'b", b"'ll", b"\x00a", b"a\x1fb", "ñ\u0303".encode(), "\u0301x".encode(), b"A<|EndOfText|>", "Éa".encode() * 300}
    own, t = packing.Reader(JSON), Tokenizer.from_file(PATH)
    assert own.engine is not None
    words = [b"", *sorted(words), b" ".join(sorted(words)), b"\n \r\n"]
    assert all(a.tolist() == t.encode(w.decode(), add_special_tokens=False).ids for a, w in zip(own.ids(words), words, strict=True))


def test_another_tokenizer_encodes_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(1, "Two  words, and\n Case"), (2, None), (3, "")]
    t, rows = Tokenizer.from_file(path), packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), Path(path).read_text(), end_id=0).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in docs}
    assert {r.doc_id: bytes(r.ids) for r in rows} == {i: np.array(x, "<u4").tobytes() for i, x in want.items()}
