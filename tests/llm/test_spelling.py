import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, spelling
from tests.oracle import compare


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, least=2, times=10):
    n = {w: k for w, k in Counter(words).items() if k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def made(seed=0):
    r = random.Random(seed)
    letters = "abcdeiqzéßÿ÷"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(7, 13))) for _ in range(25)]
    words = []
    for w in base:
        for kind in range(14):
            i, x = r.randrange(len(w)), r.choice(letters)
            v = (w, w[:i] + w[i + 1 :], w[:i] + x + w[i:], w[:i] + x + w[i + 1 :], w + x)[kind % 5]
            words += [v] * r.choice((1, 2, 3, 25, 40, 300))
    return words


def test_against_all_pairs(spark):
    words = made()
    df = spark.createDataFrame([(w,) for w in [*words, None]], "word string").withColumns({"n": F.lit(1), "sig": F.lit(2), "mask": F.lit("x")})
    got = sorted(map(tuple, spelling.group(df).collect()), key=repr)
    want = brute(words)
    assert got == want and sum(x[1] is not None for x in want) > 20 and any(x[2] not in (x[0], x[1]) for x in want)


@pytest.mark.parametrize("a, b", [("abcdefg", "abcdefgh"), ("abcdefg", "xabcdefg"), ("abcdefgh", "abcxefgh"), ("abcdefgh", "abcdxfgh"), ("abcdefg", "abcxdefg"), ("abcdefgh", "abcdxefgh"), ("éabcdefg", "zabcdefg"), ("aaaaaaa", "aaaaaaaa"), ("😀bcdefgh", "xbcdefgh")])
def test_every_kind_of_edit(spark, a, b):
    rows = spelling.near_pairs(spark.createDataFrame([(a, 1), (b, 2)], "word string, n long")).collect()
    assert len(rows) == 1 and {rows[0].a, rows[0].b} == {a, b}


def test_two_edits_are_not_near(spark):
    assert spelling.near_pairs(spark.createDataFrame([("abcdefg", 1), ("abcdegf", 2), ("abcdefghi", 4), ("abcde", 5)], "word string, n long")).collect() == []


def runs(rows):
    out = []
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            out += [w] if len(w) >= 7 else []
    return out


def test_query_on_edges(spark, tmp_path):
    words = made(1)
    r = random.Random(2)
    rows = [(i % 50, " ".join(r.choices(words, k=60)) + ("ABCDEFG! " * 3)) for i in range(60)]
    rows += [(None, "Unbekannte unbekannte"), (3, None), (4, ""), (5, "É" * 9 + " " + "É" * 9), (5, "É" * 9), (6, "langestes " * 30_000), (7, "Zz" * 5_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("run", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(runs(rows))


def test_empty_table(spark):
    assert spelling.group(spelling.runs(spark.createDataFrame([], "doc_id long, text string")).withColumnRenamed("run", "word")).collect() == []


def test_sql(spark):
    compare(spark, queries.op12_spelling_variants, queries.ORACLES["op12_spelling_variants"], "/root/testdata/sf0.001")
