import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import license_scan as ls
from quillon.llm import queries


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_banded_is_lcs_within_the_band():
    r = random.Random(1)
    for _ in range(300):
        t = [r.choice("abcdefgh").encode() for _ in range(r.randrange(4, 20))]
        edited = list(t)
        if r.random() < 0.7:
            del edited[r.randrange(len(edited))]
        if r.random() < 0.5:
            edited.insert(r.randrange(len(edited)), b"z")
        pad = r.randrange(0, 9)
        words = [b"q"] * pad + edited + [b"q"] * r.randrange(0, 9)
        matched, first, end = ls.banded(t, words, pad)
        assert len(edited) - 1 - (b"z" in edited) <= matched <= lcs(t, words)
        assert first >= pad and end <= pad + len(edited)


def test_winnow_guarantee():
    r = np.random.default_rng(0)
    for _ in range(200):
        g = r.integers(0, 50, 30, dtype=np.uint64)
        kept = ls.winnow(g)
        assert all(((kept >= i) & (kept < i + ls.WINDOW)).any() for i in range(len(g) - ls.WINDOW + 1))


def test_planted_notices(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "license", "under", "é"]
    docs, want = [(1, None), (2, ""), (3, "the license"), (None, "Released under the MIT License.")], {(None, "MIT/short")}
    for i in range(200):
        parts = [r.choice(vocab) for _ in range(r.randrange(0, 300))]
        if i % 3 == 0:
            name = r.choice(list(ls.TEMPLATES))
            words = ls.TEMPLATES[name].upper().split()
            if len(words) > 20:  # a tenth of the words changed
                for _ in range(len(words) // 10):
                    words[r.randrange(len(words))] = "zzz"
            at = r.randrange(len(parts) + 1)
            parts[at:at] = words
            want.add((10 + i, name))
        docs.append((10 + i, " ".join(parts)))
    docs.append((900, "\n".join(["Released under the MIT License."] * 3 + ["x " * 5000])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(0))
    rows = ls.scan(df.repartition(3)).collect()
    found = {(x.doc_id, x.license) for x in rows if x.doc_id != 900}
    assert want <= found and {x[0] for x in found} == {x[0] for x in want}
    assert sum(x.doc_id == 900 for x in rows) == 3
    text = {i: (t or "").encode() for i, t in docs}
    for x in rows:
        piece = ls.fold_words(text[x.doc_id][x.start_byte : x.end_byte])
        assert len(piece) == x.end_word - x.start_word and x.coverage >= 0.8
    assert ls.scan(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    lines = {"MIT/short": "Released under the MIT License.", "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.", "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.", "Reserved/short": "All rights reserved."}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = {(r.doc_id, n) for n, x in lines.items() for r in docs.where(F.contains("text", F.lit(x))).collect()}
    got = {(r.doc_id, r.license) for r in queries.op3_license_scan(spark, d).collect()}
    assert want and want <= got and {g[0] for g in got} == {w[0] for w in want}


def test_against_all_places(spark):
    """The notices of a document are those that a window of it holds, whichever place that is at."""
    r = random.Random(11)
    names = ["Reserved/short", "MIT/short", "GPL-3.0/short", "CC-BY-4.0/notice", "BSD-3-Clause/endorsement"]
    words = {n: ls.fold_words(ls.TEMPLATES[n].encode()) for n in names}
    docs = []
    for i in range(60):
        text = [f"w{r.randrange(400)}" for _ in range(r.randrange(60))]
        for n in r.sample(names, r.choice([0, 1, 1, 2])):
            own = [x.decode() for x in words[n]]
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                k = r.randrange(len(own))
                own[k : k + r.choice([0, 1])] = [f"e{r.randrange(9)}"] * r.choice([0, 1])
            at = r.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((i, " ".join(text)))
    want = set()
    for i, text in docs:
        own = text.encode().split()
        for n, t in words.items():
            band = ls.band_of(len(t))
            places = {j - k for k in range(len(t) - 2) for j in range(len(own) - 2) if own[j : j + 3] == t[k : k + 3]}
            if any(lcs(t, own[max(0, s - band) : s + len(t) + band]) >= 0.8 * len(t) for s in places):
                want.add((i, n))
    got = ls.scan(spark.createDataFrame(docs, "doc_id long, text string"), {n: ls.TEMPLATES[n] for n in names}).collect()
    assert {(r.doc_id, r.license) for r in got} <= want
    sure = {(i, n) for i, n in want if any(own[j : j + 4] == words[n][k : k + 4] for own in [dict(docs)[i].encode().split()] for k in range(max(1, len(words[n]) - 3)) for j in range(len(own)))}
    assert {(r.doc_id, r.license) for r in got} >= sure
    for x in got:
        own = dict(docs)[x.doc_id].encode().split()
        assert lcs(words[x.license], own[x.start_word : x.end_word]) >= round(x.coverage * len(words[x.license]))
