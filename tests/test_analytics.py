import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.functions import batches, spans
from quillon.operators import detectors, hierarchy, literals, terms, vectors


# ---------------------------------------------------------------- required literals


@pytest.mark.parametrize(
    "pattern, literals_",
    [(r"\bcase\s+closed\b", {("closed", True, True)}), (r"\b(?:hot|cold)er\s+war", {("war", True, False)}), (r"[0-9]{5,}", None), (r"(?:abc)?x*", None), (r"^a\w+b{2,}", {("a", False, False)})],
)
def test_required(pattern, literals_):
    assert literals.required(pattern) == (None if literals_ is None else frozenset(literals_))


def test_every_match_holds_a_required_literal():
    """For each rule of the default taxonomy: on texts made from its own words, the automaton marks every sentence that the pattern matches."""
    r, hits = random.Random(5), 0
    for c in Settings.load().taxonomy.categories:
        for p in c.patterns:
            words = regex.findall(r"[a-z]{2,}|[.,!?%]|\d", spans.lowered(p).replace("\\s", " ").replace("\\b", " ").replace("\\w", " ")) + ["We", "are", "5", "lost"]
            own = literals.Automaton()
            own.add_pattern(0, p)
            compiled = regex.compile(p, regex.IGNORECASE)
            for _ in range(300):
                t = " ".join(r.choices(words, k=r.randrange(2, 9)))
                if compiled.search(t):
                    hits += 1
                    assert own.hits(t, [0], [len(t)]).get(0), (p, t)
    assert hits > 300


def test_lower_case_keeps_offsets():
    for t in ("İstanbul VILE", "ẞtraße", "ŉ vile", "plain"):
        assert len(literals.low(t)) == len(t)


def test_rules_without_an_automaton_find_the_same(spark, monkeypatch):
    rows = [(1, "Vile, evil: VILE! But what about the others? “He is a hack,” she said. Case closed. Quack-quack; vilest éviles vile_ vile9 vile²."), (2, None), (3, ""), (4, "Experts agree. Nobody doubts it; 40 % more.\n\nCase\nclosed, the quackery.")]
    df = spark.createDataFrame(rows, "id long, text string")
    taxonomy = Settings.load().taxonomy
    want = sorted(map(str, detectors.findings(df, taxonomy, "id").collect()))
    monkeypatch.setattr(literals.Automaton, "add_pattern", lambda self, rule, p: self.always.add(rule))
    monkeypatch.setattr(literals.Automaton, "add_words", lambda self, rule, words: self.always.add(rule))
    assert sorted(map(str, detectors.findings(df, taxonomy, "id").collect())) == want and len(want) >= 8


def test_one_scan_and_one_exchange(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "vile")], "id long, text string").write.parquet(path)
    plan = detectors.findings(spark.read.parquet(path), Settings.load().taxonomy, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") <= 2 and "Join" not in plan


# ---------------------------------------------------------------- term weights


def test_weights_with_a_term_that_all_documents_have(spark, monkeypatch):
    monkeypatch.setattr(terms, "FREQUENT", 4)
    r = random.Random(3)
    docs = [(i, "the " * r.randrange(1, 4) + " ".join(r.choices(["Aa", "bb", "cc", "dd-ee", "é"], k=6))) for i in range(40)] + [(40, None), (41, "!!"), (None, "the aa")]
    df = spark.createDataFrame(docs, "id long, text string").withColumns({"n": F.lit(1), "df": F.lit(2), "rank": F.lit(3)})
    got = {(x.id, x.term): (x.n, x.df, x.weight) for x in terms.weights(terms.counts(df, "id"), len(docs), "id").collect()}
    own = {i: Counter(regex.findall(r"[\w]+", (t or "").lower())) for i, t in docs}
    have = Counter(w for c in own.values() for w in c)
    assert set(got) == {(i, w) for i, c in own.items() for w in c}
    for (i, w), (n, d, x) in got.items():
        assert (n, d) == (own[i][w], have[w]) and math.isclose(x, n * (math.log((1 + len(docs)) / (1 + d)) + 1))


def test_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "a")], "id long, text string")
    rows = terms.vectors(terms.weights(terms.counts(df, "id", sizes=(1, 2)), 2, "id"), "id").collect()
    assert all(abs(sum(x * x for x in r.weights) - 1) < 1e-12 and list(r.terms) == sorted(r.terms) for r in rows)
    assert {t for r in rows if r.id == 1 for t in r.terms} == {"a", "b", "c", "a b", "b b", "b c"}


# ---------------------------------------------------------------- neighbours


def plain(base, queries, k, same=False):
    unit = lambda rows: {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    b, q, out = unit(base), unit(queries), {}
    for i, v in q.items():
        found = sorted(((-round(float(v @ w), 9), j) for j, w in b.items() if same or j != i))[:k]
        out[i] = [(j, -c) for c, j in found]
    return out


def test_neighbours_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + 0.05 * rng.normal(size=12)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (None, rows[0][1]), (2003, [None] * 12), (2004, [x * 1e200 for x in rows[5][1]])]
    base = spark.createDataFrame(rows, "id long, embedding array<double>").withColumns({"block": F.lit(1), "unit": F.lit(2), "query": F.lit(3)})
    asked = base.where("id % 17 = 0 OR id IN (907, 2001, 2004) OR id IS NULL")
    got, share = vectors.nearest(base, asked, 5, pivots=30)
    want = plain([(i, v) for i, v in rows if i != 2004] + [(2004, rows[5][1])], [(i, v if i != 2004 else rows[5][1]) for i, v in rows if i is not None and (i % 17 == 0 or i in (907, 2001, 2004))], 5)
    found = {}
    for r in got.orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["id"], r["cosine"]))
    assert set(found) == set(want)
    for i, own in want.items():
        assert np.allclose([c for _, c in found[i]], [c for _, c in own], atol=1e-8) and len(found[i]) == len(own)
    assert [j for j, _ in found[907]] == [7, 900, 901, 902, 903]
    share = share.first()
    assert 0 < share["visited"] < 0.4 * share["pairs"]


def test_neighbours_of_little(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    assert vectors.nearest(none, one)[0].collect() == [] and vectors.nearest(one, one)[0].collect() == [] and vectors.nearest(one, none)[0].collect() == []
    assert [tuple(r) for r in vectors.nearest(one, one, same=True)[0].collect()] == [(1, 1, 1, 1.0)]


def test_pairs_of_matrices_are_scored_one_by_one(spark):
    """A batch of pairs is neither copied nor made into Python objects, and holds BATCH_BYTES or one pair."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(1024, 64)), rng.normal(size=(4, 64))
    n = 32
    made = {"block": [0] * n, "asked": [[5, 1, 2, 3]] * n, "queries": [q.tobytes()] * n, "ids": [list(range(1024))] * n, "data": [x.tobytes()] * n}
    batch = pa.RecordBatch.from_pydict(made, pa.schema({"block": pa.int64(), "asked": pa.list_(pa.int64()), "queries": pa.binary(), "ids": pa.list_(pa.int64()), "data": pa.binary()}))
    tracemalloc.start()
    first, *rest = vectors._scored(iter([batch]), 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rest) == n - 1 and all(r.equals(first) for r in rest) and peak < 4 << 20  # the batch has 17 MB
    cosine = q @ x.T
    cosine[[0, 1, 2, 3], [5, 1, 2, 3]] = -np.inf
    assert first["query"].to_pylist() == [5] * 3 + [1] * 3 + [2] * 3 + [3] * 3 and first["id"].to_pylist() == np.argsort(-cosine, axis=1)[:, :3].ravel().tolist()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    vectors.nearest(one, one)
    assert int(spark.conf.get(key).rstrip("b")) == batches.BATCH_BYTES


# ---------------------------------------------------------------- hierarchies


def reach(edges):
    up, out = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    for a in up:
        todo, d = set(up[a]), 1
        while todo:
            for b in todo:
                out.setdefault((a, b), d)
            todo, d = {c for b in todo for c in up.get(b, ()) if (a, c) not in out}, d + 1
    return out


@pytest.mark.parametrize("edges", [[(f"n{i}", f"n{i // 2}") for i in range(1, 70)], [(f"c{i}", f"c{i + 1}") for i in range(37)], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("x", None), (None, "y"), ("a", "b")], []])
def test_closure(spark, edges):
    edges = [e for e in edges if e != ("n0", "n0")]
    df = spark.createDataFrame(edges, "node string, parent string")
    closed = hierarchy.closure(df)
    assert {(r.node, r.ancestor): r.distance for r in closed.collect()} == reach(edges)
    assert {r.node: r.length for r in hierarchy.circles(closed).collect()} == {a: d for (a, b), d in reach(edges).items() if a == b}


def test_projection_and_problems(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "z"), ("q", "a"), ("r", "r")], "node string, parent string")
    closed = hierarchy.closure(df)
    values = spark.createDataFrame([("c", 2), ("d", 3), ("d", 1), ("a", 10)], "node string, v int")
    assert {r.node: r.total for r in hierarchy.projected(values, closed, "v").collect()} == {"a": 16, "b": 6, "c": 2, "d": 4, "z": 4}
    nodes = spark.createDataFrame([(x,) for x in "abcdr"], "node string")
    assert {tuple(r) for r in hierarchy.problems(nodes, df, closed).collect()} == {("q", "unknown node"), ("d", "unknown parent"), ("d", "several parents"), ("r", "on a circle")}


def test_terms_by_block_equal_those_by_shuffled_rows(spark, monkeypatch):
    """Many blocks and buckets, keys that repeat or are null, texts without words; no row per document and term is shuffled."""
    monkeypatch.setattr(terms, "BLOCK", 300)
    r = random.Random(8)
    docs = [(i % 90 if i else None, " ".join(r.choices(["Aa", "bb", "cc", "dd-ee", "é", "f'g", *map(str, range(40))], k=r.randrange(1, 30)))) for i in range(120)] + [(200, None), (201, "!!"), (202, ""), (203, "one")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(7)
    for sizes in ((1,), (1, 2), (3,)):
        weighted = terms.weights(terms.counts(df, "id", sizes=sizes), len(docs), "id")
        want = sorted(map(tuple, terms.top(weighted, 4, "id").collect()), key=str)
        assert sorted(map(tuple, terms.best(df, len(docs), 4, "id", sizes=sizes).collect()), key=str) == want
        every = terms.listed(df, len(docs), "id", sizes=sizes)
        assert sorted(map(tuple, every.select("id", F.inline("terms")).collect()), key=str) == sorted(map(tuple, weighted.select("id", "term", "n", "df", "weight").collect()), key=str)
    plan = terms.best(df, len(docs), 4, "id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Window" not in plan and plan.count("Generate") == 1
