import random

from pyspark.sql import functions as F

from quillon.llm import line_dedup, queries
from tests.llm import brute


def test_align():
    assert line_dedup.align(list("abcd"), list("abcd")) == [(i, i) for i in range(4)]
    assert line_dedup.align(list("xaby"), list("uabv")) == [(1, 1), (2, 2)]
    assert line_dedup.align([], list("a")) == []
    assert line_dedup.align(list("ab"), list("ba")) in ([(0, 1)], [(1, 0)])
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in "ab")
        got = line_dedup.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_short_blocks_stay():
    assert line_dedup.common_blocks([1, 2, 9], [5, 1, 2, 7], [1, 2, 3, 9], 5) == [1, 2]
    assert line_dedup.common_blocks([1, 2, 9], [5, 1, 2, 7], [1, 2, 2, 9], 5) == []


def digest(out):
    return sorted((tuple(r) for r in queries.line_digest(out).collect()), key=str)


def test_brute_force(spark):
    for seed in (1, 2, 3):
        r = random.Random(seed)
        pool = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 2, 4, 6, 12]))) for _ in range(70)] + ["", "  ", "Ünï\x1c x"]
        docs = [(i, None if i == 3 else "" if i == 4 else "\n".join(r.choice([" ", ""]) + (r.choice(pool) if r.random() < 0.6 else f"own {r.random()} a b c d") for _ in range(r.randrange(1, 14)))) for i in range(90)]
        docs += [(500 + i, docs[10 + i % 3][1]) for i in range(30)] + [(900, "\n".join(["the same line over and over"] * 300))]
        docs += [(None, docs[20][1]), (901, "the same line over and over")]
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("node", F.lit(1))
        assert digest(line_dedup.remove_lines(df.repartition(3))) == sorted(brute.line_dedup(docs), key=str)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx")] * 3 + [(0, "z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in queries.line_digest(line_dedup.remove_lines(df)).collect()) == [0, 0, 2, 2]
    assert line_dedup.remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op8_line_dedup(spark, d).collect())) == sorted(brute.line_dedup(docs, blocks=True))


def removed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.removed for r in line_dedup.remove_lines(df.repartition(3), blocks=True).collect()}


def test_short_lines_of_many_holders(spark):
    docs = [(i, "a b\nc d\n\ne f\ng h") for i in range(60)]
    assert removed(spark, docs) == {i: [0, 1, 2, 3, 4] if i else [] for i in range(60)}


def test_a_line_of_many_holders_is_aligned(spark):
    common = "one line that all of them hold"
    docs = [(i, f"own {i} a b c d\n{common}\nlast {i} a b c d") for i in range(120)] + [(500, f"{common}\nx\n{common}")]
    got = {r.doc_id: r.removed for r in line_dedup.remove_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: [1] if i else [] for i in range(120)} | {500: []}  # there the line isn't unique: no anchor


def test_blocks_whole_in_a_later_holder_only(spark):
    docs = [(1, "a b c\nown one"), (2, "d e f\nown two"), (3, "a b c\nd e f\nown three"), (4, "own four\na b c\nd e f")]
    assert removed(spark, docs) == {1: [], 2: [], 3: [], 4: [1, 2]}
    p, q = "p p p p p p", "q q q q q q"
    got = removed(spark, [(1, f"{p}\n{q}"), (2, f"{q}\n{p}"), (3, f"{q}\n{p}"), (4, f"{q}\n{p}\nz\n{q}\n{p}")])
    assert got[1] == [] and got[3] == [0, 1] and len(got[2]) == 1 and len(got[4]) == 2


def test_common_runs_share_a_hash():
    r = random.Random(7)
    for _ in range(300):
        words = [r.choice([0, 1, 2, 6]) for _ in range(r.randrange(2, 12))]
        hashes = [r.randrange(1, 1 << 60) for _ in words]
        whole = set(line_dedup.least_blocks(hashes, words, 5).tolist())
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                own = set(line_dedup.least_blocks(hashes[i:j], words[i:j], 5).tolist())
                assert own <= whole and bool(own) == (sum(words[i:j]) >= 5)


def test_blocks_mode_on_edges(spark):
    for seed in (4, 5):
        r = random.Random(seed)
        pool = [" ".join(f"w{r.randrange(30)}" for _ in range(r.choice([1, 2, 3, 6]))) for _ in range(25)] + ["", "  "]
        docs = [(i % 70, "\n".join(r.choice(pool) if r.random() < 0.8 else f"own {r.random()} a b c" for _ in range(r.randrange(1, 12)))) for i in range(70)]
        docs += [(80, None), (81, ""), (None, docs[5][1]), (82, docs[5][1]), (83, "\n".join(pool * 30))]
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("node", "h", "keys", "hashes", "block", "rank", "removed")})
        assert digest(line_dedup.remove_lines(df.repartition(3), blocks=True)) == sorted(brute.line_dedup(docs, blocks=True), key=str)
    df = spark.createDataFrame([(1, "a b c\nd e f\nx")] * 3 + [(0, "z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in queries.line_digest(line_dedup.remove_lines(df, blocks=True)).collect()) == [0, 0, 3, 3]
    assert line_dedup.remove_lines(df.limit(0), blocks=True).count() == 0
