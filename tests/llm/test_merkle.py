import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle, queries
from tests.oracle import compare

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(x):
    return sha256(x.encode()).hexdigest()


def row_digest(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, for each node its (left, right) digests up to the root), by plain recursion."""
    if len(nodes) < 2:
        return nodes[0], [[]]
    runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
    root, above = climb([digest("".join(r)) for r in runs])
    return root, [[("".join(r[:i]), "".join(r[i + 1 :])), *p] for r, p in zip(runs, above, strict=True) for i in range(len(r))]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, row_digest(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    root, over = climb([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), high in zip(order, trees, over, strict=True):
        for (*_, leaf, r), proof in zip(sorted(groups[s], key=lambda x: x[:3]), proofs, strict=True):
            steps = [*proof, *high]
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            acc = row_digest((*r[:4], text))
            for a, b in steps:
                acc = digest(a + acc + b)
            out.append((r[0], leaf, subroot, root, digest("".join(a + b for a, b in steps)), acc, acc == root))
    return sorted(out, key=repr)


def written(spark, tmp_path, rows):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, COLUMNS).withColumns({"grp": F.lit("clash"), "hash": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "kept": F.lit(4), "proof": F.lit(5)}).write.parquet(str(path))
    return str(tmp_path)


ROWS = [
    *((i, "a", "en", 3, f"x\n{i}") for i in range(29)), *((i, "ä", None, None, None if i % 2 else "") for i in range(4)), (7, None, "en", 1, "one"), (None, "b", "en", 5, "a\nb"), (None, "b", "en", 5, "a\nb"),
    *([(3, "b", "de", 2, "same\nsame")] * 5), (-4, "", "en", 9, "long " * 20_000), (5, "Z", "en", 1, "\n"),
]


def test_against_plain_trees(spark, tmp_path):
    got = queries.op11_merkle_manifest(spark, written(spark, tmp_path, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[29:31], ROWS[:10]])
def test_small_tables(spark, tmp_path, rows):
    got = queries.op11_merkle_manifest(spark, written(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == (brute(rows) if rows else [])


def test_untampered_verifies(spark, tmp_path):
    own = merkle.manifest(spark.createDataFrame(ROWS, COLUMNS))
    rows = merkle.verified(own).collect()
    assert len(rows) == len(ROWS) and all(r.verified for r in rows)
    assert {r.source for r in own.subroots.collect()} == {r[1] for r in ROWS}
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).root is None


def test_ranks_of_a_single_group_of_equal_rows(spark):
    rows = merkle.ranked(spark.range(500).select(F.lit("g").alias("grp"), F.lit(1).alias("key")), "grp", ["key"]).collect()
    assert sorted(r.pos for r in rows) == list(range(500)) and {r.n for r in rows} == {500}


def test_sql(spark):
    compare(spark, queries.op11_merkle_manifest, queries.ORACLES["op11_merkle_manifest"], "/root/testdata/sf0.001")
