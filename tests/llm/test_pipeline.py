import corpus_pipeline as pipeline
from quillon.llm import queries, toxicity
from tests.llm import brute
from tests.llm.test_packing import check


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_plain_versions(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, steps = docs.columns, dict(pipeline.STAGES)
    model = toxicity.fit(docs, queries.table(spark, d, "labels").where(queries.crc() % 5 != 0))
    want = [x for x in rows(docs) if model.score((x[1] or "").encode()) < 0.5]
    clean = steps["toxicity"](spark, docs, d)
    assert clean.columns == names and sorted(rows(clean)) == sorted(want)

    got = steps["line_dedup"](spark, clean, d)
    assert got.columns == names and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    plain = {r[0]: r for r in brute.line_dedup(want, blocks=True)}
    assert {r[0] for r in rows(got)} == {i for i, n, gone, _ in plain.values() if gone < n or not n}
    import hashlib

    assert all(hashlib.sha256((t or "").encode()).hexdigest() == plain[i][3] for i, t in rows(got))

    lines, got = rows(got), steps["ngram_jaccard"](spark, got, d)
    assert got.columns == names
    assert sorted(r[0] for r in rows(got)) == sorted(i for i, n, least in brute.linked(lines, 5, 80) if i == least or not n)

    near = rows(got)
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = steps["decontamination"](spark, got, d)
    assert got.columns == names
    assert sorted(r[0] for r in rows(got)) == sorted(r[0] for r in brute.contamination(near, items) if not r[5])

    last = steps["packing"](spark, got, d)
    check(rows(got), last.collect(), 4096)
    whole = pipeline.run(spark, d)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last.collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "", "en", "s", 0), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == [1, 2]
