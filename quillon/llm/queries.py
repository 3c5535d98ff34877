"""The registered queries of the subpackage: thin contracts over the operators, at production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontamination, embedding_dedup, jaccard_join, license_scan, line_dedup, lm_scoring, merkle, packing, quality, spelling, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(table(spark, sf_dir, "documents"), crc() % 7 != 2, order=3)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def warc_digest(records: DataFrame) -> DataFrame:
    number = lambda x: F.regexp_extract(x, r":(-?\d+)$", 1)
    return records.select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to"),
    )


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = common.new_path(spark, "archives")
    warc.write(pages, path)
    return warc_digest(warc.read(spark, path, payload=False))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json(), capacity=4096, end_id=1, keep_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc() % 5 != 0))
    out = toxicity.score(docs, model).select("doc_id", F.coalesce(crc() % 5 == 0, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def line_digest(out: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup.remove_lines(table(spark, sf_dir, "documents"), least=5, blocks=True))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), coverage=0.8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def decontamination_digest(out: DataFrame) -> DataFrame:
    size = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = out.select("doc_id", "n_words", size.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontamination_digest(found)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=35)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", size.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(crc() % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = merkle.leaf(*(changed if x == "text" else F.col(x) for x in merkle.FIELDS))
    out = merkle.verified(merkle.manifest(docs, keep={"tampered": tampered}), F.col("tampered"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def misspelt(runs: DataFrame) -> DataFrame:
    """The runs with one code point deleted from those whose digest 31 divides."""
    named = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = runs.withColumn("h", F.crc32(named.cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt(spelling.runs(table(spark, sf_dir, "documents"), least=7))
    return spelling.group(words.where(F.length("word") >= 7), least=2, times=10)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = common.saved(quality.statistics(docs, keep={"doc_id": F.col("doc_id")}), "statistics")
    model = quality.fit(stats, labels.where(crc() % 5 != 0))
    out = quality.score(stats, model).withColumn("held_out", F.coalesce(crc() % 5 == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_warc": op2_warc, "op3_license_scan": op3_license_scan, "op4_best_fit_packing": op4_best_fit_packing, "op5_embedding_dedup": op5_embedding_dedup, "op6_toxicity": op6_toxicity, "op7_ngram_jaccard": op7_ngram_jaccard, "op8_line_dedup": op8_line_dedup, "op9_decontamination": op9_decontamination, "op10_substring_dedup": op10_substring_dedup, "op11_merkle_manifest": op11_merkle_manifest, "op12_spelling_variants": op12_spelling_variants, "op13_quality": op13_quality, "pipeline": pipeline}



def _nibbles() -> list[int]:
    """CRC-32 steps by four bits, from the reflected polynomial."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return table


def sql_crc(text: str) -> str:
    """DuckDB has no crc32: a fold over the half bytes of the UTF-8 form, the low one of each byte first."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    digits = f"string_split(reverse(array_to_string(list_reverse({pairs}), '')), '')"  # bytes in their order, the halves of each turned
    halves = f"list_transform({digits}, lambda digit: instr('0123456789ABCDEF', digit)::BIGINT - 1)"
    step = f"lambda state, half: xor(state >> 4, ({_nibbles()}::BIGINT[])[(xor(state, half) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), {step}), 4294967295)"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLES: dict[str, str] = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
          SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM (
            SELECT doc_id, coalesce('=' || source, '') AS grp, {_sql_leaf('text')} AS leaf, {_sql_leaf("CASE WHEN " + sql_crc("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM documents)),
        up(level, grp, pos, n, hash) AS (
          SELECT 0, grp, place, size, leaf FROM leaves
          UNION ALL SELECT level + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, grp, pos // 3, n),
        top AS (SELECT grp, hash, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS size FROM up WHERE n = 1),
        over_top(level, pos, n, hash) AS (
          SELECT 0, place, size, hash FROM top
          UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM over_top WHERE n > 1 GROUP BY level, pos // 3, n),
        own AS (SELECT l.doc_id, l.grp, l.leaf, l.tampered, l.place, t.hash AS subroot, t.place AS high, row_number() OVER () AS id FROM leaves l JOIN top t USING (grp)),
        parents AS (SELECT level, grp, pos // 3 AS parent, list(hash ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY ALL),
        high_parents AS (SELECT level, pos // 3 AS parent, list(hash ORDER BY pos) AS kids FROM over_top WHERE n > 1 GROUP BY ALL),
        steps AS (
          SELECT id, 0 AS part, p.level, (o.place // (3 ** p.level)::BIGINT) % 3 AS i, p.kids FROM own o JOIN parents p ON p.grp = o.grp AND p.parent = o.place // (3 ** (p.level + 1))::BIGINT
          UNION ALL SELECT id, 1, p.level, (o.high // (3 ** p.level)::BIGINT) % 3, p.kids FROM own o JOIN high_parents p ON p.parent = o.high // (3 ** (p.level + 1))::BIGINT),
        sides AS (SELECT id, part, level, array_to_string(kids[1:i::BIGINT], '') AS l, array_to_string(kids[(i + 2)::BIGINT:], '') AS r FROM steps),
        proof AS (SELECT id, list(struct_pack(l := l, r := r) ORDER BY part, level) AS s FROM sides GROUP BY id),
        fold(id, k, acc, s) AS (
          SELECT o.id, 0, o.tampered, coalesce(s, []) FROM own o LEFT JOIN proof p USING (id)
          UNION ALL SELECT id, k + 1, sha256(s[k + 1].l || acc || s[k + 1].r), s FROM fold WHERE k < len(s))
        SELECT o.doc_id, o.leaf, o.subroot, r.hash AS root, sha256(array_to_string(list_transform(f.s, lambda x: x.l || x.r), '')) AS proof_sha256, f.acc AS folded_root, f.acc = r.hash AS verified
        FROM own o JOIN fold f ON f.id = o.id AND f.k = len(f.s), (SELECT hash FROM over_top WHERE n = 1) r""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE run AS (
          SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 7),
        hashed AS (SELECT *, {sql_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS times FROM run GROUP BY ALL)),
        made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
        word AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word) UNION ALL SELECT word, n, 0, word FROM word),
        pair AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.v = b.v AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
        best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pair GROUP BY word),
        form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n FROM word w LEFT JOIN best b USING (word)),
        chain(word, root) AS (SELECT word, word FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c USING (word) JOIN form e ON e.word = c.root WHERE e.form IS NULL""",
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY sha256(b)) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
        FROM q""",
}
