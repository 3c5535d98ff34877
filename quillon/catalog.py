"""The registered queries of the reference operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import Category, Settings, Taxonomy
from quillon.functions import spans, text
from quillon.operators import calibrate, cluster, detectors, encodings, entities, evaluate, hierarchy, intervals, records, scoring, segment, terms, vectors
from quillon.sources import readers, split_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bench() -> Settings:
    return Settings.load(taxonomy_file="bench_taxonomy.yaml")


# ---------------------------------------------------------------- texts


@query("""
SELECT doc_id, length(text) AS char_count, octet_length(encode(text)) AS byte_count, len(string_split(text, chr(10)))::BIGINT AS line_count,
       len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = ''))::BIGINT AS empty_lines,
       list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS max_line_length,
       length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, chr(9), '')) AS tabs, length(text) - length(replace(text, chr(10), '')) AS newlines
FROM documents""")
def text_stats(spark, sf_dir):
    s = readers.text_stats(F.col("text"))
    names = ("char_count", "byte_count", "line_count", "empty_lines", "max_line_length", "spaces", "tabs", "newlines")
    return documents(spark, sf_dir).select("doc_id", *(s[k].cast("long").alias(k) for k in names))


@query("SELECT doc_id, sha256(text) AS document_id, substr(sha256(text), 1, 16) AS file_digest FROM documents")
def doc_ids(spark, sf_dir):
    d = text.document_id(text.nfc(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", d.alias("document_id"), text.file_digest(d).alias("file_digest"))


@query("""
SELECT doc_id, CASE WHEN contains(substr(text, 1, 1000), chr(13) || chr(10)) THEN 'CRLF' WHEN contains(substr(text, 1, 1000), chr(10)) THEN 'LF'
       WHEN contains(substr(text, 1, 1000), chr(13)) THEN 'CR' ELSE 'Unknown' END AS line_endings FROM documents""")
def line_endings(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.line_endings(F.col("text")).alias("line_endings"))


SQL_TOKEN = r"[\p{L}\p{N}_\p{M}]+(?:[''’][\p{L}\p{N}_\p{M}]+)*|[^\p{L}\p{N}_\p{M}\s]"


@query(rf"""
SELECT doc_id, len(t)::BIGINT AS tokens, len(list_filter(t, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS word_count,
       len(list_filter(t, lambda x: list_contains([{", ".join(f"'{w}'" for w in text.STOP_WORDS)}], lower(x))))::BIGINT AS stop_words
FROM (SELECT doc_id, regexp_extract_all(text, '{SQL_TOKEN}') AS t FROM documents)""")
def token_counts(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    words = F.size(F.filter("t", lambda x: ~text.is_punct(x)))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), words.cast("long").alias("word_count"), F.size(F.filter("t", lambda x: text.is_stop(F.lower(x)))).cast("long").alias("stop_words"))


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{SQL_TOKEN}') AS m, string_split_regex(text, '{SQL_TOKEN}') AS g FROM documents),
u AS (SELECT doc_id, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM t)
SELECT doc_id, count(*) AS tokens, sum(place)::BIGINT AS offset_sum FROM (
  SELECT doc_id, sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY pos) - length(w) AS place FROM u) GROUP BY doc_id""")
def token_offsets(spark, sf_dir):
    return segment.tokens(documents(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("idx").cast("long").alias("offset_sum"))


@query("""
WITH c AS (SELECT doc_id, text, string_split(substr(text, 1, 400), chr(10) || chr(10)) AS p FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], chr(10) || chr(10)) ELSE p[1] END AS trimmed FROM c""")
def paragraph_trim(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.trim_at_paragraph(F.col("text"), 400).alias("trimmed"))


@query("SELECT page_id, CASE WHEN contains(lower(html), '<!doctype html>') THEN 'HTML5' WHEN contains(lower(html), 'xhtml') THEN 'XHTML' WHEN contains(lower(html), 'html 4') THEN 'HTML4' ELSE 'Unknown' END AS version FROM pages")
def html_version(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_version(F.col("html")).alias("version"))


@query()
def html_text(spark, sf_dir):
    return readers.html_pages(table(spark, sf_dir, "pages"))


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"column\", '{t}' AS dtype, count(*) - count({k}) AS nulls, count(DISTINCT {k}) AS distinct_values FROM customer" for k, t in _CUSTOMER.items()))
def column_profile(spark, sf_dir):
    return readers.column_profile(table(spark, sf_dir, "customer"))


@query(r"""
SELECT doc_id, n_chars % 11 <> 0 AS parsed, CASE WHEN n_chars % 11 <> 0 AND regexp_matches(text, '\S') THEN length(text) END AS text_chars,
       CASE WHEN n_chars % 11 <> 0 THEN list_filter(['doc_id', 'lang', 'text'], lambda x: (x <> 'text' OR text IS NOT NULL) AND (x <> 'lang' OR lang IS NOT NULL)) END AS keys FROM documents""")
def json_line_rows(spark, sf_dir):
    """All documents written as lines of JSON, some broken off before their end, and read back in splits."""
    where = split_files.scratch(spark, "json_line_rows")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    broken = F.col("n_chars") % 11 == 0
    documents(spark, sf_dir).select(F.when(broken, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)).write.text(where)
    read = split_files.json_lines(spark, where)
    number = F.coalesce(F.try_variant_get("value", "$.doc_id", "long"), F.regexp_extract("start", r'^\{"doc_id":(-?\d+)', 1).try_cast("long"))
    return read.select(number.alias("doc_id"), F.col("error").isNull().alias("parsed"), F.length("text").alias("text_chars"), "keys")


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    one = "SELECT '{0}' AS \"column\", '{1}' AS dtype, count(*) - count({0}) AS nulls, count(DISTINCT {0}) AS distinct_values FROM {2}"
    return " UNION ALL ".join(one.format(x, kind, name) for x, kind in columns.items())


@query(_profile_sql("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"}))
def table_file_profile(spark, sf_dir):
    """All customers written as a table parted by semicolons, read back in splits with the delimiter found, and profiled."""
    where = split_files.scratch(spark, "table_file_profile")
    table(spark, sf_dir, "customer").write.options(header=True, sep=";").csv(where)
    return split_files.table_profile(split_files.table_rows(spark, where)).drop("samples")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k') IS NULL) AS missing FROM events")
def json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNull().alias("missing"))


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) % 4 AS bucket FROM conversations")
def round_robin(spark, sf_dir):
    from quillon.plans.distribute import positions

    rows = positions(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", text.bucket_of(F.col("position"), 4).alias("bucket"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def joined_rows(spark, sf_dir):
    """Rows of one source joined by blank lines."""
    rows = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("text"))


# ---------------------------------------------------------------- segmentation


@query(r"""
WITH g AS (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n\s*') AS p, regexp_extract_all(text, '\n[ \t]*\n\s*') AS gap FROM documents),
u AS (SELECT doc_id, unnest(p) AS t, unnest(list_transform(p, lambda x, i: coalesce(length(gap[i]), 0))) AS g, generate_subscripts(p, 1) AS pos FROM g)
SELECT doc_id, count(*) AS paragraphs, sum(place)::BIGINT AS start_sum FROM (SELECT doc_id, t, sum(length(t) + g) OVER (PARTITION BY doc_id ORDER BY pos) - length(t) - g AS place FROM u) WHERE length(t) > 0 GROUP BY doc_id""")
def paragraphs(spark, sf_dir):
    p = documents(spark, sf_dir).select("doc_id", F.inline(segment.paragraphs(F.col("text"))))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("start").cast("long").alias("start_sum"))


#: DuckDB's \\b knows ASCII only, the engine's all letters: for a test, other letters become an underscore, a word character of the same length.
_PLAIN = "regexp_replace(text, '[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2C1}\\x{370}-\\x{1FFF}]', '_', 'g')"
_MASKED = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLAIN},"
    " '\\b(" + "|".join(segment.ABBREVIATIONS) + ")\\.', '\\1\ue000', 'g'), '\\b(e\\.g|i\\.e|a\\.m|p\\.m)\\.', '\\1\ue000', 'g'),"
    " '\\b([A-Z])\\.', '\\1\ue000', 'g'), '(\\d)\\.(\\d)', '\\1\ue000\\2', 'g'), '[.!?]([\"'')]+\\s+[a-z])', '\ue000\\1', 'g')"
)
_SENTENCES = rf"""
paragraph AS (SELECT id, unnest(p) AS text, unnest(list_transform(p, lambda x, i: coalesce(length(gap[i]), 0))) AS gap, generate_subscripts(p, 1) AS par FROM
  (SELECT id, string_split_regex(text, '\n[ \t]*\n\s*') AS p, regexp_extract_all(text, '\n[ \t]*\n\s*') AS gap FROM (SELECT doc_id AS id, text FROM documents))),
placed AS (SELECT id, text, par, sum(length(text) + gap) OVER (PARTITION BY id ORDER BY par) - length(text) - gap AS start FROM paragraph),
cut AS (SELECT id, par, text, start, string_split_regex(m, '[.!?]["'')]*\s+') AS s, regexp_extract_all(m, '[.!?]["'')]*\s+') AS e FROM (SELECT *, {_MASKED} AS m FROM placed WHERE length(text) > 0)),
piece AS (SELECT id, par, text, start, unnest(list_transform(s, lambda x, i: length(x) + coalesce(length(e[i]), 0))) AS n, generate_subscripts(s, 1) AS pos FROM cut),
laid AS (SELECT id, par, pos, text, start, n, sum(n) OVER (PARTITION BY id, par ORDER BY pos) - n AS place FROM piece),
own AS (SELECT id, par, pos, start + place AS start, substr(text, (place + 1)::BIGINT, n::BIGINT) AS t FROM laid),
sentence AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY par, pos) - 1 AS sentence_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS text,
  (start + length(t) - length(regexp_replace(t, '^\s+', '')))::BIGINT AS start_char FROM own WHERE trim(regexp_replace(t, '\s+', '', 'g')) <> '')"""


@query(f"WITH {_SENTENCES} SELECT id AS doc_id, sentence_id, text, start_char, start_char + length(text) AS end_char FROM sentence")
def document_sentences(spark, sf_dir):
    s = segment.sentences(documents(spark, sf_dir), "doc_id")
    return s.select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "text", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@query(f"WITH {_SENTENCES} SELECT id AS doc_id, count(*) AS sentences, max(length(text)) AS longest FROM sentence GROUP BY id")
def sentences(spark, sf_dir):
    s = segment.sentences(documents(spark, sf_dir), "doc_id")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""
WITH {_SENTENCES}, p(position) AS (VALUES (0), (50), (300), (1000), (20000)), d AS (SELECT doc_id, position FROM documents, p)
SELECT doc_id, position::BIGINT AS position, coalesce(min(sentence_id), -1) AS sentence_id FROM d LEFT JOIN sentence s ON s.id = doc_id AND start_char <= position AND position < start_char + length(s.text) GROUP BY ALL""")
def sentence_at(spark, sf_dir):
    laid = documents(spark, sf_dir).select("doc_id", segment.sentence_array(F.col("text")).alias("s"))
    places = laid.select("doc_id", "s", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 50, 300, 1000, 20000)))).alias("position"))
    return places.select("doc_id", "position", segment.sentence_at(F.col("s"), F.col("position")).cast("long").alias("sentence_id"))


# ---------------------------------------------------------------- detectors


def findings(spark, sf_dir, *only: str) -> DataFrame:
    """Findings over all documents, of the named categories or of all."""
    t = bench().taxonomy
    t = Taxonomy(tuple(c for c in t.categories if not only or c.id in only), t.default_threshold)
    return detectors.findings(documents(spark, sf_dir), t, "doc_id")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS m, string_split_regex(text, '[\p{L}\p{N}_]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM t),
o AS (SELECT doc_id, w, (sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM u)
SELECT doc_id, 'slur:lexicon' AS rule_id, e - length(w) AS start_char, e AS end_char, w AS text FROM o WHERE lower(w) IN ('idiot', 'moron', 'worthless', 'stupid', 'pathetic', 'loser')""")
def lexicon_findings(spark, sf_dir):
    f = findings(spark, sf_dir, "slur")
    return f.select("doc_id", "rule_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "text")


_DIGITS = """
WITH t AS (SELECT doc_id, p.rule_id, regexp_extract_all(text, p.pattern) AS m, string_split_regex(text, p.pattern) AS g FROM documents, (VALUES ('junk:regex:0', '[#$%&*]{3}'), ('junk:regex:1', '[0-9]{5,}')) p(rule_id, pattern)),
u AS (SELECT doc_id, rule_id, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM t)
SELECT doc_id, rule_id, count(*) AS findings, min(e - length(w))::BIGINT AS first_start, max(e)::BIGINT AS last_end FROM (SELECT *, sum(gap + length(w)) OVER (PARTITION BY doc_id, rule_id ORDER BY pos) AS e FROM u) GROUP BY doc_id, rule_id"""


@query(_DIGITS)
def regex_findings(spark, sf_dir):
    f = findings(spark, sf_dir, "junk")
    return f.groupBy("doc_id", "rule_id").agg(F.count("*").alias("findings"), F.min("start_char").cast("long").alias("first_start"), F.max("end_char").cast("long").alias("last_end"))


@query(f"""
WITH {_SENTENCES}, r(rule_id, pattern) AS (VALUES ('unsourced:unless:0', '(?i)inthe[a-z]*'), ('unsourced:unless:1', '(?i)thing[a-z]*'))
SELECT id AS doc_id, rule_id, sum(len(regexp_extract_all(text, pattern)))::BIGINT AS findings FROM sentence, r WHERE NOT regexp_matches(text, '[0-9]') AND regexp_matches(text, pattern) GROUP BY ALL""")
def unless_findings(spark, sf_dir):
    return findings(spark, sf_dir, "unsourced").groupBy("doc_id", "rule_id").agg(F.count("*").alias("findings"))


_SLOGANS = rf"""
hit AS (SELECT id, sentence_id, text, start_char, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS m, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') AS g FROM sentence
  WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 9),
hit_word AS (SELECT id, sentence_id, text, start_char, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM hit),
hit_place AS (SELECT *, sum(gap + length(w)) OVER (PARTITION BY id, sentence_id ORDER BY pos) AS e FROM hit_word),
slogan AS (SELECT id AS doc_id, sentence_id, any_value(text) AS text, any_value(start_char) AS first, min(e - length(w))::BIGINT AS s, max(e)::BIGINT AS e FROM hit_place
  WHERE lower(w) IN ('the', 'of', 'and', 'to') GROUP BY id, sentence_id HAVING count(*) >= 2)"""


@query(f"WITH {_SENTENCES}, {_SLOGANS} SELECT doc_id, sentence_id, first + s AS start_char, first + e AS end_char, substr(text, s + 1, e - s) AS text FROM slogan")
def cooccurrence(spark, sf_dir):
    f = findings(spark, sf_dir, "slogan")
    return f.select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "text")


@query("""
WITH q AS (SELECT doc_id, regexp_extract_all(text, '"[^"]{1,600}"') AS a, regexp_extract_all(text, '“[^”]{1,600}”') AS b FROM documents)
SELECT doc_id, len(a)::BIGINT + len(b)::BIGINT AS regions, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(b, lambda x: length(x))), 0)::BIGINT AS characters FROM q""")
def quoted_regions(spark, sf_dir):
    q = documents(spark, sf_dir).select("doc_id", spans.quoted_regions(F.col("text")).alias("q"))
    return q.select("doc_id", F.size("q").cast("long").alias("regions"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("characters"))


def _spans_of(source: str, key: str, pattern: str) -> str:
    """(key, w, e): the matches of a pattern in the texts of a source, with the places behind them."""
    return f"""(SELECT {key}, w, sum(gap + length(w)) OVER (PARTITION BY {key} ORDER BY pos) AS e FROM (SELECT {key}, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos
      FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source})))"""


def _in_quotation_sql() -> str:
    """The findings of the bench taxonomy as spans, and whether a quotation holds them."""
    loose = "(SELECT id, (sentence_id, start_char) AS k, text FROM sentence WHERE NOT regexp_matches(text, '[0-9]'))"
    return rf"""
WITH {_QUOTES}, {_SENTENCES}, {_SLOGANS}, {_GRAMS}, placed_slur AS {_spans_of("documents", "doc_id", chr(92).join(["[", "p{L}", "p{N}_]+"]))},
span AS (SELECT 'slur' AS category, doc_id, e - length(w) AS s, e FROM placed_slur WHERE lower(w) IN ('idiot', 'moron', 'worthless', 'stupid', 'pathetic', 'loser')
  UNION ALL SELECT 'junk', doc_id, e - length(w), e FROM {_spans_of("documents", "doc_id", "[#$%&*]{3}")} UNION ALL SELECT 'junk', doc_id, e - length(w), e FROM {_spans_of("documents", "doc_id", "[0-9]{5,}")}
  UNION ALL SELECT 'unsourced', id, k[2] + e - length(w), k[2] + e FROM {_spans_of(loose, "id, k", "(?i)inthe[a-z]*")} UNION ALL SELECT 'unsourced', id, k[2] + e - length(w), k[2] + e FROM {_spans_of(loose, "id, k", "(?i)thing[a-z]*")}
  UNION ALL SELECT 'slogan', doc_id, first + s, first + e FROM slogan UNION ALL SELECT 'repetition', doc_id, s, e FROM repeated)
SELECT category, sum(quoted::INT)::BIGINT AS quoted, count(*) AS findings FROM (
  SELECT category, EXISTS (SELECT 1 FROM quote q WHERE q.doc_id = span.doc_id AND quote_start <= s AND e <= quote_end) AS quoted FROM span) GROUP BY category"""


def in_quotation(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("category").agg(F.sum(F.col("in_quotation").cast("long")).alias("quoted"), F.count("*").alias("findings"))


@query("SELECT 0::BIGINT AS findings")
def threshold_gate(spark, sf_dir):
    """Findings of a rule below the threshold: none."""
    return findings(spark, sf_dir, "weak").agg(F.count("*").alias("findings"))


_GRAMS = rf"""
tok AS (SELECT doc_id, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM
  (SELECT doc_id, regexp_extract_all(text, '{SQL_TOKEN}') AS m, string_split_regex(text, '{SQL_TOKEN}') AS g FROM documents)),
ended AS (SELECT doc_id, w, pos, sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM tok),
word AS (SELECT doc_id, lower(w) AS w, e - length(w) AS s, e, pos, lower(w) IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}) AS stop FROM ended WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]')),
gram AS (SELECT doc_id, s, lead(e, 3) OVER o AS e, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS phrase,
  stop AND lead(stop, 1) OVER o AND lead(stop, 2) OVER o AND lead(stop, 3) OVER o AS stops FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
often AS (SELECT * FROM gram WHERE phrase IS NOT NULL AND NOT stops QUALIFY count(*) OVER (PARTITION BY doc_id, phrase) >= 4),
chosen AS (SELECT doc_id, list_reduce(list_transform(list(struct_pack(s := s, e := e) ORDER BY s, e), lambda x: [x]), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) ELSE a END) AS r FROM often GROUP BY doc_id),
repeated AS (SELECT doc_id, x.s::BIGINT AS s, x.e::BIGINT AS e FROM (SELECT doc_id, unnest(r) AS x FROM chosen))"""


@query(f"WITH {_GRAMS} SELECT doc_id, phrase, count(*) AS times FROM often GROUP BY doc_id, phrase")
def ngram_counts(spark, sf_dir):
    g = detectors.ngrams(documents(spark, sf_dir), 4, 4, "doc_id", "text")
    return g.groupBy("doc_id", "phrase").agg(F.count("*").alias("times"))


@query(f"""
WITH {_GRAMS}, {_SENTENCES} SELECT r.doc_id, max(sentence_id) AS sentence_id, s AS start_char, e AS end_char, substr(any_value(d.text), s + 1, e - s) AS text
FROM repeated r JOIN documents d USING (doc_id) JOIN sentence n ON n.id = r.doc_id AND start_char <= s GROUP BY r.doc_id, s, e""")
def repetition(spark, sf_dir):
    f = findings(spark, sf_dir, "repetition")
    return f.select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "text")


def _default_rules() -> list[tuple[str, str, str]]:
    """(rule_id, pattern, exceptions or empty) of the default taxonomy's rules that test one sentence with patterns."""
    rows = []
    for c in Settings.load().taxonomy.categories:
        if c.base_confidence < 0.8:
            continue
        words_ = spans.words_pattern(c.terms) if c.terms else ""
        if c.detector == "lexicon":
            rows.append((f"{c.id}:lexicon", words_, ""))
        elif c.detector in ("regex", "regex_unless"):
            unless = "|".join(f"(?:{x})" for x in [*([spans.words_pattern(c.unless_terms)] if c.unless_terms else []), *c.unless_patterns])
            rows += [(f"{c.id}:{'regex' if c.detector == 'regex' else 'unless'}:{i}", x, unless) for i, x in enumerate(c.patterns)]
    return rows


def _sql_pattern(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _rule_count(rule: str, pattern: str, unless: str) -> str:
    n = f"len(regexp_extract_all(text, {_sql_pattern(pattern)}))"
    return f"struct_pack(rule_id := '{rule}', n := {f'CASE WHEN regexp_matches(text, {_sql_pattern(unless)}) THEN 0 ELSE {n} END' if unless else n})"


@query(f"""
WITH {_SENTENCES}, r AS (SELECT id, unnest([{", ".join(_rule_count(*x) for x in _default_rules())}]) AS x FROM (SELECT id, {_PLAIN} AS text FROM sentence))
SELECT id AS doc_id, x.rule_id AS rule_id, sum(x.n)::BIGINT AS findings FROM r WHERE x.n > 0 GROUP BY ALL""")
def default_rule_counts(spark, sf_dir):
    """Findings of each pattern rule of the default taxonomy, by document."""
    t = Settings.load().taxonomy
    kinds = Taxonomy(tuple(c for c in t.categories if c.detector in ("lexicon", "regex", "regex_unless")), t.default_threshold)
    return detectors.findings(documents(spark, sf_dir), kinds, "doc_id").groupBy("doc_id", "rule_id").agg(F.count("*").alias("findings"))


@query()
def default_findings(spark, sf_dir):
    """The default taxonomy over all documents."""
    return detectors.findings(documents(spark, sf_dir), Settings.load().taxonomy, "doc_id")


@query()
def fired_categories(spark, sf_dir):
    """The categories of the default taxonomy that fire in each document, as sorted sets."""
    f = detectors.findings(documents(spark, sf_dir), Settings.load().taxonomy, "doc_id")
    return f.groupBy("doc_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


_BLAME = Category("blame", "entity_blame", family="propaganda", base_confidence=0.8, terms=("the", "and"), group_terms=("idiot", "moron", "worthless", "stupid", "pathetic", "loser", "of", "to"), entity_labels=(), min_blamed_sentences=2)


@query(rf"""
WITH {_SENTENCES}, w AS (SELECT id, sentence_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS ws FROM sentence),
t AS (SELECT id, sentence_id, target FROM (SELECT id, sentence_id, unnest(ws) AS target FROM w WHERE list_has_any(ws, ['the', 'and'])) WHERE target IN ('idiot', 'moron', 'worthless', 'stupid', 'pathetic', 'loser', 'of', 'to'))
SELECT id AS doc_id, target, count(*) AS mentions FROM t GROUP BY id, target HAVING count(DISTINCT sentence_id) >= 2""")
def scapegoat(spark, sf_dir):
    """The entity_blame kind, over words that occur in the documents."""
    f = detectors.findings(documents(spark, sf_dir), Taxonomy((_BLAME,), 0.8), "doc_id", found=False)
    return f.groupBy("doc_id", F.lower("text").alias("target")).agg(F.count("*").alias("mentions"))


_VALUES = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in entities.VALENCE.items())
_BOOSTS = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in entities.BOOSTERS.items())
_MOODS = rf"""
valence(word, v) AS (VALUES {_VALUES}), boost(word, b) AS (VALUES {_BOOSTS}),
spoken AS (SELECT id, sentence_id, list_transform(list_filter(regexp_extract_all(text, '{SQL_TOKEN}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: lower(x)) AS w FROM sentence),
said AS (SELECT id, sentence_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM spoken),
felt AS (SELECT id, sentence_id, sum((v + sign(v) * coalesce(b, 0)) * CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], [{", ".join("'" + x.replace("'", "''") + "'" for x in entities.NEGATIONS)}]) AND i > 1 THEN {entities.TURN}::DOUBLE ELSE 1 END) AS s
  FROM said JOIN valence USING (word) LEFT JOIN boost ON boost.word = w[i - 1] AND i > 1 GROUP BY id, sentence_id),
mood AS (SELECT id, sentence_id, coalesce(s / sqrt(s * s + {entities.NORM}), 0) AS compound FROM sentence LEFT JOIN felt USING (id, sentence_id))"""


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CAPITALS = r"\p{Lu}[\p{L}\p{N}&’''-]*(?:[ \t\r\n]+(?:of[ \t\r\n]+(?:the[ \t\r\n]+)?)?\p{Lu}[\p{L}\p{N}&’''-]*)*"
_ENTITIES = rf"""
capital AS (SELECT id, sentence_id, start_char, text, regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_\p{{M}}])({_CAPITALS})') AS m, regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_\p{{M}}])({_CAPITALS})', 2) AS e,
  string_split_regex(text, '(^|[^\p{{L}}\p{{N}}_\p{{M}}]){_CAPITALS}') AS g FROM sentence WHERE regexp_matches(text, '\p{{Lu}}')),
run AS (SELECT id, sentence_id, start_char, unnest(e) AS e, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM capital),
named AS (SELECT id, sentence_id, e, start_char + stop - length(e) AS s, stop = length(e) AS opens, string_split(regexp_replace(lower(e), '\s+', ' ', 'g'), ' ') AS w
  FROM (SELECT *, sum(gap + n) OVER (PARTITION BY id, sentence_id ORDER BY pos) AS stop FROM run)),
labelled AS (SELECT id, sentence_id, e AS text, s::BIGINT AS start_char, (s + length(e))::BIGINT AS end_char, CASE
  WHEN list_contains({_sql_list(entities.PEOPLES)}, array_to_string(w, ' ')) OR list_contains({_sql_list(entities.PEOPLES)}, array_to_string(list_filter(w, lambda x: x <> 'the'), ' ')) THEN 'NORP'
  WHEN list_contains({_sql_list(entities.PLACES)}, array_to_string(list_filter(w, lambda x: x <> 'the'), ' ')) THEN 'GPE'
  WHEN len(w) > 1 AND list_contains({_sql_list(entities.BODIES)}, w[-1]) THEN 'ORG' WHEN len(w) > 1 AND (list_contains({_sql_list(entities.TITLES)}, w[1]) OR NOT opens) THEN 'PERSON' END AS label FROM named),
entity AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', '') AS key FROM labelled WHERE label IS NOT NULL)"""
_FEELINGS = """
feeling AS (SELECT id, key, arg_min(label, (start_char, end_char)) AS label, count(*) AS mentions FROM entity GROUP BY id, key),
average AS (SELECT id, key, round_even(avg(compound), 6) AS mean FROM (SELECT DISTINCT id, key, sentence_id FROM entity) JOIN mood USING (id, sentence_id) GROUP BY id, key)"""


@query(f"""
WITH {_SENTENCES}, {_MOODS}, {_ENTITIES}, {_FEELINGS}, pick AS (SELECT id, max((mean, key)) AS warm, min((mean, key)) AS cold FROM average GROUP BY id HAVING max(mean) >= 0 AND min(mean) <= 0)
SELECT e.id AS doc_id, e.text, count(*) AS mentions FROM entity e JOIN pick p USING (id) WHERE trim(regexp_replace(lower(e.text), '\\s+', ' ', 'g')) IN (p.warm[2], p.cold[2]) GROUP BY ALL""")
def card_stacking(spark, sf_dir):
    """The entity_sentiment_split kind over all documents, at thresholds that the documents reach."""
    c = Category("split", "entity_sentiment_split", family="bias", base_confidence=0.8, entity_labels=("PERSON", "ORG", "NORP", "GPE"), positive_threshold=0.0, negative_threshold=0.0, min_entities=1, min_mentions=1)
    return detectors.findings(documents(spark, sf_dir), Taxonomy((c,), 0.8), "doc_id").groupBy("doc_id", "text").agg(F.count("*").alias("mentions"))


@query(f"WITH {_SENTENCES}, {_ENTITIES} SELECT id AS doc_id, text, label, start_char, end_char, sentence_id FROM entity")
def entities_gazetteer(spark, sf_dir):
    return _long(entities.entities(documents(spark, sf_dir), "doc_id"), "start_char", "end_char", "sentence_id")


@query(f"WITH {_SENTENCES}, {_MOODS} SELECT id AS doc_id, sentence_id, round_even(compound, 6) AS compound FROM mood")
def sentence_sentiment(spark, sf_dir):
    return _long(entities.sentence_sentiment(documents(spark, sf_dir), "doc_id"), "sentence_id")


@query(f"WITH {_SENTENCES}, {_MOODS}, {_ENTITIES}, {_FEELINGS} SELECT id AS doc_id, key AS entity_key, label, mentions, mean AS average_sentiment FROM feeling JOIN average USING (id, key)")
def entity_sentiment(spark, sf_dir):
    return entities.entity_sentiment(documents(spark, sf_dir), "doc_id").select("doc_id", "entity_key", "label", "mentions", "average_sentiment")


@query(r"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower('The  ' || c_name || ' AND a' || c_mktsegment), '\s+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', '') AS entity_key FROM customer")
def entity_key(spark, sf_dir):
    name = F.concat(F.lit("The  "), "c_name", F.lit(" AND a"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.entity_key(name).alias("entity_key"))


# ---------------------------------------------------------------- joins of spans


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(x).cast("long").alias(x) if x in names else x for x in df.columns))


_LINES = """
line AS (SELECT doc_id, pos - 1 AS line, e - length(t) - 1 AS line_start, e - 1 AS line_end FROM (
  SELECT doc_id, pos, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE length(t) > 0)"""


@query(f"WITH {_SENTENCES}, {_LINES} SELECT doc_id, line, sentence_id FROM line JOIN sentence ON id = doc_id AND line_start < start_char + length(text) AND start_char < line_end")
def line_sentences(spark, sf_dir):
    """Every line with every sentence that it shares characters with: an overlap join."""
    docs = documents(spark, sf_dir)
    ends = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    at = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n + 1).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    lines = docs.select("doc_id", F.posexplode(F.arrays_zip(at.alias("a"), ends.alias("n"))).alias("line", "x")).select("doc_id", "line", F.col("x.a").alias("line_start"), (F.col("x.a") + F.col("x.n")).alias("line_end"))
    own = segment.sentences(docs, "doc_id").drop("text")
    return _long(intervals.overlapping(lines, own, ["doc_id"], ("line_start", "line_end")).select("doc_id", "line", "sentence_id"), "line", "sentence_id")


def _tokens_placed(spark, sf_dir) -> DataFrame:
    return segment.tokens(documents(spark, sf_dir), "doc_id").select("doc_id", "text", F.col("idx").alias("start_char"), (F.col("idx") + F.length("text")).alias("end_char"))


def _quotes_placed(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.inline(spans.quoted_regions(F.col("text")))).select("doc_id", F.col("start").alias("quote_start"), F.col("end").alias("quote_end"))


_QUOTES = """
quote AS (SELECT doc_id, e - length(w) AS quote_start, e AS quote_end FROM (SELECT doc_id, w, sum(gap + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS e FROM (
  SELECT doc_id, kind, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM (
    SELECT doc_id, kind, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM documents, (VALUES (1, '"[^"]{1,600}"'), (2, '“[^”]{1,600}”')) q(kind, p)))))"""
_PLACED = rf"""
token AS (SELECT doc_id, w AS text, e - length(w) AS start_char, e AS end_char FROM (SELECT doc_id, w, sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (
  SELECT doc_id, unnest(m) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{SQL_TOKEN}') AS m, string_split_regex(text, '{SQL_TOKEN}') AS g FROM documents))))"""


@query(f"WITH {_QUOTES}, {_PLACED} SELECT doc_id, text, start_char::BIGINT AS start_char, quote_start::BIGINT AS quote_start FROM token JOIN quote USING (doc_id) WHERE quote_start <= start_char AND end_char <= quote_end")
def quoted_tokens(spark, sf_dir):
    """Every token with the quotation that it stands in: a containment join."""
    out = intervals.overlapping(_tokens_placed(spark, sf_dir), _quotes_placed(spark, sf_dir), ["doc_id"], right_span=("quote_start", "quote_end"), within=True)
    return _long(out.select("doc_id", "text", "start_char", "quote_start"), "start_char", "quote_start")


@query(f"WITH {_QUOTES}, {_SENTENCES} SELECT id AS doc_id, count(*) AS sentences FROM sentence s WHERE NOT EXISTS (SELECT 1 FROM quote q WHERE q.doc_id = s.id AND quote_start < start_char + length(s.text) AND start_char < quote_end) GROUP BY id")
def unquoted_sentences(spark, sf_dir):
    """The sentences of a document that no quotation touches: an anti join by overlap."""
    own = segment.sentences(documents(spark, sf_dir), "doc_id").drop("text")
    return intervals.touched(own, _quotes_placed(spark, sf_dir), ["doc_id"], right_span=("quote_start", "quote_end"), anti=True).groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query(rf"""
WITH {_SENTENCES}, {_LINES} SELECT doc_id, line, sentence_id FROM line LEFT JOIN sentence ON id = doc_id AND start_char <= line_end AND line_end < start_char + length(text)""")
def line_end_sentences(spark, sf_dir):
    """The sentence that goes on over the end of a line, null where none does: a point join."""
    docs = documents(spark, sf_dir)
    t = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"), "text").drop("text")
    own = Window.partitionBy("doc_id").orderBy("line")
    lines = t.select("doc_id", "line", (F.sum(F.length("t") + 1).over(own) - 1).alias("line_end"), "t").where(F.length("t") > 0).drop("t")
    out = intervals.located(lines, segment.sentences(docs, "doc_id").drop("text"), ["doc_id"], "line_end")
    return _long(out.select("doc_id", "line", "sentence_id"), "line", "sentence_id")


# ---------------------------------------------------------------- term weights, neighbours, hierarchies


@query(rf"""
WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{SQL_TOKEN}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: lower(x)) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM n GROUP BY term),
x AS (SELECT doc_id, term, n, df, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS weight FROM n JOIN d USING (term))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank, term, n, df, round(weight, 6) AS weight FROM x QUALIFY rank <= 10""")
def term_weights(spark, sf_dir):
    """The ten weightiest words and pairs of words of every document."""
    docs = documents(spark, sf_dir)
    found = terms.best(docs, docs.count(), 10, "doc_id", "text", (1, 2))
    return _long(found.withColumn("weight", F.round("weight", 6)), "rank")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.v, b.v) AS cosine FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 10 = 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank, id, round(cosine, 6) AS cosine FROM x QUALIFY rank <= 10""")
def nearest_vectors(spark, sf_dir):
    """The ten nearest vectors of every tenth, among all."""
    e = table(spark, sf_dir, "embeddings")
    found, _ = vectors.nearest(e, e.where("vec_id % 10 = 0"), 10, "vec_id")
    return _long(found.withColumn("cosine", F.round("cosine", 6)), "rank")


def _places(spark, sf_dir) -> DataFrame:
    """(page_id, path): the place of every page, from the host's top domain down to the last part of its address."""
    u = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    host, path = F.regexp_extract(u, r"^[a-z]+://([^/]*)", 1), F.regexp_extract(u, r"^[a-z]+://[^/]*/?(.*?)/*$", 1)
    parts = F.concat(F.reverse(F.split(host, r"\.")), F.filter(F.split(path, "/"), lambda x: x != ""))
    return table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))


def _edges(spark, sf_dir) -> DataFrame:
    up = lambda n: F.array_join(F.slice(F.col("parts"), F.lit(1), n), "/")
    steps = _places(spark, sf_dir).select("parts", F.explode(F.sequence(F.lit(2), F.greatest(F.size("parts"), F.lit(2)))).alias("n")).where(F.col("n") <= F.size("parts"))
    return steps.select(up(F.col("n")).alias("node"), up(F.col("n") - 1).alias("parent")).distinct()


_TREE = r"""
place AS (SELECT page_id, list_concat(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/]*)', 1), '.')), list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/]*/?(.*?)/*$', 1), '/'), lambda x: x <> '')) AS parts
  FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)),
edge AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS node, array_to_string(parts[1:n - 1], '/') AS parent FROM (SELECT parts, unnest(range(2, len(parts) + 1)) AS n FROM place)),
closed(node, ancestor, distance) AS (SELECT node, parent, 1 FROM edge UNION ALL SELECT c.node, e.parent, distance + 1 FROM closed c JOIN edge e ON e.node = c.ancestor)"""


@query(f"WITH RECURSIVE {_TREE} SELECT node, ancestor, distance::BIGINT AS distance FROM closed")
def url_ancestors(spark, sf_dir):
    """All ancestors of every place in the tree of page addresses."""
    return _long(hierarchy.closure(_edges(spark, sf_dir)), "distance")


@query(f"""
WITH RECURSIVE {_TREE}, own AS (SELECT array_to_string(parts, '/') AS node, count(*) AS n FROM place GROUP BY ALL)
SELECT node, sum(n)::BIGINT AS pages FROM (SELECT node, n FROM own UNION ALL SELECT ancestor, n FROM own JOIN closed USING (node)) GROUP BY node""")
def pages_below(spark, sf_dir):
    """How many pages every place of the tree has at and below it."""
    own = _places(spark, sf_dir).select(F.array_join("parts", "/").alias("node"), F.lit(1).alias("one"))
    return hierarchy.projected(own, hierarchy.closure(_edges(spark, sf_dir)), "one").select("node", F.col("total").cast("long").alias("pages"))


# ---------------------------------------------------------------- scores


def words(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("word_count"))


def scores(spark, sf_dir) -> DataFrame:
    s = bench()
    return scoring.category_scores(words(spark, sf_dir), findings(spark, sf_dir), s.taxonomy, s.scoring, "doc_id")


#: Findings of each category of the bench taxonomy by document, and the words; then the scores.
_COUNTS = rf"""
words AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '{SQL_TOKEN}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n,
  len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x) IN ('idiot', 'moron', 'worthless', 'stupid', 'pathetic', 'loser')))::BIGINT AS slur,
  len(regexp_extract_all(text, '[#$%&*]{{3}}'))::BIGINT + len(regexp_extract_all(text, '[0-9]{{5,}}'))::BIGINT AS junk FROM documents),
{_SENTENCES}, {_SLOGANS}, {_GRAMS},
a AS (SELECT id AS doc_id, sum(len(regexp_extract_all(text, '(?i)inthe[a-z]*')) + len(regexp_extract_all(text, '(?i)thing[a-z]*')))::BIGINT AS c FROM sentence WHERE NOT regexp_matches(text, '[0-9]') GROUP BY id),
b AS (SELECT doc_id, count(*) AS c FROM slogan GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS c FROM repeated GROUP BY doc_id),
wide AS (SELECT doc_id, n, slur, junk, coalesce(a.c, 0) AS unsourced, coalesce(b.c, 0) AS slogan, coalesce(r.c, 0) AS repetition, 0::BIGINT AS weak FROM words LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN r USING (doc_id)),
long AS (SELECT doc_id, wide.n AS words, k.category, k.ord, k.family, k.conf::DOUBLE AS conf, k.sev::DOUBLE AS sev, k.dis::DOUBLE AS dis,
  CASE k.ord WHEN 0 THEN slur WHEN 1 THEN junk WHEN 2 THEN unsourced WHEN 3 THEN slogan WHEN 4 THEN repetition ELSE weak END AS c FROM wide,
  (VALUES ('slur', 0, 'propaganda', 0.85, 0.7, 0.4), ('junk', 1, 'style', 0.9, 0.1, 0.1), ('unsourced', 2, 'bias', 0.8, 0.5, 0.3), ('slogan', 3, 'fallacy', 0.8, 0.4, 0.2), ('repetition', 4, 'propaganda', 0.8, 0.4, 0.2), ('weak', 5, 'style', 0.5, 0.1, 0.0)) k(category, ord, family, conf, sev, dis)),
s AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE round(1 - exp(-4.0::DOUBLE * (c * conf) / pow(greatest(words, 1), 0.5)), 6) END AS score FROM long)"""


@query(f"WITH {_COUNTS} SELECT doc_id, category, c AS count, round(c * conf, 6) AS raw, score FROM s")
def category_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("doc_id", "category", "count", "raw", "score")


@query("SELECT doc_id, 6::BIGINT AS categories FROM documents")
def densified(spark, sf_dir):
    """Every document has every category, also without findings."""
    return scores(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("categories"))


@query(f"WITH {_COUNTS} SELECT doc_id, category, c AS instances, round(conf * sev, 6) AS max_instance_severity, round(1 - exp(-c::DOUBLE), 6) AS accumulated_severity, sev AS severity_weight FROM s WHERE c > 0")
def severity(spark, sf_dir):
    s = bench()
    return scoring.severity(scores(spark, sf_dir), s.taxonomy, s.scoring, "doc_id").drop("ord", "disruption")


@query(f"""
WITH {_COUNTS}, w AS (SELECT doc_id, max(conf * sev * dis) AS worst, arg_max(category, struct_pack(v := conf * sev * dis, o := -ord)) AS driver FROM s WHERE c > 0 AND dis > 0 GROUP BY doc_id)
SELECT doc_id, round(coalesce(worst, 0), 6) AS logical_flow_disruption, driver AS disruption_driven_by, round(1 - coalesce(worst, 0), 6) AS coherence FROM documents LEFT JOIN w USING (doc_id)""")
def disruption(spark, sf_dir):
    s = bench()
    return scoring.disruption(words(spark, sf_dir), scoring.severity(scores(spark, sf_dir), s.taxonomy, s.scoring, "doc_id"), s.scoring, "doc_id")


def _composites(spark, sf_dir, **change):
    s = bench()
    return scoring.composites(scores(spark, sf_dir), s.taxonomy, replace(s.scoring, **change), "doc_id")


_FAMILY = "avg(score) FILTER (family = '{}')"
_PROP = "coalesce(ln(avg(exp(4 * score)) FILTER (family = 'propaganda' AND score > 0)) / 4, 0)"
_ADDED = "sum(CASE WHEN c > 0 AND family <> 'style' THEN 0.1::DOUBLE ELSE 0 END)"
_BAND = f"CASE WHEN {_ADDED} < 0.3 THEN 'low' WHEN {_ADDED} < 0.7 THEN 'moderate' ELSE 'high' END"


@query(f"WITH {_COUNTS} SELECT doc_id, round({_PROP}, 6) AS prop_score FROM s GROUP BY doc_id")
def prop_smooth(spark, sf_dir):
    return _composites(spark, sf_dir).select("doc_id", "prop_score")


@query(f"WITH {_COUNTS} SELECT doc_id, round(1 - product(1 - score), 6) AS prop_score FROM s WHERE family = 'propaganda' GROUP BY doc_id")
def prop_noisy_or(spark, sf_dir):
    return _composites(spark, sf_dir, method="noisy_or").select("doc_id", "prop_score")


@query(f"WITH {_COUNTS} SELECT doc_id, round(least({_ADDED}, 1), 6) AS additive_manipulation, {_BAND} AS band, {_ADDED} > 1 AS clipped FROM s GROUP BY doc_id")
def additive(spark, sf_dir):
    return _composites(spark, sf_dir).select("doc_id", "additive_manipulation", "band", "clipped")


@query(f"WITH {_COUNTS} SELECT doc_id, round({_FAMILY.format('fallacy')}, 6) AS fallacy_score, round({_FAMILY.format('bias')}, 6) AS bias_signal FROM s GROUP BY doc_id")
def family_mean(spark, sf_dir):
    return _composites(spark, sf_dir).select("doc_id", "fallacy_score", "bias_signal")


_INDEX = f"1 - (1 - round({_PROP}, 6)) * (1 - round({_FAMILY.format('fallacy')}, 6)) * (1 - round({_FAMILY.format('bias')}, 6))"


@query(f"WITH {_COUNTS} SELECT doc_id, round({_INDEX}, 6) AS manipulation_index FROM s GROUP BY doc_id")
def manipulation(spark, sf_dir):
    return _composites(spark, sf_dir).select("doc_id", "manipulation_index")


@query(f"WITH {_COUNTS} SELECT doc_id, round_even(sum(score) / 6, 6) AS article_score FROM s GROUP BY doc_id")
def article_score(spark, sf_dir):
    return _composites(spark, sf_dir).select("doc_id", "article_score")


@query("SELECT count(*) AS published, count(*) AS withheld FROM documents")
def headline(spark, sf_dir):
    a = _composites(spark, sf_dir, expose_composite=True).agg(F.count("composite").alias("published"))
    return a.join(_composites(spark, sf_dir).agg(F.sum(F.col("composite").isNull().cast("long")).alias("withheld")), how="cross")  # a row with a row


@query(f"""
WITH {_COUNTS} SELECT doc_id, round({_PROP}, 6) AS prop_score, round({_FAMILY.format('fallacy')}, 6) AS fallacy_score, round({_FAMILY.format('bias')}, 6) AS bias_signal,
  round(least({_ADDED}, 1), 6) AS additive_manipulation, {_BAND} AS band, {_ADDED} > 1 AS clipped, round({_INDEX}, 6) AS manipulation_index, round_even(sum(score) / 6, 6) AS article_score FROM s GROUP BY doc_id""")
def document_composites(spark, sf_dir):
    rows = _composites(spark, sf_dir)
    return rows.select("doc_id", "prop_score", "fallacy_score", "bias_signal", "additive_manipulation", "band", "clipped", "manipulation_index", "article_score")


# ---------------------------------------------------------------- a changed taxonomy

QUERIES["in_quotation"], ORACLES["in_quotation"] = in_quotation, _in_quotation_sql()


@query(f"""
WITH {_COUNTS} SELECT 'slur' AS category, 'changed' AS status, (SELECT sum(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x) IN ('idiot', 'loser', 'scum'))))::BIGINT FROM documents) AS findings
UNION ALL SELECT 'junk', 'removed', 0 UNION ALL SELECT 'unsourced', 'same', sum(unsourced)::BIGINT FROM wide UNION ALL SELECT 'slogan', 'same', sum(slogan)::BIGINT FROM wide UNION ALL SELECT 'repetition', 'same', sum(repetition)::BIGINT FROM wide""")
def taxonomy_update(spark, sf_dir):
    """Findings of all documents brought from one taxonomy to another, in which one category has other terms and one is gone."""
    from quillon.plans import incremental

    docs, old = documents(spark, sf_dir), bench().taxonomy
    new = Taxonomy(tuple(replace(c, terms=("idiot", "loser", "scum")) if c.id == "slur" else c for c in old.categories if c.id != "junk"), old.default_threshold)
    up = incremental.update(incremental.start(docs, old, "doc_id"), docs, docs, old, new, "doc_id")
    counted = up.findings.groupBy("category").agg(F.count("*").alias("findings"))
    return up.rules.join(counted, "category", "left").select("category", "status", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


# ---------------------------------------------------------------- clusters


@query()
def category_suggestions(spark, sf_dir):
    """The ten weightiest words of eight clusters of all documents: words that a taxonomy might take up."""
    docs = documents(spark, sf_dir)
    listed = terms.listed(docs, docs.count(), "doc_id", "text")
    rows = hierarchy._fixed(cluster.hashed_lists(listed, "doc_id"))
    made = cluster.fit(rows, 8, "doc_id", rounds=5)
    if made is None:
        return spark.createDataFrame([], "cluster int, rank int, term string, documents long, weight double")
    return cluster.suggested(listed, made.centres)


# ---------------------------------------------------------------- calibrated scores


def _slur_scores(spark, sf_dir) -> DataFrame:
    """(doc_id, rule, label): the score of slurs in every document, and its label where it has one."""
    docs = documents(spark, sf_dir)
    found = findings(spark, sf_dir, "slur")  # no rule depends on those of other categories
    words = docs.select("doc_id", text.word_count(F.col("text")).alias("word_count"))
    scores = scoring.category_scores(words, found, bench().taxonomy, bench().scoring, "doc_id").where("category = 'slur'").select("doc_id", F.col("score").alias("rule"))
    return scores.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")


@query(f"""
WITH {_COUNTS}, rows AS (SELECT doc_id, score, least(floor(score * 200), 199) AS bin, toxic FROM s LEFT JOIN labels USING (doc_id) WHERE category = 'slur'),
sums AS (SELECT bin, count(*) AS n, sum(toxic) AS pos FROM rows WHERE toxic IS NOT NULL GROUP BY bin),
running AS (SELECT bin, n, pos, sum(n) OVER w AS upto_n, sum(pos) OVER w AS upto FROM sums WINDOW w AS (ORDER BY bin)),
means AS (SELECT j.bin AS j, k.bin AS k, (k.upto - j.upto + j.pos)::DOUBLE / (k.upto_n - j.upto_n + j.n) AS m FROM running j JOIN running k ON j.bin <= k.bin),
lows AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM means),
fit AS (SELECT k AS bin, max(low) AS value FROM lows GROUP BY k)
SELECT doc_id, score, round(coalesce(fit.value, (SELECT value FROM fit ORDER BY bin LIMIT 1)), 6) AS calibrated FROM rows ASOF LEFT JOIN fit ON rows.bin >= fit.bin""")
def calibrated_scores(spark, sf_dir):
    """The score of slurs as a probability of the label toxic, by an isotonic fit on all labelled documents."""
    rows = hierarchy._fixed(_slur_scores(spark, sf_dir))  # for the fit and for what it is used on
    fitted = calibrate.fit(rows, "rule")
    return rows.select("doc_id", F.col("rule").alias("score"), F.round(fitted.probability(F.col("rule")), 6).alias("calibrated"))


@query()
def hybrid_scores(spark, sf_dir):
    """(doc_id, held_out, label, rule, model, routed, calibrated): rules where they are sure, else blended with a model of the words.

    The model is fitted on labelled documents in classes 2 to 4 of five by checksum of the id, the calibration on class 1; class 0 is held out.
    """
    docs = documents(spark, sf_dir)
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    rules = hierarchy._fixed(_slur_scores(spark, sf_dir))
    seen = docs.join(rules.where("label is not null").select("doc_id", "label"), "doc_id").where(part >= 2)
    rows = rules.join(calibrate.model_scores(docs, calibrate.text_model(seen)), "doc_id").withColumn("routed", calibrate.routed(F.col("rule"), F.col("model"), 0.8, 0.25))
    rows = hierarchy._fixed(rows)
    fitted = calibrate.fit(rows.where(part == 1), "routed", bins=20)
    return rows.select("doc_id", (part == 0).alias("held_out"), "label", "rule", "model", "routed", fitted.probability(F.col("routed")).alias("calibrated"))


# ---------------------------------------------------------------- encodings


@query()
def encoding_detection(spark, sf_dir):
    """Every text written in five encodings and read back by a model of four fifths of the texts: (encoding, held_out, texts, right)."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = encodings.fit(encodings.pair_counts(docs.where(~held_out)))
    rows = encodings.trial(docs, model).where("expressible").withColumn("held_out", held_out)
    return rows.groupBy(F.col("written_in").alias("encoding"), "held_out").agg(F.count("*").alias("texts"), F.sum(F.col("same_text").cast("long")).alias("right"))


# ---------------------------------------------------------------- records and checks


@query()
def records_flat(spark, sf_dir):
    from quillon.plans.analyze import analyze

    return records.flat(analyze(documents(spark, sf_dir).select("text", F.col("lang").alias("language"), F.col("source").alias("title")), bench()))


@query("SELECT 0::BIGINT AS mismatches")
def evidence_check(spark, sf_dir):
    return records.evidence_mismatches(findings(spark, sf_dir), documents(spark, sf_dir), "doc_id").agg(F.count("*").alias("mismatches"))


@query("SELECT 0::BIGINT AS violations")
def schema_violations(spark, sf_dir):
    from quillon.plans.analyze import analyze

    s = bench()
    return records.violations(analyze(documents(spark, sf_dir), s), len(s.taxonomy.categories)).agg(F.count("*").alias("violations"))


# ---------------------------------------------------------------- evaluation: slurs found against the labels, roles as corpora


def _fired(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    fired = detectors.findings(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), bench().taxonomy, "id").select("id", "category").where("category in ('slur', 'junk')").distinct()
    return fired.join(labels.select("id"), "id", "left_semi"), labels.where("toxic = 1").select("id", F.lit("slur").alias("category")), labels.select("id")


_FIRED = rf"""
hits AS (SELECT doc_id AS id, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x) IN ('idiot', 'moron', 'worthless', 'stupid', 'pathetic', 'loser'))) > 0 AS slur,
  regexp_matches(text, '[#$%&*]{{3}}') OR regexp_matches(text, '[0-9]{{5,}}') AS junk, toxic = 1 AS toxic FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT 'slur' AS category, sum((slur AND toxic)::INT)::BIGINT AS tp, sum((slur AND NOT toxic)::INT)::BIGINT AS fp, sum((toxic AND NOT slur)::INT)::BIGINT AS fn FROM hits
  UNION ALL SELECT 'junk', 0, sum(junk::INT)::BIGINT, 0 FROM hits HAVING sum(junk::INT) > 0),
rates AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM counts),
full_rates AS (SELECT *, CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) WHEN p IS NULL AND r IS NULL THEN NULL ELSE 0 END AS f FROM rates)"""


@query(f"WITH {_FIRED} SELECT category, tp, fp, fn FROM counts")
def confusion(spark, sf_dir):
    fired, expected, _ = _fired(spark, sf_dir)
    return evaluate.confusion(fired, expected)


@query(f"WITH {_FIRED} SELECT category, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM full_rates")
def prf(spark, sf_dir):
    fired, expected, _ = _fired(spark, sf_dir)
    return evaluate.with_rates(evaluate.confusion(fired, expected)).select("category", "precision", "recall", "f1")


@query(f"""
WITH {_FIRED}, m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS micro_precision, round(tp / nullif(tp + fn, 0), 6) AS micro_recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS micro_f1,
  (SELECT round(avg(round(p, 6)), 6) FROM full_rates) AS macro_precision, (SELECT round(avg(round(r, 6)), 6) FROM full_rates) AS macro_recall, (SELECT round(avg(round(f, 6)), 6) FROM full_rates) AS macro_f1 FROM m""")
def micro_macro(spark, sf_dir):
    fired, expected, _ = _fired(spark, sf_dir)
    return evaluate.summary(evaluate.confusion(fired, expected))


@query(f"WITH {_FIRED} SELECT count(*) AS examples, sum((slur = toxic AND NOT junk)::INT)::BIGINT AS exact, sum((toxic AND NOT slur)::INT)::BIGINT AS missed, sum((slur AND NOT toxic)::INT + junk::INT)::BIGINT AS spurious FROM hits")
def exact_match(spark, sf_dir):
    fired, expected, examples = _fired(spark, sf_dir)
    rows = evaluate.by_example(fired, expected, examples)
    return rows.agg(F.count("*").alias("examples"), F.sum(F.col("exact").cast("long")).alias("exact"), F.sum(F.size("missed")).cast("long").alias("missed"), F.sum(F.size("spurious")).cast("long").alias("spurious"))


@query(f"WITH {_FIRED} SELECT category FROM (VALUES ('slur'), ('junk'), ('other')) t(category) WHERE category NOT IN (SELECT category FROM counts WHERE tp + fp + fn > 0)")
def unmeasured(spark, sf_dir):
    fired, expected, _ = _fired(spark, sf_dir)
    return evaluate.unmeasured(evaluate.confusion(fired, expected), spark.createDataFrame([("slur",), ("junk",), ("other",)], "category string"))


def _roles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("corpus"), "text")
    f = rows.select("id", F.explode(F.array(F.struct(F.lit("comma").alias("category"), F.size(F.regexp_extract_all("text", F.lit(","), F.lit(0))).alias("n")), F.struct(F.lit("digit").alias("category"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("n")))).alias("x"))
    f = f.select("id", "x.category", F.explode(F.sequence(F.lit(1), F.greatest(F.col("x.n"), F.lit(1)))).alias("i"), "x.n").where("n > 0").select("id", "category")
    return rows.select("id", "corpus", text.word_count(F.col("text")).alias("word_count")), f


_ROLES = rf"""
r AS (SELECT conv_id || ':' || turn AS id, role AS corpus, len(list_filter(regexp_extract_all(text, '{SQL_TOKEN}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS w, len(regexp_extract_all(text, ','))::BIGINT AS comma, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS digit FROM conversations),
l AS (SELECT corpus, 'comma' AS category, sum(comma)::BIGINT AS n FROM r GROUP BY corpus UNION ALL SELECT corpus, 'digit', sum(digit)::BIGINT FROM r GROUP BY corpus UNION ALL SELECT corpus, NULL, sum(comma + digit)::BIGINT FROM r GROUP BY corpus),
rates AS (SELECT corpus, category, n AS findings, t.words, CASE WHEN t.words > 0 THEN round(n / t.words * 1000, 4) ELSE 0 END AS per_1000 FROM l JOIN (SELECT corpus, sum(w)::BIGINT AS words FROM r GROUP BY corpus) t USING (corpus) WHERE n > 0)"""


@query(f"WITH {_ROLES} SELECT * FROM rates")
def corpus_rates(spark, sf_dir):
    return evaluate.corpus_rates(*_roles(spark, sf_dir))


@query(f"""
WITH {_ROLES}, s AS (SELECT category, coalesce(max(per_1000) FILTER (corpus = 'user'), 0) AS neutral, coalesce(max(per_1000) FILTER (corpus = 'assistant'), 0) AS loaded FROM rates GROUP BY category)
SELECT category, neutral, loaded, round(loaded / nullif(neutral, 0), 4) AS ratio FROM s""")
def separation(spark, sf_dir):
    return evaluate.separation(evaluate.corpus_rates(*_roles(spark, sf_dir)), "user", "assistant")


@query(f"WITH {_ROLES} SELECT category FROM (VALUES ('comma'), ('digit'), ('absent')) t(category) WHERE category NOT IN (SELECT category FROM rates WHERE category IS NOT NULL)")
def silent(spark, sf_dir):
    return evaluate.silent(spark.createDataFrame([("comma",), ("digit",), ("absent",)], "category string"), _roles(spark, sf_dir)[1])


@query(f"WITH {_ROLES} SELECT id, corpus, comma + digit AS findings, w AS words, CASE WHEN w > 0 THEN round((comma + digit) / w * 1000, 4) ELSE 0 END AS per_1000 FROM r WHERE comma + digit > 0 ORDER BY findings DESC, corpus, id LIMIT 15")
def top_docs(spark, sf_dir):
    return evaluate.top_documents(*_roles(spark, sf_dir))


# ---------------------------------------------------------------- labelled documents as corpora


def _labelled(spark, sf_dir):
    from quillon.plans import corpus

    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("ordinary").alias("corpus"))
    return corpus.run(documents(spark, sf_dir).join(labels, "doc_id"), bench(), "doc_id", title="source")


@query(f"""
WITH {_COUNTS} SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'ordinary' END AS corpus, source AS title, words, sum(c)::BIGINT AS findings,
  list_sort(coalesce(list(category) FILTER (c > 0), [])) AS categories, CASE WHEN words > 0 THEN round(sum(c) / words * 1000, 4) ELSE 0 END AS per_1000
FROM long JOIN labels USING (doc_id) JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S') GROUP BY doc_id, toxic, source, words""")
def corpus_documents(spark, sf_dir):
    """What fires in every labelled document."""
    return _labelled(spark, sf_dir).documents


@query(f"""
WITH {_COUNTS}, per_label AS (SELECT toxic, sum(n) AS words FROM words JOIN labels USING (doc_id) GROUP BY toxic),
fired AS (SELECT category, toxic, sum(c) AS n FROM long JOIN labels USING (doc_id) GROUP BY ROLLUP (category), toxic),
by_label AS (SELECT category, toxic, round(n / words * 1000, 4) AS rate FROM fired JOIN per_label USING (toxic) WHERE n > 0)
SELECT category, coalesce(max(rate) FILTER (toxic = 0), 0) AS neutral, coalesce(max(rate) FILTER (toxic = 1), 0) AS loaded,
  round(coalesce(max(rate) FILTER (toxic = 1), 0) / nullif(coalesce(max(rate) FILTER (toxic = 0), 0), 0), 4) AS ratio FROM by_label GROUP BY category""")
def corpus_separation(spark, sf_dir):
    """Findings per 1,000 words in ordinary and toxic documents, by category and in all."""
    rows = evaluate.separation(_labelled(spark, sf_dir).rates, "ordinary", "toxic")
    return rows.select("category", "neutral", "loaded", "ratio")


@query(ORACLES["lexicon_findings"].replace("SELECT doc_id, 'slur:lexicon' AS rule_id, e - length(w) AS start_char, e AS end_char, w AS text FROM o WHERE", """
SELECT doc_id, corpus, title, category, rule_id, start_char, text, replace(substr(body, greatest(start_char - 60, 0) + 1, start_char + length(text) + 60 - greatest(start_char - 60, 0)), chr(10), ' ') AS context FROM (
SELECT o.doc_id, lang AS corpus, source AS title, 'slur' AS category, 'slur:lexicon' AS rule_id, e - length(w) AS start_char, w AS text, d.text AS body FROM o JOIN documents d USING (doc_id) WHERE""") + ")")
def finding_contexts(spark, sf_dir):
    """Slurs in all documents, with sixty characters on either side; languages as corpora."""
    from quillon.plans import corpus

    s = bench()
    s = replace(s, taxonomy=Taxonomy(tuple(c for c in s.taxonomy.categories if c.id == "slur"), s.taxonomy.default_threshold))
    rows = corpus.run(documents(spark, sf_dir), s, "doc_id", "lang", "source").findings
    return rows.withColumn("start_char", F.col("start_char").cast("long"))


@query("SELECT count(*) FILTER (trim(text) <> '') AS processed, count(*) FILTER (coalesce(trim(text), '') = '') AS failed, 'OK' AS gate FROM documents")
def batch_summary(spark, sf_dir):
    from quillon.plans.analyze import analyze
    from quillon.plans.analyze import batch_summary as summary

    rows = documents(spark, sf_dir)
    return summary(analyze(rows, bench()), rows.where(F.coalesce(F.trim("text"), F.lit("")) == ""))
