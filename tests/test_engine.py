"""The engine on its own small texts: every detector fires and stays quiet where it should, offsets hold, formulas add up."""

import json
import math
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import catalog, config
from quillon.__main__ import main as cli
from quillon.config import Category, Taxonomy
from quillon.errors import InvalidInputError, NoTextFoundError, UnsupportedFileTypeError
from quillon.functions import batches, spans, text
from quillon.operators import detectors, entities, records, scoring, segment
from quillon.plans import analyze as plan
from quillon.plans import corpus
from quillon.sources import readers, sinks
from quillon.streaming import analyze as stream

FIRES = {
    "loaded_language": "It was a vile and shameless trick.",
    "name_calling": "That man is a crook and a bigot.",
    "glittering_generalities": "Unity, courage and honour for all!",
    "appeal_to_fear": "Soon we reach the point of no return.",
    "whataboutism": "They lost the files. But what about the other team?",
    "thought_terminating_cliche": "He shrugged. Case closed.",
    "gaslighting": "You're imagining things again.",
    "guilt_by_association": "The club is linked to criminals.",
    "bandwagon": "Nobody doubts this plan.",
    "false_dilemma": "The only way forward is to sign.",
    "no_true_scotsman": "No real farmer would say so.",
    "burden_of_proof": "Could you prove otherwise?",
    "motive_fallacy": "She just says that because it pays.",
    "slippery_slope": "Where does it end?",
    "anecdotal_evidence": "I know a man who fell ill after it.",
    "unsupported_quantifier": "Countless families suffer.",
    "appeal_to_authority": "Doctors agree it works.",
    "source_opaqueness": "It is widely believed that he left.",
    "statistical_manipulation": "Crime is up by nearly 40%.",
    "repetition": "Build the new road now. We say build the new road. They must build the new road. Just build the new road.",
    "hedging": "Perhaps it rains.",
    "scapegoating": "Bankers are to blame for it. It rained. The bankers are at fault here as well.",
    "card_stacking": "Alder Society did superb and brilliant work. Alder Society was praised. Birch Council was a terrible failure. Birch Council was condemned as corrupt.",
}
QUIET = [
    "The vile-smelling gas was removed by the assembly of the familiar liars' club.".replace("vile-smelling", "smelling").replace("liars'", "list"),
    "Many people (61% of 900) agreed.",
    "Doctors agree, according to a 2019 review published in Nature.",
    "Bankers are to blame for it, one paper said. The bank opened in June.",
    "Alder Society did superb work. Alder Society was praised. Birch Council did brilliant work. Birch Council was praised.",
    "The freedom of the press was discussed at length by the members of the committee on Tuesday and again on Friday, with justice done to both.",
]


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(k, v) for k, v in FIRES.items()] + [(f"quiet{i}", v) for i, v in enumerate(QUIET)]
    df = spark.createDataFrame(rows, "id string, text string")
    found = detectors.findings(df, config.Settings.load().taxonomy, "id").collect()
    return dict(rows), found


def test_every_category_fires_on_its_text_and_not_on_quiet_ones(fired):
    texts, found = fired
    assert set(FIRES) == set(config.Settings.load().taxonomy.ids)
    got = {(r.id, r.category) for r in found}
    assert {(k, k) for k in FIRES} <= got
    assert not [g for g in got if g[0].startswith("quiet")]
    assert all(texts[r.id][r.start_char : r.end_char] == r.text and r.rule_id.startswith(r.category) for r in found)
    assert len([r for r in found if r.id == "repetition" and r.category == "repetition"]) == 4
    assert [r.text.lower() for r in found if r.category == "scapegoating"] == ["bankers", "bankers"]


def test_threshold(spark):
    s = config.Settings.load(threshold=0.99)
    df = spark.createDataFrame([(1, FIRES["bandwagon"])], "id long, text string")
    assert detectors.findings(df, s.taxonomy, "id").count() == 0


def test_offsets_with_astral_characters(spark):
    t = "😀 é vile; vile"
    row = spark.createDataFrame([(t,)], "t string").select(spans.matches(F.col("t"), r"(?iU)\bvile\b").alias("m"), F.expr(spans.matches_sql("t", r"(?iU)\bvile\b")).alias("s")).first()
    assert [(x.start, x.end) for x in row.m] == [(i, i + 4) for i in (4, 10)] and row.m == row.s


def test_sentences(spark):
    cases = {
        "Dr. Lin met J. Smith at 3.30 p.m. today. He left.": ["Dr. Lin met J. Smith at 3.30 p.m. today.", "He left."],
        "A line\nwrapped here. Next\n\nHeadline\n\nBody text.": ["A line\nwrapped here.", "Next", "Headline", "Body text."],
        '  "Go!" she said. (Yes.) No  ': ['"Go!" she said.', "(Yes.)", "No"],
        "It closed on Mon. The rest stayed.": ["It closed on Mon.", "The rest stayed."],
        "": [], "  \n\n ": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "document_id long, text string")
    rows = segment.sentences(df).orderBy("document_id", "sentence_id").collect()
    for i, (t, want) in enumerate(cases.items()):
        own = [r for r in rows if r.document_id == i]
        assert [r.text for r in own] == want
        assert [r.sentence_id for r in own] == list(range(len(own)))
        assert all(t[r.start_char : r.end_char] == r.text for r in own)


def test_quotes(spark):
    t = 'He said "it is vile" and “so vile” but \'vile\' and "' + "x" * 601 + ' vile'
    found = detectors.findings(spark.createDataFrame([(1, t)], "id long, text string"), config.taxonomy({"categories": [{"id": "v", "detector": "lexicon", "terms": ["vile"]}]}), "id")
    assert [r.in_quotation for r in found.orderBy("start_char").collect()] == [True, True, False, False]


def test_scores_from_evidence(spark):
    s = config.Settings.load()
    words = spark.createDataFrame([(1, 16), (2, 0)], "document_id long, word_count int")
    found = spark.createDataFrame([(1, "hedging", 0.8)] * 3 + [(1, "gaslighting", 0.9)], "document_id long, category string, confidence double")
    rows = {(r.document_id, r.category): r for r in scoring.category_scores(words, found, s.taxonomy, s.scoring).collect()}
    assert len(rows) == 2 * 23
    assert rows[1, "hedging"].raw == pytest.approx(0.12) and rows[1, "gaslighting"].score == pytest.approx(round(1 - math.exp(-4 * 0.9 / 4), 6))
    assert rows[2, "hedging"].score == 0
    sev = scoring.severity(scoring.category_scores(words, found, s.taxonomy, s.scoring), s.taxonomy, s.scoring)
    flow = {r.document_id: r for r in scoring.disruption(words, sev, s.scoring).collect()}
    assert flow[1].disruption_driven_by == "gaslighting" and flow[1].logical_flow_disruption == pytest.approx(0.9 * 0.9 * 0.6)
    assert flow[2].coherence == 1 and flow[2].disruption_driven_by is None


def test_records_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("café is vile. Perhaps.",), ("café is vile. Perhaps.",), ("Plain.",), (" ",)], "text string")
    s = config.Settings.load()
    assert sorted(Counter(r.document_id for r in plan.analyze(df, s).select("document_id").collect()).values()) == [1, 2]
    out = plan.analyze(df, s, distinct=True)
    rows = out.collect()
    assert len(rows) == 2 and records.violations(out, 23).count() == 0
    assert {len(r.category_scores) for r in rows} == {23}
    sinks.sink({"format": "jsonl"})(out, f"{tmp_path}/a")
    lines = [x for p in sorted((tmp_path / "a").glob("part*")) for x in p.read_text().splitlines()]
    again = [r.value for r in sinks.sorted_json(plan.analyze(df.repartition(5), s, distinct=True)).orderBy("document_id").collect()]
    assert lines == again and json.loads(lines[0])["composites"]["calibrated"] is False
    sinks.sink({"format": "parquet"})(out, f"{tmp_path}/b")
    assert len(spark.read.parquet(f"{tmp_path}/b").columns) == 13
    with pytest.raises(ValueError):
        sinks.sink({"format": "tape"})


def test_one_and_batch(spark):
    one = plan.analyze_one(spark, "It is vile.", title="T")
    assert one["source"]["title"] == "T" and one["findings"][0]["text"] == "vile"
    with pytest.raises(NoTextFoundError):
        plan.analyze_one(spark, "  ")
    with pytest.raises(InvalidInputError):
        plan.analyze_batch(spark, [])
    with pytest.raises(NoTextFoundError):
        plan.analyze_batch(spark, ["a", " "])
    got = plan.analyze_batch(spark, ["It is vile.", "Plain.", "It is vile.", "cafe\u0301"])
    assert [len(r["findings"]) for r in got] == [1, 0, 1, 0] and got[0] == got[2]


def test_config_checks():
    for bad in ({}, {"categories": [{"detector": "regex", "patterns": ["a"]}]}, {"categories": [{"id": "a", "detector": "x"}]}, {"categories": [{"id": "a", "detector": "lexicon"}]}, {"categories": [{"id": "a", "detector": "regex_unless", "patterns": ["a"]}]}):
        with pytest.raises(ValueError):
            config.taxonomy(bad)
    assert config.digest({"a": 1, "b": 2}) == config.digest({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        config.check_seed({})


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Perhaps é.\r\nIt is vile.".encode("cp1252"))
    (tmp_path / "b.md").write_text("# Title\n\n*Vile* [link](http://x.y) text.\n```py\ncode\n```\n")
    (tmp_path / "c.html").write_text("<html><head><title>T</title><style>p{}</style></head><body><p>It is <b>vile</b>.</p><script>x</script></body></html>")
    (tmp_path / "d.json").write_text('{"content": "It is vile.", "n": 3}')
    (tmp_path / "e.jsonl").write_text('{"content": "One."}\nbad\n{"content": "Two."}\n')
    (tmp_path / "f.csv").write_text("id,content\n1,It is vile.\n2,Fine.\n")
    (tmp_path / "g.xml").write_text("<r><p a='1'>It is</p><p>vile.</p></r>")
    (tmp_path / "h.xyz").write_text("?")
    (tmp_path / "i.txt").write_text("  ")
    (tmp_path / "j.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "k.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>It is vile.</w:t></w:r></w:p></w:body></w:document>')
    good, failed = readers.read_folder(spark, str(tmp_path))
    texts = {r.source_path.rsplit("/", 1)[1]: r.text for r in good.collect()}
    assert texts["a.txt"] == "Perhaps é.\nIt is vile." and texts["c.html"] == "T\nIt is vile." and texts["e.jsonl"] == "One.\n\nTwo." and texts["f.csv"] == "It is vile.\n\nFine." and texts["k.docx"] == "It is vile."
    assert set(texts) == {f"{x}" for x in ("a.txt", "b.md", "c.html", "d.json", "e.jsonl", "f.csv", "g.xml", "k.docx")}
    assert {(r.file, r.error_type) for r in failed.collect()} == {("h.xyz", "UnsupportedFileTypeError"), ("i.txt", "NoTextFoundError"), ("j.pdf", "ExtractionError")}
    done, failed = plan.classify_folder(spark, str(tmp_path), "*.txt")
    row = plan.batch_summary(done, failed).first()
    assert (row.processed, row.failed, row.gate) == (1, 1, "OK")


def test_routes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Words.")
    for payload in ("Some words.", b"Some words.", {"content": "Some words.", "title": "T"}, tmp_path / "a.txt", str(tmp_path / "a.txt")):
        assert readers.route(spark, payload).first().text in ("Some words.", "Words.")
    (tmp_path / "b.txt").write_text("  ")
    for payload, error in ((tmp_path / "b.txt", NoTextFoundError), (tmp_path / "none.txt", InvalidInputError), (3, InvalidInputError), ({"content": " "}, NoTextFoundError), (tmp_path / "a.bin", UnsupportedFileTypeError)):
        with pytest.raises(error):
            readers.route(spark, payload)


def test_small_functions(spark):
    row = spark.range(1).select(text.slug(F.lit(" Hello, World! ")).alias("a"), text.context(F.lit("x" * 100 + "\nhit" + "y" * 100), F.lit(101), F.lit(104)).alias("b"), text.white_words(F.lit(" a  b\n")).alias("c"), text.white_words(F.lit("")).alias("d")).first()
    assert (row.a, row.c, row.d) == ("hello_world", 2, 0) and row.b == "x" * 59 + " hit" + "y" * 60
    assert readers.string_leaves({"a": 1, "b": ["x", {}], "c": {"d": None}}) == {"b": ["x"]}
    assert readers.depth({"a": [1, {}]}) == 2 and readers.depth(3) == 0


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "It was good."), (2, "It was not good."), (3, "It was very good."), (4, "It was.")], "document_id long, text string")
    v = {r.document_id: r.compound for r in entities.sentence_sentiment(df).collect()}
    assert v[1] == pytest.approx(1 / math.sqrt(1 + 15), abs=1e-6) and v[2] < 0 < v[1] < v[3] and v[4] == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("It is vile.",), ("Plain.",)], "text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    stream.run(source, f"{tmp_path}/out", f"{tmp_path}/c1", config.Settings.load(taxonomy_file="bench_taxonomy.yaml")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    q = stream.sentence_findings(source, config.Settings.load()).writeStream.format("memory").queryName("f").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.text for r in spark.table("f").collect()] == ["vile"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("It is vile.")
    (tmp_path / "in" / "b.xyz").write_text("?")
    assert cli(["--input", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--save", "jsonl"]) == 0
    assert "1 processed, 1 failed: OK" in capsys.readouterr().out
    lines = [x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert [f["text"] for f in json.loads(lines[0])["findings"]] == ["vile"]
    errors = [json.loads(x) for p in (tmp_path / "out-errors.jsonl").glob("part*") for x in p.read_text().splitlines()]
    assert [(e["file"], e["error_type"]) for e in errors] == [("b.xyz", "UnsupportedFileTypeError")]
    assert cli(["--input", str(tmp_path / "in" / "a.txt"), "--out", str(tmp_path / "one"), "--save", "parquet"]) == 0
    assert cli(["--input", "  ", "--out", str(tmp_path / "two")]) == 1


def test_texts_of_a_batch_are_worked_on_in_slices(spark, monkeypatch):
    """What Python holds of a batch is one slice of it; nulls, empty texts and one larger than a slice come out in their rows."""
    monkeypatch.setattr(text, "PIECE", 64)
    texts = ["One two. Three!", None, "", "x" * 500 + ". Yes.", *["Go on. Stop it."] * 40, None]
    sizes = [[x for x in a.to_pylist()] for (a,) in text.pieces(pa.array(texts, pa.string()))]
    assert sum(sizes, []) == texts and len(sizes) > 8 and all(len(x) == 1 or sum(len(t or "") for t in x) <= 64 for x in sizes)
    seen = []
    monkeypatch.setattr(segment, "per_text", lambda a, found, **fields: seen.append(len(a)))
    monkeypatch.setattr(F, "arrow_udf", lambda run, kind: run)
    assert len(list(segment.text_udf(segment.sentence_spans, "")(iter([pa.array(texts, pa.string())])))) == len(sizes) and sum(seen) == len(texts)


def test_texts_are_brought_to_nfc_once_in_small_batches(spark):
    """Blank texts are left out before NFC, so no second worker of a task makes it for the filter; Spark's batches are held to BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(1, "Cafe\u0301 is open."), (2, " \u2000 "), (3, "   "), (4, ""), (5, None), (6, "\u0301"), (7, "\n")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({"corpus": F.lit("a"), "title": F.col("id").cast("string")})
    for made, want in (
        (lambda: plan.prepare(docs.withColumn("title", F.col("id").cast("string")), config.Settings.load()), {"1": "Caf\u00e9 is open.", "2": " \u2002 ", "6": "\u0301", "7": "\n"}),
        (lambda: corpus.run(docs, config.Settings.load()).documents, {"1": None, "2": None, "6": None}),
    ):
        spark.conf.unset(key)
        df = made()
        assert int(spark.conf.get(key).rstrip("b")) == batches.BATCH_BYTES
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [_nfc(") <= 1
        assert {r.title: r.asDict().get("text") for r in df.collect()} == want
    for made in (lambda: segment.tokens(docs, "id"), lambda: segment.sentences(docs, "id"), lambda: detectors.findings(docs, config.Settings.load().taxonomy, "id")):
        spark.conf.unset(key)
        made()
        assert int(spark.conf.get(key).rstrip("b")) == batches.BATCH_BYTES


def test_entities_given_beside_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "We met Ann Lee today.")], "document_id long, text string").coalesce(1)
    given = spark.createDataFrame([(1, "Bob", "PERSON", 0, 3, 0), (2, "Ann Lee", "PERSON", 7, 14, 0)], "document_id long, text string, label string, start_char int, end_char int, sentence_id int")
    c = Category("split", "entity_sentiment_split", base_confidence=0.9, entity_labels=("PERSON",), positive_threshold=0.0, negative_threshold=0.0, min_entities=1, min_mentions=1)
    assert [(r.document_id, r.text) for r in detectors.findings(docs, Taxonomy((c,), 0.8), found=given).collect()] == [(2, "Ann Lee")]


def test_texts_are_analysed_once_for_all_parts_of_a_record(spark):
    docs = spark.createDataFrame([("That man is a crook and a bigot.",), ("Fine weather today.",)], "text string")
    p = plan.analyze(docs, config.Settings.load())._jdf.queryExecution().executedPlan().toString()
    assert "_nfc(" in p and "run(" not in p  # NFC of the rows that the records are joined with; sentences and rules are kept


def test_calibrated_scores_scan_texts_once_for_one_category(spark, monkeypatch, tmp_path):
    asked = []
    own = detectors.findings
    monkeypatch.setattr(detectors, "findings", lambda docs, t, *a, **k: asked.append([c.id for c in t.categories]) or own(docs, t, *a, **k))
    for name, rows, kind in (("documents", [(1, "You idiot."), (2, "Kind words.")], "doc_id long, text string"), ("labels", [(1, 1), (2, 0)], "doc_id long, toxic int")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    made = catalog.QUERIES["calibrated_scores"](spark, str(tmp_path))
    assert asked == [["slur"]] and "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.calibrated for r in made.collect()} == {1: 1.0, 2: 0.0}


def test_words_of_repeated_phrases_in_any_script():
    """Plain ASCII goes another way; both find what counting in the text finds."""
    for word in ("so", "é", "don't", "a_b"):
        t = f"{word} big _ red hen! " * 4 + "the of and to " * 5
        assert detectors.Grams(t, 4).often(4) == [(m, m + len(f"{word} big _ red hen"), f"{word} big red hen") for m in range(0, len(f"{word} big _ red hen! ") * 4, len(f"{word} big _ red hen! "))] + [x for x in detectors.Grams(t, 4).often(4) if not x[2].startswith(word)]
        assert not any(x[2] == "the of and to" for x in detectors.Grams(t, 4).often(4)) and detectors.Grams("a b c d", 4).often(2) == []
