import json
import os
import zipfile

from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.plans.analyze import analyze
from quillon.sources import readers, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(path, body, core=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if core:
            z.writestr("docProps/core.xml", f'<c:p xmlns:c="c" xmlns:d="d">{core}</c:p>')


def p(text, style=None):
    own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{own}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_metadata_and_word_documents(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr></w:tbl>"
    word(tmp_path / "d.docx", p("Head", "Heading1") + p("One.") + p(" ") + table + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>", "<d:title>T</d:title><d:creator>Ann</d:creator><d:subject></d:subject>")
    (tmp_path / "e.TXT").write_text("Words.")
    os.utime(tmp_path / "e.TXT", (1_700_000_000, 1_700_000_000))
    rows = {r.file_name: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    d, e = rows["d.docx"], rows["e.TXT"]
    details = json.loads(d.details)
    assert d.text == "Head\n\nOne.\n\nx\ty" and (d.title, d.author) == ("T", "Ann") and d.mime_type.endswith("wordprocessingml.document")
    assert details["tables"] == [[["a", "b\nc"]]] and details["properties"] == {"title": "T", "author": "Ann"} and details["headings"] == [{"style": "Heading1", "text": "Head"}]
    assert details["styles"] == {"Heading1": 1, "Normal": 3} and details["paragraphs"] == 4
    assert (e.extension, e.mime_type, e.modified.timestamp(), e.size, e.author) == (".txt", "text/plain", 1_700_000_000, 6, None)
    good, _ = readers.read_folder(spark, str(tmp_path))
    known = {r.title: json.loads(r.metadata) for r in good.collect()}
    assert known["e.TXT"]["modified"] == "2023-11-14T22:13:20" and known["T"]["size"] == (tmp_path / "d.docx").stat().st_size
    records = {r.source.title: r.source.author for r in analyze(good, Settings.load(taxonomy_file="bench_taxonomy.yaml")).collect()}
    assert records == {"T": "Ann", "e.TXT": None}


def test_key_of_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body\n1,One.\n2,Two.\n")
    (tmp_path / "b.json").write_text('{"body": "Three.", "content": "no"}')
    (tmp_path / "c.jsonl").write_text('{"body": "Four."}\n{"text": "Five."}\n')
    files = {"enabled": True, "directory": str(tmp_path), "csv": {"text_column": "body"}, "json": {"text_field": "other"}}
    assert readers.text_key(files) == "body" and readers.text_key({"json": {"text_field": "x"}}) == "x" and readers.text_key({"csv": None}) == "content"
    assert [r.text for r in readers.pull(spark, {"files": files}).collect()] == ["One.\n\nTwo.", "Three.", "Four.\n\nFive."]
    assert readers.pull(spark, {"files": files | {"enabled": False}}) is None and readers.pull(spark, {}) is None


def test_pushed_metadata(spark):
    row = readers.route(spark, {"content": "Words.", "file_name": "f", "author": "A", "n": 3, "plain_text": " "}).first()
    assert (row.text, row.title, row.author) == ("Words.", "f", "A") and json.loads(row.metadata) == {"file_name": "f", "n": 3}
    assert "metadata" not in readers.route(spark, {"text": "Words."}).columns


def test_file_per_document(spark, tmp_path):
    records = spark.createDataFrame([(f"{i:064x}", "é", None) for i in (1 << 200, 2 << 200, 1 << 200)], "document_id string, z string, a string").repartition(3)
    (tmp_path / "other.txt").write_text("stays")
    for where in (tmp_path, tmp_path, f"file://{tmp_path}"):
        sinks.json_files(records, str(where))
    names = sorted(x.name for x in tmp_path.iterdir())
    assert names == sorted([f"{i << 200:064x}"[:16] + ".json" for i in (1, 2)] + ["other.txt"])
    assert (tmp_path / names[0]).read_text() == json.dumps({"document_id": f"{1 << 200:064x}", "z": "é", "a": None}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    sinks.json_files(records.where(F.lit(False)), str(tmp_path / "none"))
