import json

from quillon.config import Settings
from quillon.plans import corpus



def plain(n):
    return " ".join(f"word{i}" for i in range(n)) + "."


LOUD = "It was a vile and shameless trick.\nThe crook left, a vile man. " + plain(30)


def folder(tmp_path):
    for name in ("neutral", "rhetorical"):
        (tmp_path / name).mkdir()
    (tmp_path / "neutral" / "a.txt").write_text(plain(100))
    (tmp_path / "neutral" / "b.txt").write_text("Cafe\u0301 owners were vile. " + plain(60))  # NFC makes one character of two
    (tmp_path / "neutral" / "blank.txt").write_text(" \n")
    (tmp_path / "neutral" / "unlisted.txt").write_text(LOUD)
    (tmp_path / "rhetorical" / "c.txt").write_text(LOUD)
    listed = {
        "neutral": {"documents": [{"title": "A", "file": "neutral/a.txt"}, {"title": "B", "file": "b.txt"}, {"title": "Blank", "file": "blank.txt"}, {"title": "Gone", "file": "gone.txt"}]},
        "rhetorical": {"documents": [{"title": "C", "file": "c.txt"}]},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(listed))
    return str(tmp_path)


def test_run(spark, tmp_path):
    docs = corpus.from_manifest(spark, folder(tmp_path))
    assert {(r.title, r.reason) for r in corpus.skipped(docs).collect()} == {("Blank", "blank"), ("Gone", "missing")}
    made = corpus.run(docs, Settings.load())
    each = {r.title: r for r in made.documents.collect()}
    assert set(each) == {"A", "B", "C"} and each["A"].findings == 0 and each["A"].categories == [] and each["A"].words == 100
    assert each["B"].id == "neutral/b.txt" and each["B"].categories == ["loaded_language"] and each["B"].per_1000 == 15.625
    found = made.findings.collect()
    assert len(found) == sum(r.findings for r in each.values())
    [b] = [r for r in found if r.title == "B"]
    start = len("Caf\u00e9 owners were ")
    assert (b.text, b.start_char) == ("vile", start) and b.context == ("Caf\u00e9 owners were vile. " + plain(60))[: start + 4 + 60]
    first = min((r for r in found if r.title == "C"), key=lambda r: r.start_char)
    assert "\n" not in first.context and LOUD.replace("\n", " ").startswith(first.context[:40])
    silent = {r.category for r in made.silent.collect()}
    assert silent == set(Settings.load().taxonomy.ids) - {r.category for r in found}
    body = corpus.report(made, 2)
    assert "2 listed documents" in body and "| neutral | 2 | 164 | 1 | 6.0976 |" in body and "| C | rhetorical |" in body
    assert corpus.neutral_rate(made) == 6.0976 and corpus.neutral_rate(made, "none") == 0.0


def test_command_line(spark, tmp_path, capsys):
    where = folder(tmp_path)
    assert corpus.main(["--corpus", where, "--report", f"{where}/r.md", "--out", f"{where}/out", "--max-neutral-rate", "7"]) == 0
    assert (tmp_path / "r.md").read_text() in capsys.readouterr().out
    assert spark.read.parquet(f"{where}/out/skipped").count() == 2
    assert corpus.main(["--corpus", where, "--max-neutral-rate", "6"]) == 1
    (tmp_path / "manifest.json").write_text("{")
    assert corpus.main(["--corpus", where]) == 1


def test_no_documents(spark):
    made = corpus.run(spark.createDataFrame([], "id string, corpus string, title string, text string"), Settings.load())
    assert made.documents.count() == 0 and made.findings.count() == 0
    assert "Nothing fires in neutral." in corpus.report(made)
