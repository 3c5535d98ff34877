import codecs

import numpy as np
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import encodings
from quillon.sources import readers

DIR = "/root/testdata/sf0.01"


def model_of(spark):
    docs = catalog.documents(spark, DIR).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return encodings.fit(encodings.pair_counts(docs))


def test_held_out_texts_come_back(spark):
    rows = catalog.encoding_detection(spark, DIR).collect()
    held = [r for r in rows if r.held_out]
    assert {r.encoding for r in held} == set(encodings.ENCODINGS[:5])
    assert sum(r.right for r in held) >= 0.98 * sum(r.texts for r in held) and min(r.right / r.texts for r in held) >= 0.95


def test_short_accented_texts(spark):
    """Texts that the encodings write differently, of one sentence each."""
    rows = spark.createDataFrame([(1, "Le café était fermé après l’été."), (2, "Die Straße führt über die Brücke, schöne Grüße."), (3, "El niño comió piñas en la montaña ayer; mañana volverá."), (4, None), (5, ""), (6, "日本")], "doc_id long, text string")
    got = encodings.trial(rows, model_of(spark)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 5, 6}
    assert sum(r.same_text for r in got if r.expressible) >= 0.9 * sum(r.expressible for r in got)
    assert [r.expressible for r in got if r.doc_id == 6 and r.written_in in ("cp1252", "utf-8")] == [True, False]


def test_counts(spark):
    docs = spark.createDataFrame([("aba", "x"), ("ab", "x"), ("é", "y"), (None, "y"), ("b", None), ("zz", "w")], "text string, lang string").withColumns({"n": F.lit(7), "pair": F.lit("clash")}).repartition(3)
    got = {(r.encoding, r.lang, r.pair): r.n for r in encodings.pair_counts(docs, encodings=("utf-8", "cp1252"), languages=2).collect()}
    a, b = ord("a"), ord("b")
    want = {(e, "x", p): n for e in ("utf-8", "cp1252") for p, n in ((a << 8 | b, 2), (1 << 16 | b << 8 | a, 1))} | {("utf-8", "y", 0xC3A9): 1} | {(e, None, ord("z") * 257): 1 for e in ("utf-8", "cp1252")}
    assert got == want
    assert encodings.fit(encodings.pair_counts(docs.limit(0))).decode(b"x") == ("x", None)


def test_marks_and_bytes_that_nothing_reads():
    m = encodings.Model(["utf-8", "cp1252"], np.full((2, encodings.PAIRS), -5.0, np.float32))
    assert m.decode(codecs.BOM_UTF8 + "é".encode()) == ("é", "utf-8")
    assert m.decode(codecs.BOM_UTF16_LE + "é".encode("utf-16-le")) == ("é", "utf-16-le")
    assert m.decode(b"") == ("", "utf-8") and m.decode(b"\xe9t\xe9") == ("été", "cp1252") and m.decode(b"\x81")[1] is None
    long = "a" * (encodings.HEAD - 1) + "é" * 4  # the head ends inside a character
    assert m.decode(long.encode()) == (long, "utf-8")


def test_files(spark, tmp_path):
    texts = {"a.txt": "Die schöne Straße führt über die Brücke.", "b.md": "Le café était fermé après l'été, très tôt.", "c.xml": "<a>é</a>"}
    for (name, t), e in zip(texts.items(), ("cp850", "mac_roman", "utf-8"), strict=True):
        (tmp_path / name).write_bytes(t.encode(e))
    got = {r.file_name: r.text for r in readers.read_files(spark, str(tmp_path), model=model_of(spark)).collect()}
    assert got["a.txt"] == texts["a.txt"] and got["b.md"].strip() == texts["b.md"] and got["c.xml"] == "é"
