import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, warc


def want(pages, least=1000):
    data = [(i, (h or "").encode()) for i, h in pages]
    out = []
    for i, p in data:
        same = [j for j, q in data if q == p and j is not None]
        first = max(same, default=None)
        revisit = len(p) >= least and first is not None and first != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def made():
    r = random.Random(3)
    pages = [(1, None), (2, ""), (3, "short"), (4, "short"), (None, "x" * 1000), (5, "x" * 1000), (6, "x" * 999), (7, "x" * 999), (8, "x" * 1000)]
    pages += [(100 + i, "é" * r.randrange(400, 600) + str(i // 3)) for i in range(60)]
    pages += [(-5 - i, f"negative {i % 2} " * 200) for i in range(4)]
    pages += [(200 + i, bytes(r.randrange(1, 127) for _ in range(30_000)).decode()) for i in range(20)]
    return pages


def test_round_trip_and_ranges(spark, tmp_path):
    pages = made()
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.when(F.col("page_id") % 2 == 0, "http://é.example/ü")).withColumn("key", F.lit(0))
    warc.write(df.repartition(2), f"{tmp_path}/a")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part*")))
    assert whole.count(b"WARC/1.1\r\n") == len(pages) and whole.endswith(b"\r\n\r\n")
    for size in ("700", "20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            records = warc.read(spark, f"{tmp_path}/a")
            assert sorted((tuple(r) for r in queries.warc_digest(records).collect()), key=str) == want(pages)
            bodies = {r.record_id: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert bodies["urn:x-page:200"] == dict(pages)[200].encode()


@pytest.mark.parametrize("size", ["500", "3000", "64m"])
def test_magic_inside_data(spark, tmp_path, size):
    """Stored, not compressed, members whose payload is full of false magic; some decode as gzip themselves."""
    r = random.Random(int(size[:-1]))
    (tmp_path / "b").mkdir()
    payloads = {str(i): b"".join(r.choice([warc.MAGIC, warc.gzip_member(b"no record"), b"\x1f\x8b", bytes([r.randrange(256)]) * 9]) for _ in range(r.randrange(0, 120))) for i in range(60)}
    data = b"".join(warc.gzip_member(warc.record(i, "u", p, None) + b"\r\n\r\n", 0) for i, p in payloads.items())
    (tmp_path / "b" / "one.warc").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {x.record_id.split(":")[-1]: bytes(x.payload) for x in warc.read(spark, f"{tmp_path}/b").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wrong = [i for i in payloads if got.get(i) != payloads[i]]
    assert not wrong and len(got) == len(payloads)


def test_controls_in_headers_and_textual_ids(spark, tmp_path):
    pages = [("a b\r\nX: y", "http://x/\r\nWARC-Type: revisit\r\n\r\n", "é" * 600), ("b", "http://y/ z", "é" * 600), ("b", "u", "short"), (None, None, None)]
    warc.write(spark.createDataFrame(pages, "page_id string, url string, html string"), f"{tmp_path}/a")
    got = sorted((r.record_id, r.record_type, r.target_uri, r.refers_to, r.payload_bytes) for r in warc.read(spark, f"{tmp_path}/a").collect())
    assert got == [
        ("urn:x-page:", "response", "", None, 0),
        ("urn:x-page:a%20b%0D%0AX:%20y", "revisit", "http://x/%0D%0AWARC-Type:%20revisit%0D%0A%0D%0A", "urn:x-page:b", 1200),
        ("urn:x-page:b", "response", "http://y/%20z", None, 1200),
        ("urn:x-page:b", "response", "u", None, 5),
    ]


def test_names_that_end_in_gz(spark, tmp_path):
    pages = made()
    warc.write(spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("u")).repartition(3), f"{tmp_path}/a")
    for p in [*(tmp_path / "a").glob("part*")]:
        p.rename(p.with_name(f"{p.stem}.warc.gz"))
    for p in (tmp_path / "a").glob(".*crc"):
        p.unlink()
    assert sorted((tuple(r) for r in queries.warc_digest(warc.read(spark, f"{tmp_path}/a")).collect()), key=str) == want(pages)


def test_many_owners_meet_by_salt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "OWNERS", 0)
    pages = made()
    warc.write(spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit(None).cast("string")), f"{tmp_path}/a")
    assert sorted((tuple(r) for r in queries.warc_digest(warc.read(spark, f"{tmp_path}/a")).collect()), key=str) == want(pages)


def test_query_and_empty(spark):
    d = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_warc(spark, d).collect()), key=str) == want(pages)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert queries.warc_round_trip(spark, empty).count() == 0


@pytest.mark.parametrize("size", ["60", "300", "64m"])
def test_magic_before_the_first_decoded_bytes(spark, tmp_path, size):
    """The magic stands in front of the compressed data, in the gzip header: nothing is decoded when the next piece begins."""
    (tmp_path / "c").mkdir()
    extra = b"x" * 30 + warc.MAGIC + b"\x08" * 4 + warc.MAGIC
    field = bytes([len(extra), 0]) + extra
    data = b""
    for i in range(40):
        plain = warc.gzip_member(warc.record(str(i), "u", b"payload" * i, None) + b"\r\n\r\n")
        data += plain[:3] + b"\x04" + plain[4:10] + field + plain[10:] if i % 2 else plain
    (tmp_path / "c" / "one.warc").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {x.record_id.split(":")[-1]: bytes(x.payload) for x in warc.read(spark, f"{tmp_path}/c").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {str(i): b"payload" * i for i in range(40)}
