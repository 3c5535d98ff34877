"""WARC archives: a writer, and a splittable reader that finds gzip members inside byte ranges."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common as c

MAGIC = b"\x1f\x8b\x08"  # every gzip member begins so: two fixed bytes and the only compression method there is
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


OWNERS = 100_000  # so many groups of equal payloads are broadcast at most: about 10 MB
SALTS = 32  # beyond that, rows with one payload are dealt to so many places

#: What can't stand in a header line or ends a field, percent-encoded.
CONTROLS = {x: f"%{x:02X}" for x in [*range(0x21), 0x7F]}


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: The two line ends after each record, a member of its own: Spark's text writer can then put it between any two rows.
RECORD_END = gzip_member(b"\r\n\r\n")


def record(page_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record with the payload, or a revisit that names the record it repeats; either has the payload's digest and size."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri, page_id, refers_to = (x if x is None else x.translate(CONTROLS) for x in (uri, page_id, refers_to))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 1000) -> None:
    """One record per row of pages in gzip archives under path, each record in its own member.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others revisits of
    it; smaller payloads are always responses. A null payload is empty, a null uri is empty, a null id is written as
    an empty one and never referred to. Repeated rows are written each. Control characters and spaces in ids and uris are percent-encoded.

    Payloads stay where they are read: the owners of repeated payloads, one short row each, are counted and broadcast. Of more
    than OWNERS, rows and owners meet by payload and salt, so that no payload's copies go to one task.
    """
    c.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(uri_col, F.lit("")).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    owner = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    owner = c.saved(owner, "owners")
    if owner.count() <= OWNERS:
        rows = rows.join(F.broadcast(owner), "key", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "uri"), F.lit(SALTS)))
        rows = rows.join(owner.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"], "left")
    rows = rows.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "uri", "payload", F.when((F.col("owner") != F.col("id")) | F.col("id").isNull(), F.col("owner").cast("string")).alias("refers_to")
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "payload", 8 << 20):
            made = [gzip_member(record(*(x.as_py() for x in row))) for row in zip(*(batch[k] for k in ("id", "uri", "payload", "refers_to")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    made = rows.mapInArrow(c.tidy(members), "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    made.write.option("encoding", "ISO-8859-1").option("lineSep", RECORD_END.decode("latin-1")).text(path)


class Member:
    """Decodes one gzip member piece by piece."""

    def __init__(self) -> None:
        self.z, self.out, self.failed = zlib.decompressobj(31), bytearray(), False

    def feed(self, data: bytes) -> None:
        try:
            self.out += self.z.decompress(data)
        except zlib.error:
            self.failed = True

    def is_record(self) -> bool:
        """Does what has been decoded begin as a WARC record?"""
        return not self.failed and bytes(self.out[:5]) == b"WARC/"

    def undecided(self) -> bool:
        """Is too little decoded yet to tell?"""
        return not self.failed and not self.z.eof and len(self.out) < 5

    def ended(self) -> bool:
        return self.z.eof and not self.failed


#: Hadoop's codec that passes bytes through, for names in .gz; the extension's key has another name where Hadoop's client is shaded.
RAW = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"} | {f"{x}io.compress.passthrough.extension": ".gz" for x in ("", "org.apache.hadoop.shaded.")}

FIELDS = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_bytes long, payload_digest string, payload binary"
NONE = (None,) * 8


def parse(data: bytes, payload: bool) -> tuple:
    """The fields of one decoded record; digest and size of a revisit are those it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(own.get("content-length", len(rest)))]
    kind = own.get("warc-type", "")
    http, _, body = block.partition(b"\r\n\r\n") if own.get("content-type", "").startswith("application/http") else (b"", b"", block)
    size, digest = len(body), hashlib.sha1(body).hexdigest()
    if kind == "revisit":
        stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        size = int(stated["content-length"]) if stated.get("content-length", "").isdigit() else None
        said = own.get("warc-payload-digest", "")
        digest = base64.b32decode(said[5:]).hex() if said.startswith("sha1:") else None
    return (own.get("warc-record-id", "").strip("<>"), kind, own.get("warc-target-uri"), own.get("warc-date"), own.get("warc-refers-to", "").strip("<>") or None, size, digest, body if payload else None)


def _records(payload: bool):
    """Rows of a task: (state 0) records that end in this byte range; (1) the unfinished last one; (2) pieces of one that began before;
    (3) pieces from a candidate on that is still undecided at the end: they may begin a record, or go on with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, place, member, held, at, begun = 0, None, None, b"", 0, False
        tried: list[tuple[int, bytes]] = []  # the pieces of a member that is undecided

        def leave() -> None:
            if tried:
                rows.extend((3, *place, k, data, *NONE) for k, data in tried)
            elif member is not None:
                rows.append((1, *place, at, held, *NONE))

        for batch in c.chunks(batches, "value", 8 << 20):
            for file, start, piece in zip(*(batch[k].to_pylist() for k in ("file", "start", "value")), strict=True):
                if (file, start) != place:
                    leave()
                    place, member, at, begun, tried = (file, start), None, 0, False, []
                at += 1
                if start == 0 and at == 1 and not piece:
                    continue  # what stands before the first magic of a file
                todo = deque([(at, MAGIC + piece)])
                while todo:
                    k, data = todo.popleft()
                    if member is None:
                        member, held, fresh = Member(), b"", True
                    else:  # the magic was part of the compressed data
                        fresh = bool(tried)
                    held += data
                    member.feed(data)
                    if fresh:
                        tried.append((k, data))
                        if member.undecided():
                            continue
                        if not member.is_record():
                            if not begun or not member.ended():  # may continue what began before; later, whole members that are no records just stand between
                                rows.append((2, *place, *tried[0], *NONE))
                            todo.extendleft(reversed(tried[1:]))  # each may be a candidate itself
                            member, tried = None, []
                            continue
                        begun, tried = True, []
                    if member.failed:
                        rows.append((2, *place, k, data, *NONE))
                        member = None
                    elif member.ended():
                        rows.append((0, *place, k, None, *parse(bytes(member.out), payload)))
                        size += len(member.out) if payload else 0
                        member = None
                if len(rows) >= 5000 or size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        leave()
        yield _batch(rows)

    return run


TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *(pa.string(),) * 5, pa.int64(), pa.string(), pa.binary()]
NAMES = ["state", "file", "start", "at", "held", *(x.split()[0] for x in FIELDS.split(", "))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(TYPES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, TYPES, strict=True)], NAMES)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path: the columns of FIELDS.

    Each task gets a byte range from Spark's own text source, with the gzip magic as record separator: it scans its range for
    the magic, owns the candidates that begin inside and reads past its end to finish the last. A candidate counts when its first
    bytes decode to a WARC header; until five bytes are decoded it stays open. The magic can also occur inside compressed data: a member that hasn't ended takes the next
    piece; where that piece belongs to the next range, both are put together by file afterwards (these are rare, and small).
    Damaged members are dropped. An empty folder gives no rows. Files whose names end in .gz aren't split, as Hadoop splits no file
    of that name: each is one range, read as it is (a codec that passes bytes through stands in for gzip's).
    """
    c.small_batches(spark)
    pieces = spark.read.options(**RAW).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).schema("value string").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = c.saved(pieces.mapInArrow(c.tidy(_records(payload)), f"state int, file string, start long, at long, held binary, {FIELDS}"), "warc")

    def joined(table: pa.Table) -> pa.Table:
        rows, member, tried = [], None, []
        todo = deque(table.sort_by([("start", "ascending"), ("at", "ascending")]).to_pylist())
        while todo or tried:
            if tried and (not todo or todo[0]["state"] == 1):  # never decided: no record, but its other pieces may begin one
                todo.extendleft(reversed(tried[1:]))
                member, tried = None, []
                continue
            r = todo.popleft()
            if r["state"] == 1:
                member = Member()
            elif member is None and r["state"] == 3:
                member, tried = Member(), [r]
            elif tried:
                tried.append(r)
            if member is not None:
                member.feed(r["held"])
                if tried and not member.undecided():
                    if not member.is_record():
                        todo.extendleft(reversed(tried[1:]))
                        member, tried = None, []
                        continue
                    tried = []
                if member.failed or member.ended():
                    rows += [(0, r["file"], r["start"], r["at"], None, *parse(bytes(member.out), payload))] if member.ended() else []
                    member = None
        return pa.Table.from_batches([_batch(rows)]).select(NAMES[5:])

    cut = found.where("state > 0").groupBy("file").applyInArrow(c.tidy(joined), FIELDS)
    return found.where("state = 0").select(NAMES[5:]).unionByName(cut)
