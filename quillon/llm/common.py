"""What several operators share: scratch tables, word hashing, and an exchange between blocks of documents and buckets of keys.

The exchange is how an operator learns a fact about a key (is it repeated, how often does it occur) from the whole corpus
without one row per occurrence and without a hot key:

* documents are dealt to *blocks* by a hash of their id, some MiB of text each, compressed (``pack``);
* a block sends each of its distinct keys once, sorted and delta-coded, in one blob per *bucket* of keys (``to_buckets``);
* a bucket merges the sorted keys of all blocks and answers each block in the order in which it asked (``answers``); there are as many
  buckets as blocks up to FEW_BLOCKS, and a sixteenth as many in the end (``bucket_count``).

A key that occurs in every document costs one entry per block, so no bucket and no task grows with the frequency of a key.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.batches import small_batches  # noqa: F401

BLOCK_BYTES = 6 << 20
BLOB_SCHEMA = "bucket int, block int, kind int, data binary"
REPLY_SCHEMA = "block int, bucket int, kind int, data binary"
U64 = np.uint64


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = os.path.join(tempfile.gettempdir(), f"quillon-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the scratch area, removed when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes a query's shuffle files when the query is done, not when the driver's JVM next collects its garbage.

    Only for queries whose results are kept elsewhere: another action on the same DataFrame would shuffle again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to a scratch table and read it back: cuts lineage and survives lost executors; df's shuffle files go at once."""
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._scratch)


# ---------------------------------------------------------------- memory of Python workers

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and what one has freed another executor process may need."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of one or two tables or a generator over batches, giving memory back when its own variables are gone."""
    if inspect.isgeneratorfunction(f):

        def batches(a):
            yield from f(a)
            give_back()

        return batches

    def one(a):
        out = f(a)
        give_back()
        return out

    def two(a, b):
        out = f(a, b)
        give_back()
        return out

    return one if len(inspect.signature(f).parameters) == 1 else two  # Spark counts parameters


# ---------------------------------------------------------------- arrays in blobs

_zip = zstandard.ZstdCompressor(level=1)
_unzip = zstandard.ZstdDecompressor()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Integer arrays in one compressed blob: bytes of equal weight stand together, so high zero bytes cost nothing."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([ord(a.dtype.kind), a.dtype.itemsize], np.uint8).tobytes() + np.uint64(len(a)).tobytes())
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return _zip.compress(b"".join(parts))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = _unzip.decompress(data)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        kind, width = raw[at], raw[at + 1]
        size = int(np.frombuffer(raw, np.uint64, 1, at + 2)[0])
        at += 10
        flat = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(flat.T).view(f"{chr(kind)}{width}").reshape(size))
        at += size * width
    return out


# ---------------------------------------------------------------- words and their hashes


class WordHash(dict):
    """xxh3 of a word, kept for the words seen lately."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain): spreads the bits, so that leading bits can choose a bucket."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def window_hash(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every run of ``width`` items, built by doubling; one value per start."""
    if len(h) < width:
        return np.empty(0, U64)
    done, total, run, span = 0, None, h, 1
    while True:
        if width & span:
            if total is None:
                total, done = run, span
            else:  # what is built so far stands first
                n = len(h) - done - span + 1
                total = total[:n] * U64(pow(base, span, 1 << 64)) + run[done : done + n]
                done += span
        if span * 2 > width:
            return total
        n = len(h) - 2 * span + 1
        run = run[:n] * U64(pow(base, span, 1 << 64)) + run[span : span + n]
        span *= 2


CHUNK = 1 << 20
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
PLACES = 64
_letter = mix(np.arange(1, PLACES * 256 + 1, dtype=U64) * U64(BASES[0]))  # by place in the word and byte


def _hashed(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of a byte array that aren't white space: sums of a random number for each (place, byte)."""
    inner = ~SPACES[part]
    edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
    starts = edges[::2]
    if not len(starts):
        return starts, np.empty(0, U64)
    body, size = part[inner], edges[1::2] - starts
    first = np.cumsum(size) - size
    place = np.arange(len(body), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    code = _letter[((place & (PLACES - 1)) << 8) | body]
    if size.max() > PLACES:
        code *= np.cumprod(np.array([1] + [BASES[1]] * int(size.max() // PLACES), U64))[place // PLACES]
    return starts, mix(np.add.reduceat(code, first) + size.astype(U64) * U64(BASES[1]))


class Words:
    """The words (runs between ASCII white space) of a block's documents in one array: 64-bit hashes, and for each word its place.

    Nothing is made per word but its hash; the bytes are taken about a MiB at a time, cut at white space.
    """

    def __init__(self, texts: Iterable[bytes | None], lower: bool = False):
        texts = [t or b"" for t in texts]
        flat = b"".join(t + b"\n" for t in texts)
        data = np.frombuffer(flat.lower() if lower else flat, np.uint8)  # bytes.lower changes A-Z only
        at, begins, hashes = 0, [np.empty(0, np.int64)], [np.empty(0, U64)]
        while at < len(data):
            to = at + CHUNK
            while to < len(data) and not SPACES[data[to - 1]]:
                space = np.flatnonzero(SPACES[data[to : to + 4096]])
                to = to + int(space[0]) + 1 if len(space) else to + 4096
            start, h = _hashed(data[at:to])
            begins.append(start + at)
            hashes.append(h)
            at = to
        self.hashes = np.concatenate(hashes)
        self.ends = np.searchsorted(np.concatenate(begins), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)).astype(np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.starts = self.ends - self.sizes

    def left(self) -> np.ndarray:
        return np.repeat(self.ends, self.sizes) - np.arange(len(self.hashes))

    def place(self) -> np.ndarray:
        return np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)


# ---------------------------------------------------------------- blocks of documents


def block_count(docs: DataFrame, text: str) -> int:
    """So many blocks that one holds about BLOCK_BYTES of text, at least as many as the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def block_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


FLUSH_BYTES = 24 << 20


def _payload(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, columns...) rows to one compressed payload per block and flush."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        block, rows = block[order], table.drop_columns(["block"]).take(order)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        data = [_payload(rows.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > FLUSH_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def pack(docs: DataFrame, block: Column, n: int, **columns: Column) -> DataFrame:
    """Rows (block, data): the named columns of docs, compressed, dealt to n partitions by block."""
    small_batches(docs.sparkSession)
    dealt = docs.select(block.alias("block"), *(c.alias(k) for k, c in columns.items()))
    return dealt.mapInArrow(tidy(_deal), "block int, data binary").repartition(n, "block")


def unpack(table: pa.Table) -> pa.Table:
    """The documents of one block."""
    give_back()
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["data"].to_pylist()])


# ---------------------------------------------------------------- the exchange


def unique_keys(k1: np.ndarray, k2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, inverse, counts) of the distinct keys in the order of k1 (then k2): k1[first] are the keys."""
    order = np.argsort(k1, kind="stable") if k2 is None else np.lexsort((k2, k1))
    a = k1[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if k2 is not None:
        b = k2[order]
        new[1:] |= b[1:] != b[:-1]
    rank = np.cumsum(new) - 1
    inverse = np.empty(len(a), np.int64)
    inverse[order] = rank
    at = np.flatnonzero(new)
    return order[at], inverse, np.diff(at, append=len(a))


FEW_BLOCKS, BUCKET_BLOCKS = 256, 16


def bucket_count(blocks: int) -> int:
    """As many buckets as blocks where these are few; else one for the keys of up to BUCKET_BLOCKS blocks, which it takes slice by slice.

    Blobs are as many as blocks times buckets, so larger buckets keep them large for longer.
    """
    return max(min(blocks, FEW_BLOCKS), -(-blocks // BUCKET_BLOCKS))


def _slices(keys: np.ndarray, n: int, first: int = 0, many: int | None = None) -> np.ndarray:
    """Where sorted keys pass from one of n equal ranges to the next, for ``many`` ranges from the ``first``."""
    return np.searchsorted((keys >> U64(32)) * U64(n) >> U64(32), np.arange(first, first + (n if many is None else many) + 1, dtype=U64))


def to_buckets(rows: list[tuple], n: int, block: int, kind: int, keys: np.ndarray, *columns: np.ndarray) -> None:
    """Append the rows (bucket, block, kind, data) of a block's sorted keys to rows; n: bucket_count() of the blocks."""
    cuts = _slices(keys, n)
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            part = slice(cuts[b], cuts[b + 1])
            rows.append((b, block, kind, pack_arrays(np.diff(keys[part], prepend=U64(0)), *(c[part] for c in columns))))


def blob_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("bucket", "block", "kind", "data"), columns, (pa.int32(),) * 3 + (pa.binary(),), strict=True)})


def reply_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("block", "bucket", "kind", "data"), columns, (pa.int32(),) * 3 + (pa.binary(),), strict=True)})


def answers(
    blobs: DataFrame,
    blocks: int,
    merge: Callable[[int, list[np.ndarray]], tuple[list[np.ndarray], list[tuple]]],
    brief: Callable[[int, list[np.ndarray]], list[np.ndarray]] = lambda block, arrays: arrays,
) -> DataFrame:
    """For each bucket and kind, merge(kind, [keys, columns...]) -> (arrays in the order of the keys, more reply rows).

    The keys of all blocks stand one block after the other; the arrays go back cut at the same places. A bucket of many blocks'
    keys is merged in slices of its range, each about a block's keys. brief(block, arrays) -> the arrays to send to a block,
    where it can do with less.
    """
    n = bucket_count(blocks)
    slices = -(-blocks // n)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        out: list[tuple] = []
        kinds = table["kind"].to_numpy()
        for kind in np.unique(kinds).tolist():
            asked = table.filter(pa.array(kinds == kind)).sort_by("block")  # the same order whenever the task runs again
            bucket, askers = asked["bucket"][0].as_py(), asked["block"].to_pylist()
            sent = [unpack_arrays(x) for x in asked["data"].to_pylist()]
            for p in sent:
                p[0] = np.cumsum(p[0], dtype=U64)
            places = [_slices(p[0], n * slices, bucket * slices, slices) for p in sent]
            found: list[list[list[np.ndarray]]] = [[] for _ in sent]
            for s in range(slices):
                own = [[c[at[s] : at[s + 1]] for c in p] for p, at in zip(sent, places, strict=True)]
                cuts = np.cumsum([0, *(len(p[0]) for p in own)])
                arrays, more = merge(kind, [np.concatenate(c) for c in zip(*own, strict=True)])
                out += more
                for f, i, j in zip(found, cuts[:-1], cuts[1:], strict=True):
                    f.append([a[i:j] for a in arrays])
            replies = (brief(block, [np.concatenate(c) for c in zip(*f, strict=True)]) for block, f in zip(askers, found, strict=True))
            out += [(block, bucket, kind, pack_arrays(*arrays)) for block, arrays in zip(askers, replies, strict=True)]
        return reply_table(out)

    return blobs.repartition(n, "bucket").groupBy("bucket").applyInArrow(tidy(run), REPLY_SCHEMA)


def reply_arrays(table: pa.Table, kind: int) -> list[np.ndarray]:
    """The answers to one block of one kind, in the order of its sorted keys; [] where it asked nothing."""
    rows = sorted((b, d) for b, k, d in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind)
    return [np.concatenate(c) for c in zip(*(unpack_arrays(d) for _, d in rows), strict=True)]


def repeated(kind: int, columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple]]:
    """A merge: is the key (two lanes where there are three columns) met twice or more? The last column says how often a block has it."""
    keys, times = columns[0], columns[-1]
    _, inverse, _ = unique_keys(keys, columns[1] if len(columns) == 3 else None)
    total = np.bincount(inverse, weights=times) if len(keys) else np.empty(0)
    return [(total >= 2)[inverse].astype(np.uint8)], []


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a piece holds about ``limit`` bytes of the column (one row at least)."""
    give_back()
    for batch in batches:
        sizes = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(batch[column]).to_pylist()])
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
