"""Exact nearest neighbours by cosine: blocks of vectors about pivots, left out where no vector in them can be near enough.

Every vector belongs to its nearest pivot; the vectors of a pivot, in the order of their angle to it, are cut into blocks of bounded
size, so a crowded pivot has many blocks. By the triangle inequality of angles no vector of a block is nearer to a query than the
query's angle to the pivot is from the block's range of angles. A query first meets the most promising block, whose k-th best is
a floor, and then only blocks that may hold something better. Matrices of a block and of a batch of queries meet by a join
on the block; each pair keeps its k best, and a ranking that Spark bounds before it shuffles merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.batches import small_batches

BLOCK, BATCH, SLACK = 1024, 256, 1e-7
HIT = "query long, id long, cosine double"


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors at length one): null, zero and non-finite vectors and such components aren't."""
    rows = [None if v is None or any(x is None for x in v) else np.asarray(v, np.float64) for v in column.to_pylist()]
    good = [i for i, v in enumerate(rows) if v is not None and len(v) and np.isfinite(v).all() and np.any(v)]
    if not good:
        return np.empty(0, np.int64), np.empty((0, 0))
    x = np.array([rows[i] / np.abs(rows[i]).max() for i in good])
    return np.array(good), x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _matrix(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def _cosines(x: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """With the pivots; with the diagonal where there are none."""
    return x @ (np.full((1, x.shape[1]), x.shape[1] ** -0.5) if pivots is None else pivots).T


def placed(base: DataFrame, id_col: str, vector: str, pivots: np.ndarray | None) -> DataFrame:
    """(id, cell, angle, unit) of the usable vectors: the nearest pivot and the angle to it."""
    shared = base.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, BLOCK)):  # a vector's components are Python objects for a while
            batch = whole.slice(at, BLOCK)
            good, x = _unit(batch["v"])
            if len(good):
                near = _cosines(x, shared.value)
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(good)), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array([_bytes(v) for v in x], pa.binary())], ["id", "cell", "angle", "unit"])

    return base.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL").mapInArrow(run, "id long, cell int, angle double, unit binary")


def blocks(rows: DataFrame) -> DataFrame:
    """(block, cell, n, low, high, ids, data): the vectors of a cell by angle, BLOCK a row at most. Dealt by range, so no cell is one task's."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(part: pa.Table) -> pa.RecordBatch:
            angles = part["angle"].to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([part["cell"][0].as_py()], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([angles.min()]), pa.array([angles.max()]), pa.array([part["id"].to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part["unit"].to_pylist())], pa.binary())],
                ["cell", "n", "low", "high", "ids", "data"],
            )

        def full(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            cells = table["cell"].to_numpy()
            ends = [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            at = 0
            for end in ends:
                while end - at > BLOCK or at < end and (end < len(cells) or last):
                    yield made(table.slice(at, min(BLOCK, end - at)))
                    at = min(at + BLOCK, end)
            yield table.slice(at)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            *done, held = full(table if held is None else pa.concat_tables([held, table]), False) if table.num_rows else [held]
            yield from done
        if held is not None and held.num_rows:
            *done, _ = full(held, True)
            yield from done

    dealt = rows.repartitionByRange(n, "cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
    made = dealt.mapInArrow(run, "cell int, n int, low double, high double, ids array<long>, data binary")
    return made.withColumn("block", F.monotonically_increasing_id())


def _scored(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # views of one row's buffers: a batch of matrices is never copied, nor its ids made into objects
            ids, asked = (batch[c][i].values.to_numpy() for c in ("ids", "asked"))
            q, x = (_matrix(batch[c][i].as_buffer(), len(of)) for c, of in (("queries", asked), ("data", ids)))
            cosine = q @ x.T
            if not same:
                cosine[asked[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :k]
            best = np.take_along_axis(cosine, order, 1)
            real = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, real.sum(1))), pa.array(ids[order][real]), pa.array(best[real])], ["query", "id", "cosine"])


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "embedding", pivots: int = 64, sample: int = 20_000, same: bool = False) -> tuple[DataFrame, DataFrame]:
    """((query, rank, id, cosine), (pairs, visited)): the k base vectors of largest cosine for each query, equal ones by id; how many
    of all (query, vector) pairs were computed.

    Vectors that are null, zero or hold null or non-finite components are neither found nor answered; a query isn't its own answer
    unless ``same``. Pivots come from a sample of ``sample`` rows by hash; they only decide what can be left out, never the result.
    The driver gets the sample, and a row of a few numbers per block, which goes to the tasks that ask.
    """
    spark = base.sparkSession
    small_batches(spark)  # a row of a pair holds two matrices
    fix = lambda df: df.checkpoint() if spark.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()
    picked = base.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector).toArrow()
    _, x = _unit(picked[vector].combine_chunks() if isinstance(picked[vector], pa.ChunkedArray) else picked[vector])
    chosen = [0] if len(x) else []
    far = x @ x[0] if len(x) else np.empty(0)
    while len(chosen) < min(pivots, len(x)):  # each pivot is the vector that is farthest from those before
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    centres = x[chosen] if chosen else None
    held = fix(blocks(placed(base, id_col, vector, centres)))
    asked = fix(placed(queries, id_col, vector, centres).select(F.col("id").alias("query"), "unit"))
    table = held.select("block", "cell", "low", "high", "n").orderBy("block").toArrow()
    shared = spark.sparkContext.broadcast((centres, *(table[c].to_numpy() for c in ("block", "cell", "low", "high"))))

    def aimed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, block, cell, low, high = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(at, BATCH)
                    q = _matrix(b"".join(batch["unit"].to_pylist()), batch.num_rows)
                    angle = np.arccos(np.clip(_cosines(q, centre), -1, 1))[:, cell]
                    reach = np.cos(np.clip(np.maximum(angle - high, low - angle), 0, np.pi))
                    if first:
                        wanted = np.zeros(reach.shape, bool)
                        wanted[np.arange(len(q)), reach.argmax(1)] = True
                    else:
                        floor = batch["floor"].to_numpy(zero_copy_only=False)
                        wanted = reach >= floor[:, None] - SLACK
                        wanted[np.arange(len(q)), reach.argmax(1)] = False
                    ids = batch["query"].to_numpy()
                    for b in np.flatnonzero(wanted.any(0)).tolist():
                        own = wanted[:, b]
                        yield pa.RecordBatch.from_arrays([pa.array([block[b]]), pa.array([ids[own].tolist()], pa.list_(pa.int64())), pa.array([_bytes(q[own])], pa.binary())], ["block", "asked", "queries"])

        return run

    def answers(sent: DataFrame) -> DataFrame:
        pairs = sent.join(held.select("block", "ids", "data"), "block")
        return pairs.mapInArrow(lambda batches: _scored(batches, k, same), HIT)

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    if not table.num_rows:
        none = spark.createDataFrame([], "query long, rank int, id long, cosine double")
        return none, spark.createDataFrame([(0, 0)], "pairs long, visited long")
    shape = "block long, asked array<long>, queries binary"
    early = fix(asked.withColumn("floor", F.lit(-2.0)).mapInArrow(aimed(True), shape))
    opened = fix(best(answers(early)))
    floors = opened.groupBy("query").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("floor"))
    late = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))).mapInArrow(aimed(False), shape)  # not kept: it is large, and made again in no time
    out = best(opened.drop("rank").unionByName(answers(late))).select("query", "rank", "id", "cosine")
    sizes = F.broadcast(held.select("block", "n"))  # a row per block
    visited = early.unionByName(late).join(sizes, "block").agg(F.coalesce(F.sum(F.size("asked") * F.col("n")), F.lit(0)).cast("long").alias("visited"))
    total = held.agg(F.sum("n").alias("n")).join(asked.agg(F.count("*").alias("q")), how="cross").select((F.col("n") * F.col("q")).cast("long").alias("pairs"))
    return out, total.join(visited, how="cross")  # rows with a row
