"""Documents in clusters of like words, as a suggestion of categories: k-means with seeds drawn in parallel, all in whole numbers.

Vectors are rounded to 2**-20, so squared distances, their sums and the sums of vectors are exact: the clusters depend on the rows and the
seed, not on partitions or their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT = 1 << 20
DRAWS = 1 << 40  # parts of 1 in which a row's chance is told


def hashed(weighted: DataFrame, key: str = "document_id", dims: int = 128) -> DataFrame:
    """(key, v): the weights of a document's terms dealt to ``dims`` places with signs by a hash, of length UNIT, rounded.

    A document whose places cancel out has zeros only; one without terms has no row.
    """
    rows = weighted.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("h"), "term", "weight"))).alias("x"))
    return _hashed(rows, key, dims)


def hashed_lists(listed: DataFrame, key: str = "document_id", dims: int = 128) -> DataFrame:
    """The same from (key, terms) as of ``terms.listed``, without a shuffle."""
    return _hashed(listed.select(F.col(key).alias("_key"), _laid().alias("x")), key, dims)


def _laid() -> Column:
    return F.array_sort(F.transform("terms", lambda e: F.struct(F.xxhash64(e["term"]).alias("h"), e["term"].alias("term"), e["weight"].alias("weight"))))


def _places(h: pa.ListArray, w: pa.ListArray, dims: int) -> np.ndarray:
    out = np.zeros((len(h), dims))
    of, h = pc.list_parent_indices(h).to_numpy(), h.flatten().to_numpy().view(np.uint64)
    np.add.at(out, (of, (h >> np.uint64(1)) % np.uint64(dims)), np.where(h & np.uint64(1), 1.0, -1.0) * w.flatten().to_numpy())
    return np.rint(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300) * UNIT).astype(np.int32)


def _hashed(rows: DataFrame, key: str, dims: int) -> DataFrame:
    rows = rows.select("_key", F.transform("x", lambda e: e["h"]).alias("h"), F.transform("x", lambda e: e["weight"]).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _places(b["h"], b["w"], dims)
            yield pa.RecordBatch.from_arrays([b["_key"], pa.ListArray.from_arrays(np.arange(0, out.size + 1, dims, dtype=np.int32), out.reshape(-1))], ["_key", "v"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, v array<int>").withColumnRenamed("_key", key)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equally near ones, and the squared distance; whole numbers below 2**53, so exact."""
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def assigned(vectors: DataFrame, centres: np.ndarray, key: str = "document_id") -> DataFrame:
    """(key, cluster, distance): the square of the distance, in units of UNIT squared."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = nearest(_rows(b), shared.value)
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(at.astype(np.int32)), pa.array(d.astype(np.int64))], ["_key", "cluster", "distance"])

    rows = vectors.select(F.col(key).alias("_key"), "v")
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, cluster int, distance long").withColumnRenamed("_key", key)


def sums(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of vectors and number of rows of each cluster, and the sum of all squared distances; a task sends a row per cluster."""
    shared, (k, dims) = vectors.sparkSession.sparkContext.broadcast(centres), centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, cost = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for b in batches:
            x = _rows(b)
            at, d = nearest(x, shared.value)
            np.add.at(total, at, x.astype(np.int64))
            n += np.bincount(at, minlength=k)
            for i in np.unique(at):
                cost[i] += int(d[at == i].astype(np.int64).sum())
        flat = pa.ListArray.from_arrays(np.arange(0, total.size + 1, dims, dtype=np.int32), total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), flat, pa.array(n), pa.array([Decimal(c) for c in cost], pa.decimal128(28, 0))], ["cluster", "total", "n", "cost"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, total array<long>, n long, cost decimal(28,0)").where("n > 0")
    rows = parts.groupBy("cluster").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(dims))).alias("total"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in rows:
        total[r.cluster], n[r.cluster] = r.total, r.n
    return total, n, sum(int(r.cost) for r in rows)


def draw(seed: int, turn: int, keys: list) -> np.ndarray:
    """A number from 0 to DRAWS - 1 for each key, by hash."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{turn}:{k}".encode(), digest_size=5).digest()) for k in keys], np.int64)


def _drawn(vectors: DataFrame, centres: np.ndarray, cost: int, often: int, seed: int, turn: int, key: str) -> np.ndarray:
    """Rows drawn with a chance of often * distance / cost each, so about ``often``, in the order of their vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, d = nearest(_rows(b), shared.value)
            lot = draw(seed, turn, b["_key"].to_pylist())
            take = [int(u) * cost < often * int(x) * DRAWS for u, x in zip(lot, d, strict=True)]
            yield b.select(["v"]).filter(pa.array(take, pa.bool_()))

    got = vectors.select(F.col(key).alias("_key"), "v").mapInArrow(run, "v array<int>").distinct().collect()
    return np.array(sorted(r.v for r in got), np.float64).reshape(-1, centres.shape[1])


def reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 20) -> np.ndarray:
    """``k`` of the candidates, each drawn by weight and squared distance to those before, the best of ``tries``; all if there are no more."""
    rng, best = np.random.default_rng(seed), (np.inf, points)
    for _ in range(tries if len(points) > k else 0):
        chosen, p = [], weight
        while len(chosen) < k and p.sum():
            chosen.append(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right")))
            p = nearest(points, points[chosen])[1] * weight
        if p.sum() < best[0]:
            best = (p.sum(), points[chosen])
    return best[1]


@dataclass
class Clusters:
    centres: np.ndarray  # whole numbers
    costs: list[int]  # the sum of squared distances before each round, and at the end


def fit(vectors: DataFrame, k: int, key: str = "document_id", seed: int = 0, turns: int = 5, rounds: int = 20) -> Clusters | None:
    """At most ``k`` centres of the rows (key, v), ended by ``rounds`` or when nothing changes; None without rows.

    Five turns draw about 2k rows each by their squared distance, which the driver thins out to k by the rows near each; a round then takes
    one pass and sends one row per cluster and task. Save ``vectors`` first: each pass reads them. Rows with equal keys are drawn together.
    """
    first = vectors.orderBy(F.xxhash64(F.lit(seed), F.col(key)), "v").select("v").first()
    if first is None:
        return None
    centres = np.array([first.v], np.float64)
    for turn in range(turns):
        cost = sums(vectors, centres)[2]
        if not cost:
            break
        centres = np.unique(np.vstack([centres, _drawn(vectors, centres, cost, 2 * k, seed, turn, key)]), axis=0)
    centres = reduced(centres, sums(vectors, centres)[1].astype(np.float64), k, seed)
    costs = []
    for _ in range(rounds):
        total, n, cost = sums(vectors, centres)
        costs.append(cost)
        moved = np.where(n[:, None] > 0, np.rint(total / np.maximum(n, 1)[:, None]), centres)
        if (moved == centres).all():
            return Clusters(centres, costs)
        centres = moved
    return Clusters(centres, [*costs, sums(vectors, centres)[2]])


def suggestions(weighted: DataFrame, clusters: DataFrame, terms: int = 10, key: str = "document_id") -> DataFrame:
    """(cluster, rank from 1, term, documents, weight): a cluster's weightiest terms, as the words of a category; weights summed in millionths."""
    rows = weighted.join(clusters.select(key, "cluster"), key).groupBy("cluster", "term").agg(F.count("*").alias("documents"), F.sum(F.round(F.col("weight") * 1_000_000).cast("long")).alias("_w"))
    return _best(rows, terms)


def suggested(listed: DataFrame, centres: np.ndarray, terms: int = 10) -> DataFrame:
    """The same rows from (key, terms) as of ``terms.listed`` for the clusters of their own hashed places: a task finds the cluster of
    a document beside its terms and sends sums by cluster and term, so no row per document and term moves."""
    shared, dims = listed.sparkSession.sparkContext.broadcast(centres), centres.shape[1]
    part = lambda value: F.transform("x", value)
    rows = listed.select(_laid().alias("x")).select(
        part(lambda e: e["h"]).alias("h"), part(lambda e: e["weight"]).alias("w"), part(lambda e: e["term"]).alias("term"), part(lambda e: F.round(e["weight"] * 1_000_000).cast("long")).alias("u")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                at, _ = nearest(_places(b["h"], b["w"], dims).astype(np.float64), shared.value)
                own = pa.table({"cluster": at.astype(np.int32)[pc.list_parent_indices(b["term"]).to_numpy()], "term": b["term"].flatten(), "u": b["u"].flatten()})
                sums = own.group_by(["cluster", "term"]).aggregate([("u", "count"), ("u", "sum")])
                yield from sums.select(["cluster", "term", "u_count", "u_sum"]).rename_columns(["cluster", "term", "n", "u"]).to_batches()

    rows = rows.mapInArrow(run, "cluster int, term string, n long, u long").groupBy("cluster", "term").agg(F.sum("n").alias("documents"), F.sum("u").alias("_w"))
    return _best(rows, terms)


def _best(rows: DataFrame, terms: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("_w"), "term"))
    return rows.withColumn("rank", best).where(F.col("rank") <= terms).select("cluster", "rank", "term", "documents", (F.col("_w") / 1_000_000).alias("weight"))
