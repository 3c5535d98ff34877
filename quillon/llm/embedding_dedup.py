"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c
from quillon.llm.components import components

BLOB = 512  # vectors that stand together in one row


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        for j in range(k):
            own = x[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


@dataclass
class Index:
    """A codebook for each half of the unit vectors; a cell of the grid is a pair of their entries."""

    books: tuple[np.ndarray, np.ndarray]
    probes: int = 1

    @property
    def side(self) -> int:
        return len(self.books[0])

    def _distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = unit.shape[1] // 2
        return tuple((b**2).sum(1) - 2 * part @ b.T for b, part in zip(self.books, (unit[:, :h], unit[:, h:]), strict=True))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self._distances(unit)
        return np.argmin(a, 1) * self.side + np.argmin(b, 1)

    def visit(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The nearest ``most`` cells of each vector, nearest first, by multi-sequence traversal of the two sorted lists."""
        a, b = self._distances(unit)
        order_a, order_b = np.argsort(a, 1), np.argsort(b, 1)
        a, b = np.take_along_axis(a, order_a, 1).tolist(), np.take_along_axis(b, order_b, 1).tolist()
        out, side = np.empty((len(unit), most), np.int64), self.side
        for r in range(len(unit)):
            x, y = a[r], b[r]
            heap, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
            for t in range(most):
                _, i, j = heapq.heappop(heap)
                out[r, t] = order_a[r, i] * side + order_b[r, j]
                for p in ((i + 1, j), (i, j + 1)):
                    if p[0] < side and p[1] < side and p not in seen:
                        seen.add(p)
                        heapq.heappush(heap, (x[p[0]] + y[p[1]], *p))
        return out


def _least_rank(ranks: np.ndarray, weights: np.ndarray, recall: float) -> int:
    """The least rank up to which ``recall`` of the weight lies."""
    order = np.argsort(ranks, kind="stable")
    done = np.cumsum(weights[order])
    return int(ranks[order][min(np.searchsorted(done, recall * done[-1] * (1 - 1e-12)), len(ranks) - 1)])


def train(sample: np.ndarray, rows: int, threshold: float, recall: float, queries: int = 2000, partners: int = 8) -> Index:
    """Codebooks from the distinct vectors of the sample of unit vectors; as many cells to visit as bring ``recall`` of its close pairs.

    Pairs of equal vectors always meet and don't count. Of up to ``queries`` vectors with close others, up to ``partners`` each are
    tried; the recall must hold with every pair, every vector and every group of close vectors weighing the same, so that no large group
    decides for the others. With fewer than 200 groups it must also hold for vectors turned by random angles up to the threshold: small
    groups seldom meet in a sample.
    """
    first = np.unique(sample.round(6), axis=0, return_index=True)[1]
    sample = sample[np.sort(first)]
    side = int(min(max(2, np.sqrt(rows / 64)), 1024, len(sample)))
    h = sample.shape[1] // 2
    own = Index((_kmeans(sample[:, :h], side), _kmeans(sample[:, h:], side)))
    rng, source, other, many = np.random.default_rng(1), [], [], []
    for at in range(0, len(sample), 500):
        cos = sample[at : at + 500] @ sample.T
        close = (cos >= threshold) & (cos < 1 - 1e-9)
        for i in np.flatnonzero(close.any(1)).tolist():
            found = np.flatnonzero(close[i])
            pick = rng.permutation(found)[:partners]
            source += [at + i] * len(pick)
            other += pick.tolist()
            many.append((len(found), len(pick)))
        if len(many) >= queries:
            break
    most, cells = side * side, own.cells(sample)

    def ranks(left: np.ndarray, right: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Which of the cells that left[query] visits is the one of its partner?"""
        out = np.empty(len(query), np.int64)
        seen = own.visit(left, min(most, 512))
        for i in range(0, len(query), 2000):
            found = seen[query[i : i + 2000]] == right[i : i + 2000, None]
            out[i : i + 2000] = np.where(found.any(1), found.argmax(1) + 1, most)
        return out

    needed, groups = [1], 0
    if many:
        chosen, query = np.unique(source, return_inverse=True)
        q = sample[chosen]
        near, group = q @ q.T >= threshold, np.full(len(q), -1)
        for i in range(len(q)):
            if group[i] < 0:
                group[near[i] & (group < 0)] = groups
                groups += 1
        all_of, tried = np.array(many, float).T
        by_vector = 1 / tried
        rank = ranks(q, cells[other], query)
        for w in (all_of * by_vector, by_vector, by_vector / np.bincount(group)[group]):
            needed.append(_least_rank(rank, w[query], recall))
    if groups < 200:
        u = sample[rng.integers(0, len(sample), 500)]
        turn = rng.normal(size=u.shape)
        turn -= (turn * u).sum(1, keepdims=True) * u
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        cos = rng.uniform(threshold, 1, (len(u), 1))
        rank = ranks(u, own.cells(cos * u + np.sqrt(1 - cos**2) * turn), np.arange(len(u)))
        needed.append(_least_rank(rank, np.ones(len(u)), recall))
    own.probes = int(min(most, max(needed)))
    return own


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Of vectors as their components' bytes, four or eight each."""
    data = b"".join(raw)
    return _scaled(np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(raw) else np.float64).reshape(-1, dim))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.98, sample_rows: int = 20_000
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id (smallest id reachable by links, itself included), kept (its own component's id).

    Two rows are linked when the cosine, in double precision, is at least ``threshold`` and one of them visits the other's cell. Links
    that are reported are all verified. Null and zero vectors, those with null or non-finite components and those without the most
    frequent dimension link with nothing. Repeated rows and ids are rows of their own; a null id counts as no id.

    Equal vectors are one vector with a count. The index is fitted on the first ``sample_rows`` of them by hash and holds all. Cells and
    their visitors meet in blobs of about 512 vectors, matrix against matrix, each blob of a cell by itself: links are counted there and
    a spanning forest of them goes on, never all pairs.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)
    values = F.transform(vector_col, lambda x: x.cast(kind) + F.lit(0).cast(kind))  # -0.0 becomes 0.0
    good = F.coalesce(~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(values, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), F.when(good, values).alias("v"))
    rows = c.saved(rows.withColumns({"dim": F.when(F.col("v").isNotNull(), F.size("v")), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    plain = [F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    sizes = rows.where("dim is not null").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return rows.select(plain)
    dim, total = sizes["dim"], sizes["n"]
    usable, others = rows.where(F.col("dim") == dim), rows.where(F.coalesce(F.col("dim") != dim, F.lit(True)))
    classes = usable.groupBy("v", "h1", "h2").agg(F.min("node").alias("node"), F.min("id").alias("least"), F.count("*").alias("n"))
    classes = c.saved(classes, "classes")
    different = classes.count()
    sample = classes.orderBy(F.xxhash64("least", "node")).limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    sample = _scaled(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    index = spark.sparkContext.broadcast(train(sample, different, threshold, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)
            unit = _scaled(x)
            visits = own.visit(unit, own.probes)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own.cells(unit)), pa.array(list(visits), pa.list_(pa.int64()))], ["node", "n", "v", "cell", "visits"])

    placed = c.saved(classes.select("node", "n", "v").mapInArrow(place, "node long, n long, v binary, cell long, visits array<long>"), "cells")
    bases = _blobs(placed, "visits").withColumnsRenamed({"rows": "base", "part": "to"})
    seekers = _blobs(placed.select("node", "n", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell")), "home")
    seekers = seekers.withColumnRenamed("rows", "seek").drop("part")
    # one row for each cell with more than one blob of its own, about a million at most: a cell is a pair out of two books of up to 1024
    more = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOB).alias("parts")).where("parts > 1"))
    seekers = seekers.join(more, "cell", "left").select("cell", "seek", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("to"))
    met = bases.join(seekers, ["cell", "to"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base, seek = (batch[x][k].as_py() for x in ("base", "seek"))
                yield _links(base, seek, dim, threshold)

    found = c.saved(met.select("base", "seek").mapInArrow(verify, "node long, links long, root long"), "links")
    c.discard(placed)
    counts = c.saved(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    edges = found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    roots = components(counts.select("node", F.col("node").alias("root")), edges)
    c.discard(found)
    linked = classes.select("node", "h1", "h2", "least", "n").join(counts, "node", "left").join(roots, "node", "left")
    linked = linked.select("h1", "h2", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    linked = c.saved(linked.where("n_links > 0"), "linked")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_classes"))
    linked = _attached(linked, of_root, ["root"], F.col("n_classes") / different).select("h1", "h2", "n", "n_links", "component_id")
    out = _attached(usable.select("id", "h1", "h2"), c.saved(linked, "answers"), ["h1", "h2"], F.col("n") / total)
    component = F.coalesce("component_id", "id")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return out.unionAll(others.select(plain))


def _blobs(df: DataFrame, *more: str) -> DataFrame:
    """The vectors of each cell in parts of about BLOB, a row each. Cells of one part aren't looked up; the table of the others is bounded like that of cells."""
    parts = df.groupBy("cell").agg(F.ceil(F.count("*") / BLOB).alias("parts")).where("parts > 1")
    dealt = df.join(F.broadcast(parts), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0).cast("long")))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "n", "v", *more)).alias("rows"))


def _attached(many: DataFrame, one: DataFrame, keys: list[str], share: Column) -> DataFrame:
    """``many`` left join ``one``, which has each key once. Keys with a 200th of many's rows or more, so 200 at most, are broadcast; no others are that hot."""
    heavy = F.broadcast(one.where(share >= 0.005).withColumn("_hot", F.lit(True)))
    hot = many.join(heavy, keys, "left")
    rest = hot.where("_hot is null").select(*many.columns).join(one.where(share < 0.005), keys, "left")
    columns = many.columns + [x for x in one.columns if x not in keys]
    return hot.where("_hot").select(columns).unionAll(rest.select(columns))


def _links(base: list[dict], seek: list[dict], dim: int, threshold: float) -> pa.RecordBatch:
    """Counts and a spanning forest of the links between one blob of a cell and one of its visitors; a vector counts as often as it occurs."""
    b_node, s_node, b_n, s_n = (np.array([r[k] for r in x], np.int64) for k in ("node", "n") for x in (base, seek))
    cos = _unit([r["v"] for r in seek], dim) @ _unit([r["v"] for r in base], dim).T
    i, j = np.nonzero(cos >= threshold)
    home = np.array([r["home"] for r in seek], np.int64)
    visits = np.array([r["visits"] for r in base], np.int64)
    both = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # does the base vector visit the seeker's cell too?
        part = slice(at, at + (1 << 16))
        both[part] = (visits[j[part]] == home[i[part]][:, None]).any(1)
    new = np.where(both, s_node[i] < b_node[j], s_node[i] != b_node[j])
    i, j = i[new], j[new]
    nodes, place = np.unique(np.concatenate([s_node[i], b_node[j]]), return_inverse=True)
    x, y = place[: len(i)], place[len(i) :]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, x, b_n[j])
    np.add.at(links, y, s_n[i])
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[label])], ["node", "links", "root"])
