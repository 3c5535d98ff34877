"""Links documents with similar sets of word n-grams through PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c
from quillon.llm.components import components

SLOTS = 3  # second-level partitions; a signature leaves one of them out
JOINT = 3  # weak signatures sent as one
DIGESTS, SIGNATURES = 0, 1  # kinds in the exchange


class Bands:
    """Size bands, and for each band the number of first-level partitions of the feature domain.

    Bands are chosen so that the sizes of a linked pair lie in one band or in neighbours; a set sends signatures tagged with
    its own band and the next. Sets of a tag differ in at most ``k`` features. With k//2 + 1 partitions one has at most one
    differing feature; ``spare`` more (one at least) make it spare + 1 of them. Of such a partition's slots two agree: a shared signature.
    """

    def __init__(self, percent: int, most: int):
        self.tops, top = [], 0
        while not self.tops or top < most or len(self.tops) < 2 or self.tops[-2] < most:
            top = (top + 1) * 100 // percent
            self.tops.append(top)
        self.tops = np.array(self.tops, np.int64)
        self.k = 2 * self.tops * (100 - percent) // (100 + percent)
        base = self.k // 2 + 1
        self.spare = (base + 13) // 8
        self.parts = np.where(self.k > 0, base + self.spare, 0)  # nothing differs: the digest finds the equal sets

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, size)


def _joint(owner: np.ndarray, number: np.ndarray, key: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of t weak signatures of different partitions of one class, taken together; number: the partition."""
    size = np.minimum(spare + 1, JOINT)
    classes = spare // (size - 1)
    order = np.lexsort((number, number % classes[owner], owner))
    owner, number, key = owner[order], number[order], c.mix(key[order])
    group = np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] % classes[owner[1:]] != number[:-1] % classes[owner[:-1]])]) if len(owner) else np.empty(0, bool)
    cuts = np.flatnonzero(group)
    length, t = np.diff(np.append(cuts, len(owner))) if len(cuts) else cuts, size[owner[cuts]]
    docs, keys = [owner[:0]], [key[:0]]
    for n, k in np.unique(np.stack([length, t], 1)[length >= t], axis=0).tolist():  # all classes of one size at once
        at = cuts[(length == n) & (t == k)]
        pick = (at[:, None, None] + np.array(list(combinations(range(n), k)), np.int64)).reshape(-1, k)
        pick = pick[(np.diff(number[pick], axis=1) > 0).all(1)]
        docs.append(owner[pick[:, 0]])
        keys.append(c.mix(key[pick].sum(1) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(keys)


def signatures(doc: np.ndarray, item: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """(document, key, step) for the sets given as (doc, item) pairs, doc numbered from 0; size: the number of items by doc.

    Steps 0 and 1: tags of the set's own band and of the next. A signature of fewer than two items is weak: many unrelated sets share
    it, so weak ones are never sent alone. A pair agrees in spare + 1 partitions; if all the signatures it shares are weak, both have weak
    ones in more than ``spare`` partitions, and with partitions dealt to spare // (t - 1) classes, t of the shared ones are in one
    class: sets with so many weak partitions send every t weak signatures of one class as one, t being up to JOINT.

    The last result has each document's sketch for either step: a byte of each slot's content. The slots in which two sets of a tag
    differ are no more than the items in which they do, so sketches that differ in over ``k`` bytes are of sets that aren't linked.
    """
    bands = Bands(percent, int(size.max(initial=1)))
    docs, keys, steps, sketches = [], [], [], []
    for step in (0, 1):
        tag = bands.of(size) + step
        parts = bands.parts[tag]
        offset = np.cumsum(parts * SLOTS) - parts * SLOTS
        slot = (c.mix(item ^ (tag.astype(np.uint64) * np.uint64(c.BASES[1]))[doc]) >> np.uint64(32)) * (parts * SLOTS).astype(np.uint64)[doc] >> np.uint64(32)
        live = parts[doc] > 0
        at = offset[doc[live]] + slot[live].astype(np.int64)
        total = int((parts * SLOTS).sum())
        sums, counts = np.zeros(total, np.uint64), np.bincount(at, minlength=total)
        np.add.at(sums, at, c.mix(item[live] + np.uint64(1)))
        flat = (sums >> np.uint64(56)).astype(np.uint8).tobytes()
        sketches.append([flat[i:j] for i, j in zip(offset.tolist(), (offset + parts * SLOTS).tolist(), strict=True)])
        sums, counts = sums.reshape(-1, SLOTS), counts.reshape(-1, SLOTS)
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        few = counts.sum(1, keepdims=True) - counts < 2
        rest = sums.sum(1, keepdims=True) - sums  # the sum of the two slots that stay
        place = ((tag[owner] * 1_000_003 + number) * SLOTS)[:, None] + np.arange(SLOTS)
        key = c.mix(rest ^ c.mix(place.astype(np.uint64) + np.uint64(c.BASES[0])))
        many = np.bincount(owner, few.any(1), len(size)) > bands.spare[tag]
        weak = few & many[owner][:, None]
        sets, joint = _joint(np.repeat(owner, SLOTS).reshape(-1, SLOTS)[weak], np.repeat(number, SLOTS).reshape(-1, SLOTS)[weak], key[weak], bands.spare[tag])
        docs += [np.repeat(owner, SLOTS).reshape(-1, SLOTS)[~few], sets]
        keys += [key[~few], joint]
        steps.append(np.full(len(keys[-1]) + len(keys[-2]), step, bool))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(steps), sketches


class _Block:
    """A block's shingle sets as (document, shingle) pairs in order, with two lanes of a digest of each set."""

    def __init__(self, table: pa.Table, width: int):
        self.docs = c.unpack(table)
        words = c.Words(self.docs["text"].to_pylist(), lower=True)
        grams = c.mix(c.window_hash(words.hashes, width)) if len(words.hashes) >= width else np.empty(0, np.uint64)
        count = np.where(words.sizes < width, np.minimum(words.sizes, 1), words.sizes - width + 1)  # all the words of a shorter text are one shingle
        ends = np.cumsum(count)
        doc = np.repeat(np.arange(len(count)), count)
        full = words.left() >= width
        item = np.empty(len(doc), np.uint64)
        item[np.repeat(words.sizes >= width, count)] = grams[np.flatnonzero(full)]
        for n in range(1, width):
            short = np.flatnonzero(words.sizes == n)
            if len(short):
                item[ends[short] - 1] = c.mix(c.window_hash(words.hashes, n)[words.starts[short]] + c.mix(np.full(1, n, np.uint64)))
        for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
            item[a:b].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        self.doc, self.item = doc[new], item[new]
        self.size = np.bincount(self.doc, minlength=len(words.sizes))
        self.ends = np.cumsum(self.size)
        self.digests = []
        for base in c.BASES:
            sums = np.cumsum(np.concatenate([[np.uint64(0)], c.mix(self.item * np.uint64(base))]), dtype=np.uint64)
            self.digests.append(c.mix(sums[self.ends] - sums[self.ends - self.size] + self.size.astype(np.uint64)))
        self.full = np.flatnonzero(self.size)

    def distinct(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The first document of each distinct set, in the order of the digests, which follow."""
        k1, k2 = (x[self.full] for x in self.digests)
        first, _, _ = c.unique_keys(k1, k2)
        return self.full[first], (k1[first], k2[first])

    def owned(self, replies: pa.Table, percent: int) -> tuple:
        """The documents that stand for their set in the whole corpus, and signatures() of these, numbered."""
        first, _ = self.distinct()
        bits = c.reply_arrays(replies, DIGESTS)
        docs = np.sort(first[bits[0] > 0]) if bits else first[:0]
        number = np.full(len(self.size), -1)
        number[docs] = np.arange(len(docs))
        mine = number[self.doc] >= 0
        return docs, *signatures(number[self.doc[mine]], self.item[mine], self.size[docs], percent)


def _owner(kind: int, columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple]]:
    first, _, _ = c.unique_keys(columns[0], columns[1])
    bits = np.zeros(len(columns[0]), np.uint8)
    bits[first] = 1
    return [bits], []


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text; the same for rows that repeat both."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("binary"))


def sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """node, id, n, d1, d2 (digest) of every row; for the first of each distinct set also the signatures it shares, sketches and items."""
    n = c.block_count(docs, text_col)
    buckets = c.bucket_count(n)
    row = F.struct(F.col(id_col), F.xxhash64(F.col(text_col)))
    dealt = c.pack(docs, c.block_of(row, n), n, id=F.col(id_col), text=F.col(text_col).cast("binary"), key=row_key(id_col, text_col)).groupBy("block")

    def send_digests(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        _, (k1, k2) = _Block(table, width).distinct()
        c.to_buckets(rows, buckets, table["block"][0].as_py(), DIGESTS, k1, k2)
        return c.blob_table(rows)

    def send_signatures(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            keys = _Block(table, width).owned(replies, percent)[2]
            first, _, times = c.unique_keys(keys)
            c.to_buckets(rows, buckets, table["block"][0].as_py(), SIGNATURES, keys[first], np.minimum(times, 2).astype(np.uint8))
        return c.blob_table(rows)

    def describe(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = _Block(table, width)
        docs, number, keys, steps, sketches = own.owned(replies, percent)
        count = len(own.size)
        shared: list[list] = [[None] * count, [None] * count]
        bodies: list[list] = [[None] * count for _ in range(3)]
        rep = np.zeros(count, bool)
        rep[docs] = True
        if len(keys):
            _, inverse, _ = c.unique_keys(keys)
            met = c.reply_arrays(replies, SIGNATURES)[0][inverse] > 0
            number, keys, steps = number[met], keys[met], steps[met]
            order = np.argsort(number, kind="stable")
            cuts = np.searchsorted(number[order], np.arange(len(docs) + 1))
            listed, steps = keys[order].view(np.int64), steps[order]
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                d, part = int(docs[i]), slice(cuts[i], cuts[i + 1])
                shared[0][d], shared[1][d] = listed[part], steps[part]
                bodies[0][d], bodies[1][d] = sketches[0][i], sketches[1][i]
                bodies[2][d] = c.pack_arrays(np.diff(own.item[own.ends[d] - own.size[d] : own.ends[d]], prepend=np.uint64(0)))
        node = (np.int64(table["block"][0].as_py()) << 32) + np.arange(count)
        arrays = [pa.array(node), own.docs["id"], own.docs["key"], pa.array(own.size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in own.digests), pa.array(rep), pa.array(shared[0], pa.list_(pa.int64())), pa.array(shared[1], pa.list_(pa.bool_())), *(pa.array(x, pa.binary()) for x in bodies)]
        return pa.table(arrays, ["node", "id", "key", "n", "d1", "d2", "rep", "shared", "next", "own_sketch", "next_sketch", "body"])

    owners = c.answers(dealt.applyInArrow(c.tidy(send_digests), c.BLOB_SCHEMA), n, _owner)
    met = c.answers(dealt.cogroup(owners.groupBy("block")).applyInArrow(c.tidy(send_signatures), c.BLOB_SCHEMA), n, c.repeated)
    schema = f"node long, id {dict(docs.dtypes)[id_col]}, key long, n long, d1 long, d2 long, rep boolean, shared array<long>, next array<boolean>, own_sketch binary, next_sketch binary, body binary"
    return dealt.cogroup(owners.unionByName(met).groupBy("block")).applyInArrow(c.tidy(describe), schema)


FEW = 1_000_000  # so many ids, 8 MB, are broadcast at most


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (node, other, next, other_next) of one tag, those (a, b) whose sketches don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, step = batch["n"].to_numpy(), batch["next"].to_numpy(zero_copy_only=False)
            bands = Bands(percent, int(n.max(initial=1)))
            k = bands.k[bands.of(n) + step].tolist() if len(n) else []
            close = [np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)) <= m for x, y, m in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), k, strict=True)]
            yield batch.filter(pa.array(close, pa.bool_())).select(["a", "b"])

    x = sketches.select("node", "n", F.col("own_sketch").alias("own_x"), F.col("next_sketch").alias("next_x"))
    y = sketches.select(F.col("node").alias("other"), F.col("own_sketch").alias("own_y"), F.col("next_sketch").alias("next_y"))
    rows = pairs.join(x, "node").join(y, "other").select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "n", "next",
        F.when(F.col("next"), F.col("next_x")).otherwise(F.col("own_x")).alias("x"), F.when(F.col("other_next"), F.col("next_y")).otherwise(F.col("own_y")).alias("y"),
    )
    return rows.mapInArrow(c.tidy(run), "a long, b long").distinct()


def _named(bodies: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bodies of these nodes: few are broadcast, so that the others' bodies stay where they are."""
    nodes = c.saved(nodes.distinct(), "named")
    return bodies.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi")


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared item by item."""
    bodies = _named(bodies, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["body_a"].to_pylist(), batch["body_b"].to_pylist(), strict=True):
                x, y = (np.cumsum(c.unpack_arrays(v)[0], dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(linked)).select(["a", "b"])

    a, b = (bodies.select(F.col("node").alias(x), F.col("body").alias(f"body_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    fit = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return pairs.join(a, "a").join(b, "b").where(fit).select("a", "b", "body_a", "body_b").mapInArrow(c.tidy(run), "a long, b long")


BLOB = 256  # sets that stand together in one row
SKETCHES = 1024  # sketches that do


class _Forest:
    """Which of the edges offered connect what earlier ones haven't."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, k: int) -> int:
        parent = self.parent
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    def adds(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class _Sketched:
    """The rows (node, root, n, next, sketch) of a list column, and where each list begins."""

    def __init__(self, lists: pa.ListArray):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.cuts = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
        self.node, self.root, self.n, self.next, sketch = (x.to_numpy(zero_copy_only=False) if i < 4 else x for i, x in enumerate(lists.flatten().flatten()))
        _, places, data = sketch.buffers()
        self.places = np.frombuffer(places, np.int32)[sketch.offset : sketch.offset + len(sketch) + 1] if len(sketch) else np.zeros(1, np.int32)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)

    def rows(self, i: int) -> tuple[slice, np.ndarray]:
        a, b = self.cuts[i], self.cuts[i + 1]
        return slice(a, b), self.data[self.places[a] : self.places[b]].reshape(b - a, -1)


def _near(lists: pa.ListArray, others: pa.ListArray, percent: int) -> list[tuple[int, int]]:
    """For each list, a spanning forest of the pairs within it (or with the other list, where there is one) of different components
    whose sketches don't rule a link out. All of a list have one tag."""
    left, right = _Sketched(lists), _Sketched(others)
    bands = Bands(percent, int(max(left.n.max(initial=1), right.n.max(initial=1))))
    k = bands.k[bands.of(left.n) + left.next] if len(left.n) else left.n
    out = []
    for i in range(len(lists)):
        at, x = left.rows(i)
        to, y = right.rows(i) if right.cuts[i] < right.cuts[i + 1] else (at, x)
        own = right if y is not x else left
        nodes, roots, forest, most = own.node[to], own.root[to], _Forest(), (at.stop - at.start) + (to.stop - to.start) * (y is not x) - 1
        step, done = max(1, (1 << 22) // max(1, y.size)), 0
        for p in range(0, len(x), step):
            different = np.count_nonzero(x[p : p + step, None] != y[None], axis=2)
            close = (different <= k[at][p : p + step, None]) & (left.root[at][p : p + step, None] != roots[None])
            for r, j in zip(*(v.tolist() for v in np.nonzero(close)), strict=True):
                a, b = int(left.node[at][p + r]), int(nodes[j])
                if forest.adds(a, b):
                    out.append((a, b))
                    done += 1
                    if done == most:  # all are connected
                        break
            if done == most:
                break
    return out


def _candidates(open_groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all members of the groups that share a signature, are in different components, and may be linked.

    A group's sketches stand in blobs of about a thousand, compared with each other and with the group's other blobs. What
    leaves a comparison is a spanning forest of the pairs that stay possible, so a large group of near copies gives no pair per row.
    """
    rows = open_groups.join(sketches, "node").select("sig", "node", "root", "n", "next", F.when(F.col("next"), F.col("next_sketch")).otherwise(F.col("own_sketch")).alias("sketch"))
    parts = open_groups.groupBy("sig").agg(F.ceil(F.count("*") / SKETCHES).alias("parts"))
    rows = rows.join(parts, "sig").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    blobs = c.saved(rows.groupBy("sig", "part", "parts").agg(F.collect_list(F.struct("node", "root", "n", "next", "sketch")).alias("x")), "sketches")
    large = blobs.where("parts > 1")
    pairs = large.select("sig", "part", "x").join(large.select("sig", F.col("part").alias("to")), "sig").where("part < to")
    pairs = pairs.join(large.select("sig", F.col("part").alias("to"), F.col("x").alias("y")), ["sig", "to"]).select("x", "y")
    every = blobs.where("parts > 1 or size(x) > 1").select("x", F.lit(None).cast(blobs.schema["x"].dataType).alias("y")).unionByName(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _near(batch["x"], batch["y"], percent)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return every.mapInArrow(c.tidy(run), "a long, b long").distinct()


def _rest(edges: DataFrame, roots: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), enough to connect what is linked, among the sets that candidate edges connect.

    Sets that edges connect are one crowd. A crowd's largest component needs no comparison inside; every other member is compared
    with all of the crowd, in blobs of about 256 sets, each against each in one row: no pair of members becomes a row, and the
    work of a large crowd spreads over its blobs.
    """
    edges = c.saved(edges, "near")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    crowds = components(nodes.select("node", F.col("node").alias("root")), edges)
    rows = c.saved(crowds.withColumnRenamed("root", "crowd").join(roots, "node"), "crowds")
    bodies = _named(bodies, rows.select("node"))
    size = rows.groupBy("crowd", "root").agg(F.count("*").alias("n"))
    main = size.groupBy("crowd").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rows = rows.join(main, "crowd").withColumn("is_main", F.col("root") == F.col("main")).drop("main")
    parts = rows.groupBy("crowd", "is_main").agg(F.ceil(F.count("*") / BLOB).alias("parts"))
    rows = rows.join(parts, ["crowd", "is_main"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts").join(bodies, "node")
    blobs = c.saved(rows.groupBy("crowd", "is_main", "part").agg(F.collect_list(F.struct("node", "root", "n", "body")).alias("sets")), "blobs")
    right = blobs.select("crowd", F.col("is_main").alias("to_main"), F.col("part").alias("to"), F.col("sets").alias("y"))
    left = blobs.where("not is_main").select("crowd", "part", F.col("sets").alias("x"))
    left = left.join(right.drop("y"), "crowd").where("to_main or part <= to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _links(batch["x"][k].as_py(), batch["y"][k].as_py(), percent)

    return left.join(right, ["crowd", "to_main", "to"]).select("x", "y").mapInArrow(c.tidy(run), "a long, b long")


def _items(sets: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    own = [np.cumsum(c.unpack_arrays(r["body"])[0], dtype=np.uint64) for r in sets]
    return np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])


def _links(x: list[dict], y: list[dict], percent: int) -> pa.RecordBatch:
    """A spanning forest of the links between two blobs, roots that are known to be one taken together."""
    (item_x, own_x), (item_y, own_y) = _items(x), _items(y)
    shared = np.intersect1d(item_x, item_y)
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        grids = []
        for item, own, count in ((item_x, own_x, len(x)), (item_y, own_y, len(y))):
            place = np.minimum(np.searchsorted(part, item), len(part) - 1)
            hit = part[place] == item
            grid = np.zeros((count, len(part)), np.float32)
            grid[own[hit], place[hit]] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    total = np.array([r["n"] for r in x])[:, None] + np.array([r["n"] for r in y])[None, :]
    i, j = np.nonzero(100 * both >= percent * (total - both))
    forest = _Forest()
    out = [(x[p]["node"], y[q]["node"]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.adds(x[p]["root"], y[q]["root"])]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, rounds: int = 2) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id of all rows linked to it, directly or through others),
    row_key (of id and text) and kept: true for one row of each component, one with the smallest id.

    A document's set: the distinct runs of ``width`` words (split at ASCII white space, A-Z lowered); all its words where it has
    fewer; empty without words, and then linked with nothing. Two rows are linked when their sets' Jaccard similarity is at least
    ``percent`` %. Null ids take part and count as no id; repeated rows and ids are rows of their own. Exact: PartEnum loses
    no pair, and candidates are compared by their full sets.

    Rows with equal sets are one node. Nodes that share a signature are candidates, but not all pairs of a group are formed:
    in each round every node is compared with one other of its groups that isn't in its component yet, and groups
    whose members are all in one component need nothing more. The members of the rest are then compared blob against blob.
    """
    base = c.saved(sets(docs, id_col, text_col, width, percent), "sets")
    reps = base.where("rep and shared is not null")
    bodies = reps.select("node", "n", "body")
    sketches = reps.select("node", "n", "own_sketch", "next_sketch")
    member = c.saved(reps.select("node", F.explode(F.arrays_zip("shared", "next")).alias("x")).select("node", F.col("x.shared").alias("sig"), F.col("x.next").alias("next")), "members")
    roots = c.saved(reps.select("node", F.col("node").alias("root")), "roots")
    for turn in range(rounds + 1):
        open_groups = member.join(roots, "node")
        split = open_groups.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
        open_groups = c.saved(open_groups.join(split, "sig"), "open")
        if open_groups.isEmpty():
            break
        if turn == rounds:
            roots = components(roots, _rest(_candidates(open_groups, sketches, percent), roots, bodies, percent))
            break
        lead = open_groups.groupBy("sig").agg(F.min(F.struct(F.xxhash64("root", F.lit(turn)), F.xxhash64("node", F.lit(turn)), "node", "root", "next")).alias("lead"))
        pairs = open_groups.join(lead.select("sig", F.col("lead.node").alias("other"), F.col("lead.root").alias("other_root"), F.col("lead.next").alias("other_next")), "sig")
        pairs = pairs.where("root <> other_root").groupBy("node", "other").agg(F.count("*").alias("times"), F.min(F.struct("next", "other_next")).alias("steps"))
        pairs = pairs.groupBy("node").agg(F.max_by(F.struct("other", "steps"), F.struct("times", "other")).alias("best"))
        pairs = c.saved(_possible(pairs.select("node", "best.other", "best.steps.*"), sketches, percent), "pairs")
        before, roots = roots, components(roots, _verified(pairs, bodies, percent))
        c.discard(before, open_groups, pairs)

    rank = F.struct(F.col("id").isNull().alias("last"), "id", F.col("node").alias("at"))
    by_set = base.where("n > 0").groupBy("d1", "d2").agg(F.min(rank).alias("least"), F.max(F.when(F.col("rep"), F.col("node"))).alias("node"))
    by_set = by_set.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = by_set.groupBy("root").agg(F.min("least").alias("least"))
    by_set = by_set.drop("least").join(smallest, "root").select("d1", "d2", F.col("least.id").alias("component_id"), F.col("least.at").alias("at"))
    out = base.select("node", "id", "key", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("key").alias("row_key"), (alone | (F.col("node") == F.col("at"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component of similar(). Of rows that repeat id and text one stays."""
    found = similar(docs, id_col, text_col, width, percent)
    kept = found.where("kept").select(F.col("row_key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key(id_col, text_col)).join(kept, "__key").dropDuplicates(["__key"]).drop("__key")
