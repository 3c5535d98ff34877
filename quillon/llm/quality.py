"""Document quality: random Fourier features of document statistics, ridge regression from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c

SPACE, UPPER, LOWER, DIGIT, MARK, SYMBOL, OTHER = range(7)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = UPPER, LOWER, DIGIT, OTHER
_CLASS[list(b".,;:'\"-?!()")] = MARK

STATISTICS = ("log_bytes", "log_words", "word_length", "word_spread", "long_words", "upper", "letters", "digits", "spaces", "marks", "symbols", "other", "symbol_runs", "upper_words", "symbol_words", "line_words", "line_repeats", "word_variety", "top_word", "entropy")


def describe(text: bytes) -> list[float]:
    """The statistics of one whole text; zeros for an empty one. Shares are of its bytes, words or lines."""
    if not text.strip():
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    kind, n = _CLASS[raw], len(raw)
    share = np.bincount(kind, minlength=7) / n
    inner = kind != SPACE
    edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    size = last - first
    starts = first[size > 0]
    up = np.add.reduceat(kind == UPPER, starts) / size
    odd = np.add.reduceat((kind == SYMBOL) | (kind == DIGIT), starts) > 0
    runs = np.count_nonzero((kind[1:] == SYMBOL) & (kind[:-1] == SYMBOL)) / n
    _, times = np.unique(c._hashed(raw)[1], return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = np.bincount(raw, minlength=256)
    p = p[p > 0] / n
    words = len(size)
    return [
        np.log1p(n), np.log1p(words), size.mean(), size.std(), np.mean(size > 20), share[UPPER], share[UPPER] + share[LOWER] + share[OTHER], share[DIGIT], share[SPACE], share[MARK], share[SYMBOL], share[OTHER],
        runs, np.mean((up > 0.6) & (size > 1)), odd.mean(), np.log1p(words / len(lines)), 1 - len(set(lines)) / len(lines), np.log(len(times)) / max(np.log(words), 1.0), times.max() / words, -(p * np.log2(p)).sum(),
    ]


def statistics(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: the kept columns and x, the statistics of its whole text; null counts as empty. No shuffle."""
    c.small_batches(docs.sparkSession)
    rows = docs.select(*(v.alias(k) for k, v in (keep or {}).items()), F.col(text).cast("binary").alias("_body"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "_body", 4 << 20):
            x = pa.array([describe(t or b"") for t in batch["_body"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in batch.schema.names if k != "_body"), x], [*(k for k in batch.schema.names if k != "_body"), "x"])

    return rows.mapInArrow(c.tidy(run), ", ".join([*schema, "x array<double>"]))


@dataclass
class Model:
    """A fitted model; without labels of both kinds it gives every text the share of good ones."""

    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))
    features: int = 384
    width: float = 5.0
    seed: int = 7
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.w = rng.normal(size=(len(STATISTICS), self.features)) / self.width
        self.b = rng.uniform(0, 2 * np.pi, self.features)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel of the given width over standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.features), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _equations(rows: DataFrame, model: Model, slots: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (x, label): every partition sums its own rows, a few tasks sum the partitions, the driver the tasks."""
    size = model.features + 1
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                z, y = own.mapped(_matrix(piece["x"])), piece["label"].to_numpy(zero_copy_only=False)
                more = np.vstack([z.T @ z, y @ z])
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in sorted(table["data"].to_pylist()))
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "label").mapInArrow(c.tidy(part), "data binary").withColumn("slot", F.pmod(F.xxhash64("data"), F.lit(slots)))
    total = sum(np.frombuffer(r["data"], np.float64) for r in parts.groupBy("slot").applyInArrow(c.tidy(summed), "data binary").orderBy("data").toLocalIterator())
    total = np.asarray(total).reshape(size + 1, size)
    return total[:size], total[size]


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (middle, mean label, rows) in ascending order: (centre, value) of the pools, values ascending."""
    pools: list[list[float]] = []
    for a, b, m in zip(x, y, n, strict=True):
        pools.append([a * m, b * m, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    centre, value, size = np.array(pools).T
    return centre / size, value / size


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bins: int = 1024, ridge: float = 1e-4, features: int = 384, width: float = 5.0) -> Model:
    """A model of all labelled rows of stats (key, x): four fifths of the keys for the weights, the rest for the calibration.

    Keys with several labels take their mean, at least a half counts as good; null keys and labels are left out, and rows
    without a label. The driver gets sums over partitions and ``bins`` counts, however many rows have labels.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg((F.col(label) > 0).cast("double")) >= 0.5).cast("double").alias("label"))
    rows = stats.select(F.col(key).alias("_key"), "x").join(one, "_key").withColumn("fold", F.pmod(F.xxhash64("_key", F.lit("fold")), F.lit(5)) != 0)
    rows = c.saved(rows.select("x", "label", "fold"), "labelled")
    width_of = range(len(STATISTICS))
    sums = rows.agg(F.count("*").alias("n"), F.avg("label").alias("prior"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in width_of), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in width_of)).first()
    if not sums["n"] or sums["prior"] in (0.0, 1.0):
        return Model(prior=float(sums["prior"] if sums["n"] else 0.5))
    mean, spread = (np.array([sums[f"{k}{i}"] for i in width_of]) for k in "ms")
    model = Model(sums["prior"], mean, np.where(spread > 1e-9, spread, 1.0), features, width)
    left, right = _equations(rows.where("fold"), model)
    if not left.ndim or left[-1, -1] == 0:
        return model
    model.weights = np.linalg.solve(left + ridge * left[-1, -1] * np.eye(len(left)), right)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw(_matrix(batch["x"])) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype(np.int32)), pa.array(raw), batch["label"]], ["bin", "raw", "label"])

    held = rows.where("NOT fold").select("x", "label").mapInArrow(c.tidy(binned), "bin int, raw double, label double")
    found = held.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")).orderBy("bin").collect()  # a row per bin
    if found:
        model.steps = isotonic(*(np.array([r[k] for r in found], float) for k in ("raw", "label", "n")))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats without x, with score (0 to 1, higher: good likelier). No shuffle."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in stats.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(_matrix(batch["x"])) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(found, pa.float64())], [*(f.name for f in kept), "score"])

    return stats.mapInArrow(c.tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))
