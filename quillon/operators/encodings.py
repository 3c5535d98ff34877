"""The encoding of bytes without a mark, by how likely their pairs of bytes are in each encoding of each language."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "cp1252", "mac_roman", "cp850", "utf-16-le", "utf-16-be")
HEAD = 100_000  # bytes that decide
PAIRS = 1 << 17  # of bytes, those at odd places apart: two bytes a character differ in nothing else by their order
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _pairs(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int32)
    pairs = raw[:-1] << 8 | raw[1:]
    pairs[1::2] |= 1 << 16
    return pairs


def pair_counts(docs: DataFrame, body: str = "text", lang: str = "lang", encodings: tuple[str, ...] = ENCODINGS, languages: int = 32) -> DataFrame:
    """(encoding, lang, pair, n): how often a byte follows another in the texts, were they written in each encoding; 65,536 is added at odd places.

    All texts count, whole; no pair reaches over the end of a text. Characters that an encoding lacks are left out there. Languages
    after the ``languages`` most frequent (ties: alphabetical) count together as one, null; null texts count nothing. A task sums before it sends.
    """
    common = docs.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), lang).limit(languages)
    known = [r[0] for r in common.select(lang).collect()]  # ``languages`` strings at most
    rows = docs.select(F.when(F.col(lang).isin(known), F.col(lang).cast("string")).alias("lang"), F.col(body).alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str | None], np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for name in encodings:
                    pairs = _pairs(text.encode(name, "ignore"))
                    total = held.setdefault((name, language), np.zeros(PAIRS, np.int64))
                    if len(pairs) > PAIRS:
                        total += np.bincount(pairs, minlength=PAIRS)
                    else:
                        np.add.at(total, pairs, 1)
        for (name, language), total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["encoding", "lang", "pair", "n"])

    return rows.mapInArrow(count, "encoding string, lang string, pair int, n long").groupBy("encoding", "lang", "pair").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """A row of ``tables`` is the logarithm of P(byte | byte before, place even or odd) in one encoding of one language."""

    encodings: list[str]
    tables: np.ndarray

    def ranking(self, data: bytes) -> list[str]:
        """Encodings that can read the first HEAD bytes, likeliest first."""
        head = data[:HEAD]
        able = [e for e in dict.fromkeys(self.encodings) if self._reads(e, head)]
        if "utf-8" in able and b"\x00" not in head:  # text in other encodings is hardly ever valid here by chance
            return ["utf-8"] + [e for e in able if e != "utf-8"]
        pair, n = np.unique(_pairs(head), return_counts=True)
        scores = self.tables[:, pair] @ n
        best = {e: max(s for f, s in zip(self.encodings, scores, strict=True) if f == e) for e in able}
        return sorted(able, key=lambda e: (-best[e], e))

    @staticmethod
    def _reads(encoding: str, head: bytes) -> bool:
        try:
            codecs.getincrementaldecoder(encoding)().decode(head)  # a character may be cut at the end
        except UnicodeDecodeError:
            return False
        return True

    def decode(self, data: bytes) -> tuple[str, str | None]:
        """(text, encoding): by mark, else by the likeliest encoding that reads all bytes; none reads them: UTF-8 with replacements, null."""
        for mark, name in MARKS:
            if data.startswith(mark):
                return data[len(mark) :].decode(name, "replace"), name
        for name in self.ranking(data):
            try:
                return data.decode(name), name
            except UnicodeDecodeError:
                pass
        return data.decode("utf-8", "replace"), None


def fit(counts: DataFrame) -> Model:
    """From the rows of pair_counts, which may have been saved. The driver holds at most 131,072 numbers per encoding and language."""
    rows = counts.select("encoding", "lang", "pair", "n").toPandas()
    keys, tables = [], []
    for (encoding, language), part in sorted(rows.groupby(["encoding", "lang"], dropna=False), key=str):
        n = np.zeros((2, 256, 256))
        n.reshape(-1)[part["pair"].to_numpy()] = part["n"].to_numpy()
        if not encoding.startswith("utf-16"):
            n[:] = n.sum(0)
        keys.append((encoding, language))
        tables.append(np.log((n + 0.5) / (n.sum(2, keepdims=True) + 128)).reshape(-1).astype(np.float32))
    return Model([k[0] for k in keys], np.array(tables, np.float32).reshape(len(tables), PAIRS))


def decoded(df: DataFrame, content: Column, model: Model) -> Column:
    """A column (text, encoding) of bytes; null bytes give nulls. The model, some MB, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text string, encoding string")
    def run(data: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([(None, None) if d is None else own.decode(bytes(d)) for d in data], columns=["text", "encoding"])

    return run(content)


def trial(docs: DataFrame, model: Model, key: str = "doc_id", body: str = "text", encodings: tuple[str, ...] = ENCODINGS[:5]) -> DataFrame:
    """(key, written_in, expressible, read_as, same_text): every text written in every encoding and read back. Null texts have no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("_key"), F.col(body).alias("_text")).where("_text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            out = []
            for k, text in zip(b["_key"], b["_text"], strict=True):
                for name in encodings:
                    try:
                        data = text.encode(name)
                    except UnicodeEncodeError:
                        out.append((k, name, False, None, None))
                        continue
                    got, read_as = own.decode(data)
                    out.append((k, name, True, read_as, got == text))
            yield pd.DataFrame(out, columns=["_key", "written_in", "expressible", "read_as", "same_text"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"_key {kind}, written_in string, expressible boolean, read_as string, same_text boolean").withColumnRenamed("_key", key)
