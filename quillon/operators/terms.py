"""Term weights: n-grams of a document's words by how often it has them and how few documents do.

``counts`` and ``weights`` are tables with a row per document and term, which a large corpus can't shuffle: they are many times its texts.
``listed`` and ``best`` shuffle texts instead, in blocks: a block asks once for each of its different terms, packed in the order of
the terms, and gets their numbers of documents back in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text

#: A term of more than one in so many of all (document, term) rows is frequent; there can be no more than so many of them.
FREQUENT = 2000
#: Bytes of text in a block, and blocks for each bucket of terms: what a task holds of either doesn't grow with the corpus.
BLOCK, SHARE = 4 << 20, 2


def grams(words: Column, size: int) -> Column:
    """The runs of ``size`` words, each joined by spaces."""
    if size == 1:
        return words
    tails = [F.slice(words, F.lit(i + 1), F.greatest(F.size(words) - (size - 1), F.lit(0))) for i in range(size)]
    return F.transform(F.arrays_zip(*(t.alias(f"w{i}") for i, t in enumerate(tails))), lambda x: F.concat_ws(" ", *(x[f"w{i}"] for i in range(size))))


def _words(body: str) -> Column:
    return F.transform(F.filter(text.tokens(F.col(body)), lambda t: ~text.is_punct(t)), lambda t: F.lower(t))


def counts(docs: DataFrame, key: str = "document_id", body: str = "text", sizes: Sequence[int] = (1,)) -> DataFrame:
    """(key, term, n): how often a document has a word or run of words, in lower case, punctuation left out, stop words kept."""
    laid = docs.select(key, _words(body).alias("_words"))
    return laid.select(key, F.explode(F.concat(*(grams(F.col("_words"), s) for s in sizes))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def weights(counted: DataFrame, documents: int, key: str = "document_id") -> DataFrame:
    """(key, term, n, df, weight): n * (ln((1 + documents) / (1 + df)) + 1), where df documents have the term.

    df are sums of partial counts. A term that very many documents have would meet all its rows in one task: the frequent terms,
    FREQUENT at most by their definition, are sent to the rows instead, and only the others are joined by a shuffle.
    """
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    least = counted.count() / FREQUENT
    often, rare = F.broadcast(df.where(F.col("df") > least)), df.where(F.col("df") <= least)
    marked = counted.join(often, "term", "left")
    found = marked.where("df IS NOT NULL").select(key, "term", "n", "df").unionByName(marked.where("df IS NULL").drop("df").join(rare, "term").select(key, "term", "n", "df"))
    return found.withColumn("weight", _weight(F.col("n"), F.col("df"), documents))


def top(weighted: DataFrame, k: int = 10, key: str = "document_id") -> DataFrame:
    """(key, rank from 1, term, n, df, weight) of a document's k weightiest terms, equal weights in the order of the terms."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return weighted.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "term", "n", "df", "weight")


def vectors(weighted: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, terms, weights): a sparse vector of length one per document, terms in order."""
    entries = weighted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return entries.select(key, F.transform("x", lambda e: e["term"]).alias("terms"), F.transform("x", lambda e: e["weight"] / F.col("norm")).alias("weights"))


class _Block:
    """The texts of a block: (document, term, n) in order of the documents, and all its terms in the order in which they are asked for."""

    def __init__(self, rows: pa.Table, sizes: Sequence[int], buckets: int):
        rows = rows.combine_chunks()
        self.keys = pc.unique(rows["_key"])  # texts with equal keys are one document
        lists = pc.split_pattern(rows["_words"], " ").combine_chunks()
        document = pc.index_in(rows["_key"], self.keys).to_numpy()
        row, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # what an empty text is split into
        row, words = row[real], words.filter(pa.array(real)).dictionary_encode()
        word, names, grams, docs, base = words.indices.to_numpy().astype(np.int64), [], [], [], 0
        for size in sizes:
            n = max(0, len(word) - size + 1)
            gram, own = word[:n], words.dictionary
            for i in range(1, size):  # ids of the runs so far, and the next word
                pairs, gram = np.unique(gram * max(1, len(words.dictionary)) + word[i : i + n], return_inverse=True)
                first, then = np.divmod(pairs, max(1, len(words.dictionary)))
                own = pc.binary_join_element_wise(own.take(pa.array(first)), words.dictionary.take(pa.array(then)), " ")
            whole = row[:n] == row[size - 1 : size - 1 + n]
            grams.append(gram[whole] + base)
            docs.append(document[row[:n][whole]])
            names.append(own)
            base += len(own)
        ids, self.count = np.unique(np.concatenate(docs) * max(1, base) + np.concatenate(grams), return_counts=True)
        self.document, gram = np.divmod(ids, max(1, base))
        have = np.bincount(gram, minlength=base)
        used = np.flatnonzero(have)  # without runs over the end of a text
        terms = pa.concat_arrays(names).take(pa.array(used))
        order = pc.sort_indices(terms).to_numpy().astype(np.int64)
        bucket = (pd.util.hash_array(terms.take(pa.array(order)).to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int32)
        asked = np.argsort(bucket, kind="stable")
        self.rank, order, bucket = asked, order[asked], bucket[asked]  # rank: the place of a term in the order of all
        at = np.empty(base, np.int64)
        at[used[order]] = np.arange(len(order))
        self.term, self.terms, self.have = at[gram], terms.take(pa.array(order)), have[used[order]].astype(np.int32)
        self.cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        self.buckets = bucket[self.cuts[:-1]]


def _packed(x: np.ndarray | pa.Buffer) -> bytes:
    return pa.compress(x if isinstance(x, pa.Buffer) else pa.py_buffer(np.ascontiguousarray(x)), "zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, 4 * n, "zstd"), np.int32)


def _by_block(docs: DataFrame, key: str, body: str, sizes: Sequence[int], chosen: Callable[[_Block, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, found): an array of (term, n, df) for each document that has terms. chosen: which of a block's (document, term) rows, in what order."""
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    buckets = max(1, blocks // SHARE)
    laid = docs.select(F.col(key).alias("_key"), F.concat_ws(" ", _words(body)).alias("_words"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"))
    kind = laid.schema["_key"].dataType.simpleString()

    def asked(rows: pa.Table) -> pa.Table:
        b = _Block(rows, sizes, buckets)
        at = np.frombuffer(b.terms.buffers()[1], np.int32, len(b.terms) + 1) if len(b.terms) else np.zeros(1, np.int32)
        parts = list(zip(b.cuts, b.cuts[1:], strict=False))
        return pa.table({
            "_block": pa.array([rows["_block"][0].as_py()] * len(parts), pa.int32()), "_bucket": pa.array(b.buckets if parts else [], pa.int32()), "_n": pa.array([y - x for x, y in parts], pa.int32()),
            "_size": pa.array([int(at[y] - at[x]) for x, y in parts], pa.int32()), "_terms": pa.array([_packed(b.terms.buffers()[2].slice(int(at[x]), int(at[y] - at[x]))) for x, y in parts], pa.binary()),
            "_lengths": pa.array([_packed(np.diff(at[x : y + 1])) for x, y in parts], pa.binary()), "_have": pa.array([_packed(b.have[x:y]) for x, y in parts], pa.binary()),
        })

    def answered(rows: pa.Table) -> pa.Table:
        n = rows["_n"].to_pylist()
        lengths = np.concatenate([_unpacked(x.as_py(), k) for x, k in zip(rows["_lengths"], n, strict=True)])
        data = b"".join(pa.decompress(x.as_py(), k, "zstd", asbytes=True) for x, k in zip(rows["_terms"], rows["_size"].to_pylist(), strict=True))
        have = np.concatenate([_unpacked(x.as_py(), k) for x, k in zip(rows["_have"], n, strict=True)])
        places = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        terms = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(places), pa.py_buffer(data))
        which = terms.dictionary_encode().indices.to_numpy()
        df = np.bincount(which, have)[which].astype(np.int32)
        ends = np.cumsum(n)
        return pa.table({"_block": rows["_block"], "_bucket": rows["_bucket"], "_df": pa.array([_packed(df[e - k : e]) for e, k in zip(ends.tolist(), n, strict=True)], pa.binary()), "_n": rows["_n"]})

    def told(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(rows, sizes, buckets)
        answers = answers.sort_by("_bucket")
        df = np.concatenate([np.zeros(0, np.int32), *(_unpacked(x.as_py(), k) for x, k in zip(answers["_df"], answers["_n"].to_pylist(), strict=True))])
        take = np.arange(len(b.term)) if chosen is None else chosen(b, df)
        document, term = b.document[take], b.term[take]
        starts = np.flatnonzero(np.diff(document, prepend=-1))
        entries = pa.StructArray.from_arrays([b.terms.take(pa.array(term)), pa.array(b.count[take]), pa.array(df[term].astype(np.int64))], ["term", "n", "df"])
        return pa.Table.from_arrays([b.keys.take(pa.array(document[starts])), pa.ListArray.from_arrays(np.append(starts, len(take)).astype(np.int32), entries)], ["_key", "_found"])

    sent = laid.groupBy("_block").applyInArrow(asked, "_block int, _bucket int, _n int, _size int, _terms binary, _lengths binary, _have binary")
    back = sent.groupBy("_bucket").applyInArrow(answered, "_block int, _bucket int, _df binary, _n int")
    return laid.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(told, f"_key {kind}, _found array<struct<term:string,n:bigint,df:bigint>>").withColumnRenamed("_key", key)


def _weight(n: Column, df: Column, documents: int) -> Column:
    return n * (F.log(F.lit(1.0 + documents) / (1 + df)) + 1)


def listed(docs: DataFrame, documents: int, key: str = "document_id", body: str = "text", sizes: Sequence[int] = (1,)) -> DataFrame:
    """(key, terms): the terms of each document as an array of (term, n, df, weight), as in ``weights``; a row per document that has terms."""
    rows = _by_block(docs, key, body, sizes)
    one = lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"), x["df"].alias("df"), _weight(x["n"], x["df"], documents).alias("weight"))
    return rows.select(key, F.transform("_found", one).alias("terms"))


def best(docs: DataFrame, documents: int, k: int = 10, key: str = "document_id", body: str = "text", sizes: Sequence[int] = (1,)) -> DataFrame:
    """The same rows as ``top`` of ``weights`` of ``counts``; only a document's k terms leave the task."""

    def chosen(b: _Block, df: np.ndarray) -> np.ndarray:
        kinds, kind = np.unique(df, return_inverse=True)  # one logarithm for equal df, so that equal weights are equal
        weight = b.count * (np.log((1.0 + documents) / (1 + kinds)) + 1)[kind][b.term]
        order = np.lexsort((b.rank[b.term], -weight, b.document))
        first = np.flatnonzero(np.diff(b.document[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return order[place < k]

    rows = _by_block(docs, key, body, sizes, chosen).select(key, F.posexplode("_found").alias("_at", "x"))
    return rows.select(key, (F.col("_at") + 1).alias("rank"), "x.term", "x.n", "x.df", _weight(F.col("x.n"), F.col("x.df"), documents).alias("weight"))
