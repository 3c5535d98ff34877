"""Records to files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import file_digest
from quillon.operators.records import flat


def sorted_json(records: DataFrame, indent: int | None = None) -> DataFrame:
    """(document_id, value): each record as JSON with sorted keys, the same bytes in every run."""
    raw = records.select("document_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(value=[json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, indent=indent) for x in b["value"]])

    return raw.mapInPandas(run, "document_id string, value string")


def jsonl(records: DataFrame, path: str, append: bool = False) -> None:
    """Lines in the order of ids across the part files; replaces what was there unless append."""
    rows = sorted_json(records).orderBy("document_id").select("value")
    rows.write.mode("append" if append else "overwrite").text(path)


def json_files(records: DataFrame, path: str, append: bool = False) -> None:
    """A file per document, named by the first 16 digits of its id, with the indented record. Files of equal names are replaced, others stay,
    whatever append says; of records with equal ids one is written.

    Each task writes its files beside their places and moves them there when they are whole, so one that runs again leaves the same
    files. The path is one that pyarrow's file systems reach from all executors.
    """
    rows = sorted_json(records, 2).dropDuplicates(["document_id"]).select(file_digest(F.col("document_id")).alias("name"), "value")
    folder = path if "://" in path or path.startswith("file:") else str(Path(path).resolve())

    def write(part: Iterator) -> None:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        own = uuid.uuid4().hex
        for r in part:
            with system.open_output_stream(f"{base}/.{r.name}-{own}") as out:
                out.write(f"{r.value}\n".encode())
            system.move(f"{base}/.{r.name}-{own}", f"{base}/{r.name}.json")

    rows.foreachPartition(write)


def parquet(records: DataFrame, path: str, append: bool = False, compression: str = "snappy") -> None:
    """Thirteen flat columns, nested parts as JSON."""
    flat(records).write.mode("append" if append else "overwrite").option("compression", compression).parquet(path)


def failures(failed: DataFrame, path: str, append: bool = False) -> None:
    """The dead letters as lines of JSON: file, error_type, error."""
    failed.write.mode("append" if append else "overwrite").json(path)


SINKS: dict[str, Callable[..., None]] = {"jsonl": jsonl, "json": json_files, "parquet": parquet}


def sink(config: dict | None = None) -> Callable[..., None]:
    kind = (config or {}).get("format", "jsonl")
    if kind not in SINKS:
        raise ValueError(f"no sink {kind!r}; there are {', '.join(sorted(SINKS))}")
    return SINKS[kind]
