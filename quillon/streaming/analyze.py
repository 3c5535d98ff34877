"""The same analysis over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.config import Settings
from quillon.operators import detectors
from quillon.plans.analyze import analyze, prepare


def sentence_findings(stream: DataFrame, settings: Settings) -> DataFrame:
    """Findings of the sentence-level kinds as a stream: a stateless map, append mode, no shuffle."""
    docs = prepare(stream, settings)
    return detectors.sentence_findings(docs, settings.taxonomy, "document_id", "text")


def run(stream: DataFrame, path: str, checkpoint: str, settings: Settings, once: bool = True) -> StreamingQuery:
    """Records of every micro-batch, each in a folder named by its number: a batch that runs again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        analyze(batch, settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
