"""A run in steps: staged, checked, archived by date, and committed by one last file. What readers see changes at that file only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.analyze import batch_summary


class CheckFailed(Exception):
    """The staged run doesn't count; what was published before stays."""


def checks(done: DataFrame, failed: DataFrame) -> dict:
    """Counts of a run; CheckFailed where nothing was processed, more failed than were processed, or a record lacks its id."""
    row = batch_summary(done, failed).first()
    if row.gate != "OK":
        raise CheckFailed(f"{row.gate}: {row.processed} processed, {row.failed} failed")
    if not done.where("document_id is null").isEmpty():
        raise CheckFailed("a record without an id")
    return {"processed": row.processed, "failed": row.failed}


class Publisher:
    """Runs under a folder that driver and executors share.

    ``staging/<run>`` is written and checked, then renamed to ``archive/<day>/<run>``; ``runs/<run>.json``, the manifest, comes last and is
    the commit: a run without one doesn't exist for readers. A run that broke off is taken up where it stopped by publishing it again:
    a half-written stage is written anew, an archived one is only committed, a committed one is left alone.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _rename(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"can't rename {source} to {target}")

    def stage(self, run: str, done: DataFrame, failed: DataFrame) -> None:
        """Records and failures of the run; what an earlier attempt left there is replaced."""
        done.write.mode("overwrite").parquet(f"{self.folder}/staging/{run}/records")
        failed.write.mode("overwrite").parquet(f"{self.folder}/staging/{run}/failures")

    def check(self, run: str, check: Callable[[DataFrame, DataFrame], dict] = checks) -> dict:
        """What ``check`` counts on the staged files as they were written."""
        read = self.spark.read
        return check(read.parquet(f"{self.folder}/staging/{run}/records"), read.parquet(f"{self.folder}/staging/{run}/failures"))

    def archive(self, run: str, day: str, counts: dict) -> None:
        """The checked stage under its day, with its counts beside it."""
        self._write(f"{self.folder}/staging/{run}/counts.json", counts)
        self._rename(f"{self.folder}/staging/{run}", f"{self.folder}/archive/{day}/{run}")

    def commit(self, run: str, day: str) -> dict:
        """The manifest, written aside and renamed into place."""
        where = f"{self.folder}/archive/{day}/{run}"
        counts = json.loads(self._read(f"{where}/counts.json"))
        summary = self._fs.getContentSummary(self._path(where))
        manifest = {"run": run, "day": day, "path": f"archive/{day}/{run}", "files": summary.getFileCount(), "bytes": summary.getLength(), **counts}
        self._write(f"{self.folder}/staging/{run}.json", manifest)
        self._rename(f"{self.folder}/staging/{run}.json", f"{self.folder}/runs/{run}.json")
        return manifest

    def publish(self, run: str, day: str, make: Callable[[], tuple[DataFrame, DataFrame]], check: Callable[[DataFrame, DataFrame], dict] = checks) -> dict:
        """The manifest of the run; ``make`` gives (records, failures) and is called only if nothing checked is there yet. One writer per run."""
        if not re.fullmatch(r"[\w.-]+", run) or not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
            raise ValueError(f"no run or day: {run!r}, {day!r}")
        if self._exists(f"{self.folder}/runs/{run}.json"):
            return json.loads(self._read(f"{self.folder}/runs/{run}.json"))
        if not self._exists(f"{self.folder}/archive/{day}/{run}"):
            self.stage(run, *make())
            self.archive(run, day, self.check(run, check))
        return self.commit(run, day)

    def manifests(self) -> DataFrame:
        """One row per committed run; the last is that of the greatest (day, run)."""
        schema = "run string, day string, path string, files long, bytes long, processed long, failed long"
        if not self._exists(f"{self.folder}/runs"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/runs")

    def current(self) -> DataFrame | None:
        """Records of the last committed run; None before the first."""
        last = self.manifests().orderBy(F.desc("day"), F.desc("run")).first()
        return None if last is None else self.spark.read.parquet(f"{self.folder}/{last.path}/records")

    def _write(self, path: str, value: dict) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()

    def _read(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()
