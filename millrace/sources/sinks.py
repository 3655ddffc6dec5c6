"""Sinks of run outputs ``(run_id, status, output, error)``: at least once, told apart by run id when read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT = "run_id STRING, status STRING, output STRING, error STRING"


class OutputSink:
    """``write`` may see a row again after a crash; ``flush`` returns when all that was written is kept."""

    def write(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        pass


class DiscardSink(OutputSink):
    def write(self, rows: DataFrame) -> None:
        rows.write.format("noop").mode("overwrite").save()


class JsonlSink(OutputSink):
    """One JSON object for each row, NULL fields left out; every write is a folder of its own, complete or not there."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: DataFrame) -> None:
        said = rows.select(F.to_json(F.struct("run_id", "status", "output", "error"), {"ignoreNullFields": "true"}).alias("value"))
        said.write.text(f"{self.path}/part={uuid.uuid4().hex}")

    def read(self, spark: SparkSession) -> DataFrame:
        """One row for each run id: a success if there is one."""
        raw = spark.read.text(self.path).select(F.from_json("value", OUTPUT).alias("r")).select("r.*")
        rest = F.struct(F.when(F.col("status") == "succeeded", 0).otherwise(1).alias("_late"), "status", "output", "error")
        return raw.groupBy("run_id").agg(F.min(rest).alias("r")).select("run_id", "r.status", "r.output", "r.error")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; reports hold one row for each second or queue."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
