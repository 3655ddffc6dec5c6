"""JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, schema: str, column: str = "value", extra: list[str] = []) -> DataFrame:
    """``lines`` without the blank ones, as (line, ok, record): a bad line has ``ok`` false and a NULL record.

    ``extra`` names columns of ``lines`` to carry along.
    """
    own = lines.where(F.col(column).rlike(r"\S"))
    got = own.withColumn("record", F.from_json(column, f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("record").isNull() | F.col("record._corrupt_record").isNotNull()
    return got.select(*extra, F.col(column).alias("line"), (~bad).alias("ok"), F.when(~bad, F.col("record").dropFields("_corrupt_record")).alias("record"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def output_line(run_id, status, output, error) -> Column:
    """One output record as JSON; absent fields are left out."""
    return F.to_json(F.struct(run_id.alias("run_id"), status.alias("status"), output.alias("output"), error.alias("error")), {"ignoreNullFields": "true"})


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records (run_id, status, output, error), at least once; readers keep one of each run_id."""
    df.select(output_line(*[F.col(c) for c in ("run_id", "status", "output", "error")]).alias("value")).write.text(path)
