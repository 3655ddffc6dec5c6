"""Streams over the event log, drained; the oracles are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.registry import ORACLES, query
from millrace.sources import fixtures as X
from millrace.streaming import processors as P
from millrace.streaming.run import drain


def _events(spark, sf):
    """The events table as a stream; it may be one file or a folder of files."""
    path = f"{sf}/events.parquet"
    r = spark.readStream.schema(X.table(spark, sf, "events").schema)
    return r.parquet(path) if _is_dir(spark, path) else r.option("pathGlobFilter", "events.parquet").parquet(sf)


def _is_dir(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _jobs(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"), F.col("event_type").alias("queue"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.floor(F.col("value") * 100).cast("bigint").alias("v"), X.millis("ts").alias("enqueued_at"))


@query("stream_depth", f"WITH {X.JOBS} SELECT queue, count(*) AS enqueued, min(enqueued_at) AS first_at, max(enqueued_at) AS last_at FROM jobs GROUP BY queue")
def _(spark, sf):
    out = drain(P.depth(_jobs(spark, sf)), "update")
    return out.groupBy("queue").agg(*[F.max_by(c, "_batch").alias(c) for c in ("enqueued", "first_at", "last_at")])


@query("stream_kv_fold", ORACLES["kv_cas"])
def _(spark, sf):
    c = _jobs(spark, sf).selectExpr("'k' || (user_id % 20) || '/' || queue AS key", "event_id AS seq", "CASE WHEN k % 10 = 0 THEN 'delete' WHEN k % 10 < 6 THEN 'put' WHEN k % 10 < 9 THEN 'cas' ELSE 'cad' END AS op", "CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(v % 3 AS STRING) END AS expected", "CAST(v % 3 AS STRING) AS value")
    out = drain(P.stateful(c, "key", P.KvFold), "update")
    return out.groupBy("key").agg(F.max_by("applied", "_batch").alias("applied"), F.max_by("refused", "_batch").alias("refused"))


@query("stream_dedup", ORACLES["dedup_outcome"])
def _(spark, sf):
    j = _jobs(spark, sf).selectExpr("queue || '/' || user_id AS dkey", "id", "enqueued_at AS at_ms", "coalesce(CASE WHEN k > 0 AND k % 7 = 0 THEN enqueued_at + k * 60000 END, enqueued_at) + 10 * k AS until_ms")
    return drain(P.stateful(j, "dkey", P.DedupWithRelease), "update").select("id", "outcome", "existing")
