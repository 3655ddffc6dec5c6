"""The sample tables seen as a task log; each frame has its twin as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1_705_363_200_000
OFFLOAD = 4096
OFFSETS = (5, 500, 1_500, 3_000, 40_000, 600_000, 10_000_000_000)
CONFIG = (  # queue, max_attempts, lease_ms, default_priority, base, max, keep_done, dead_retention
    ("view", 2, 30_000, 1000, 1_000, 300_000, 86_400_000, 604_800_000),
    ("signup", 3, 30_000, 1000, 1_000, 300_000, None, 604_800_000),
    ("click", 3, 60_000, 10_000, 500, 60_000, 432_000_000, 172_800_000),
    ("purchase", 5, 30_000, 100, 1_000, 300_000, 259_200_000, None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str):
    """Epoch milliseconds of a timestamp without zone, truncated."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) div 1000")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each event."""
    docs = table(spark, sf_dir, "documents").count()
    e = table(spark, sf_dir, "events").select(
        "event_id", F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"), F.col("event_type").alias("queue"), "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.floor(F.col("value") * 100).cast("bigint").alias("v"), millis("ts").alias("enqueued_at"),
        F.pmod("event_id", F.lit(docs)).cast("bigint").alias("doc_id"),
    )
    return e.select(
        "*", F.expr("CASE WHEN k < 10 THEN 100L WHEN k < 90 THEN 1000L ELSE 10000L END AS priority"), F.expr("CASE queue WHEN 'purchase' THEN 5L WHEN 'view' THEN 2L ELSE 3L END AS max_attempts"),
        F.expr("CASE WHEN k > 0 AND k % 7 = 0 THEN enqueued_at + k * 60000 END AS run_at"), F.expr("CAST(user_id % 3 AS STRING) AS dedup_key"), F.expr("v % 23 = 0 AS permanent"), F.expr("v % 4 AS n_fail"),
        F.expr("CASE WHEN v % 37 = 0 THEN 45000L ELSE 50 + v % 900 END AS service_ms"), F.expr("CASE WHEN k = 99 THEN enqueued_at + 30000 END AS cancel_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts of each job, from the closed form of its retries."""
    j = jobs(spark, sf_dir).withColumn("overrun", F.expr("service_ms > 30000")).withColumn("start", F.expr("coalesce(run_at, enqueued_at) + 10 * k"))
    j = j.withColumn("attempt", F.expr("explode(sequence(1L, CASE WHEN permanent THEN 1L WHEN overrun THEN max_attempts ELSE least(n_fail + 1, max_attempts) END))"))
    j = j.withColumn("occ", F.expr("least(service_ms, 30000L)")).withColumn("claimed_at", F.expr("start + CASE WHEN overrun THEN (attempt - 1) * 30000 ELSE (attempt - 1) * service_ms + 1000 * (CAST(shiftleft(1L, CAST(attempt - 1 AS INT)) AS BIGINT) - 1) END"))
    out = F.expr("CASE WHEN permanent THEN 'DeadLettered' WHEN overrun AND attempt < max_attempts THEN 'LeaseExpired' WHEN overrun THEN 'DeadLettered' WHEN attempt > n_fail THEN 'Completed' WHEN attempt >= max_attempts THEN 'DeadLettered' ELSE 'Retried' END")
    j = j.withColumn("recorded_at", F.expr("claimed_at + occ")).withColumn("outcome", out)
    error = F.expr("CASE WHEN outcome IN ('Completed', 'LeaseExpired') THEN NULL WHEN overrun AND NOT permanent THEN 'lease expired' ELSE 'e' || attempt END")
    return j.select("id", "queue", "k", "v", "user_id", "doc_id", "priority", "max_attempts", "enqueued_at", "attempt", "claimed_at", "recorded_at", "occ", "outcome", error.alias("error"), "overrun", "permanent")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's job rows, each job seen at its own moment after it was enqueued, so that all states occur."""
    j = jobs(spark, sf_dir).withColumn("seen_at", F.col("enqueued_at") + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in OFFSETS]), (F.col("v") % 7 + 1).cast("int")))
    a = attempts(spark, sf_dir).select("id", F.struct("attempt", "claimed_at", "recorded_at", "outcome", "error", "overrun", "permanent").alias("a"))
    last = a.join(j.select("id", "seen_at"), "id").where("a.claimed_at <= seen_at").groupBy("id").agg(F.max("a").alias("a"))
    s = j.join(last, "id", "left")
    s = s.withColumn("settled", F.expr("a IS NOT NULL AND seen_at >= a.recorded_at"))
    s = s.withColumn("status", F.expr("CASE WHEN a IS NULL THEN CASE WHEN run_at > seen_at THEN 'Scheduled' ELSE 'Pending' END WHEN NOT settled THEN 'Claimed' WHEN a.outcome = 'Completed' THEN 'Done' WHEN a.outcome = 'DeadLettered' THEN 'Dead' ELSE 'Scheduled' END"))
    return s.select(
        "id", "queue", "status", F.expr("coalesce(a.attempt, 0L) AS attempts"), "max_attempts", "enqueued_at",
        F.expr("CASE WHEN status IN ('Claimed', 'Done') OR (status = 'Dead' AND NOT permanent) THEN a.claimed_at END AS claimed_at"),
        F.expr("CASE WHEN status = 'Scheduled' THEN CASE WHEN a IS NULL THEN run_at ELSE a.recorded_at + 1000 * CAST(shiftleft(1L, CAST(a.attempt - 1 AS INT)) AS BIGINT) END END AS run_at"),
        "priority", F.expr("CASE WHEN settled AND a.error IS NOT NULL THEN a.error WHEN a.attempt > 1 AND NOT a.overrun THEN 'e' || (a.attempt - 1) END AS last_error"),
        F.expr("CASE WHEN a IS NULL THEN dedup_key END AS dedup_key"), F.expr("CASE WHEN status = 'Done' THEN a.recorded_at END AS completed_at"), F.expr("CASE WHEN status = 'Dead' THEN a.recorded_at END AS failed_at"),
        F.expr("CASE WHEN status = 'Claimed' THEN event_id * 7 + a.attempt END AS claim_token"), F.expr("CASE WHEN status = 'Claimed' THEN a.claimed_at + 30000 END AS lease_expires_at"),
        "event_id", "user_id", "k", "v", "doc_id", "seen_at",
    )


def config(spark: SparkSession) -> DataFrame:
    """Queue configuration; the error queue has none and takes the defaults."""
    return spark.createDataFrame([*CONFIG], "queue STRING, cfg_max_attempts BIGINT, lease_ms BIGINT, default_priority BIGINT, base_ms BIGINT, max_ms BIGINT, keep_done_ms BIGINT, dead_retention_ms BIGINT")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are stored apart: the long documents; every 97th was lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.substring("text", 1, 128).alias("head"))
    return d.where(f"bytes > {OFFLOAD} AND doc_id % 97 <> 5").select(F.concat(F.lit("payloads/"), F.lpad(F.col("doc_id").cast("string"), 26, "0")).alias("payload_ref"), "bytes", "head")


def _values(rows) -> str:
    said = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT"
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


# ---- the same in DuckDB
JOBS = """j0 AS (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 26, '0') AS id, event_type AS queue, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
    CAST(floor(value * 100) AS BIGINT) AS v, epoch_us(ts) // 1000 AS enqueued_at, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events),
jobs AS (SELECT *, CASE WHEN k < 10 THEN 100 WHEN k < 90 THEN 1000 ELSE 10000 END::BIGINT AS priority, CASE queue WHEN 'purchase' THEN 5 WHEN 'view' THEN 2 ELSE 3 END::BIGINT AS max_attempts,
    CASE WHEN k > 0 AND k % 7 = 0 THEN enqueued_at + k * 60000 END AS run_at, CAST(user_id % 3 AS VARCHAR) AS dedup_key, v % 23 = 0 AS permanent, v % 4 AS n_fail,
    CASE WHEN v % 37 = 0 THEN 45000 ELSE 50 + v % 900 END::BIGINT AS service_ms, CASE WHEN k = 99 THEN enqueued_at + 30000 END AS cancel_at FROM j0)"""
ATTEMPTS = JOBS + """,
a0 AS (SELECT *, service_ms > 30000 AS overrun, coalesce(run_at, enqueued_at) + 10 * k AS start, CASE WHEN permanent THEN 1 WHEN service_ms > 30000 THEN max_attempts ELSE least(n_fail + 1, max_attempts) END AS last_a FROM jobs),
a1 AS (SELECT a0.*, g.attempt FROM a0 JOIN (SELECT CAST(range AS BIGINT) AS attempt FROM range(1, 6)) g ON g.attempt <= a0.last_a),
a2 AS (SELECT *, least(service_ms, 30000) AS occ, start + CASE WHEN overrun THEN (attempt - 1) * 30000 ELSE (attempt - 1) * service_ms + 1000 * (CAST(pow(2, attempt - 1) AS BIGINT) - 1) END AS claimed_at,
    CASE WHEN permanent THEN 'DeadLettered' WHEN overrun AND attempt < max_attempts THEN 'LeaseExpired' WHEN overrun THEN 'DeadLettered' WHEN attempt > n_fail THEN 'Completed' WHEN attempt >= max_attempts THEN 'DeadLettered' ELSE 'Retried' END AS outcome FROM a1),
attempts AS (SELECT id, queue, k, v, user_id, doc_id, priority, max_attempts, enqueued_at, attempt, claimed_at, claimed_at + occ AS recorded_at, occ, outcome,
    CASE WHEN outcome IN ('Completed', 'LeaseExpired') THEN NULL WHEN overrun AND NOT permanent THEN 'lease expired' ELSE 'e' || attempt END AS error, overrun, permanent FROM a2)"""
STATE = ATTEMPTS + f""",
s0 AS (SELECT *, enqueued_at + [{', '.join(map(str, OFFSETS))}][v % 7 + 1] AS seen_at FROM jobs),
s1 AS (SELECT a.id, max(a.attempt) AS att FROM attempts a JOIN s0 ON a.id = s0.id AND a.claimed_at <= s0.seen_at GROUP BY a.id),
s2 AS (SELECT s0.*, a.attempt AS att, a.claimed_at AS ac, a.recorded_at AS ar, a.outcome, a.error, a.overrun, a.attempt IS NOT NULL AND s0.seen_at >= a.recorded_at AS settled
    FROM s0 LEFT JOIN s1 ON s0.id = s1.id LEFT JOIN attempts a ON a.id = s0.id AND a.attempt = s1.att),
s3 AS (SELECT *, CASE WHEN att IS NULL THEN CASE WHEN run_at > seen_at THEN 'Scheduled' ELSE 'Pending' END WHEN NOT settled THEN 'Claimed' WHEN outcome = 'Completed' THEN 'Done' WHEN outcome = 'DeadLettered' THEN 'Dead' ELSE 'Scheduled' END AS st FROM s2),
state AS (SELECT id, queue, st AS status, coalesce(att, 0) AS attempts, max_attempts, enqueued_at, CASE WHEN st IN ('Claimed', 'Done') OR (st = 'Dead' AND NOT permanent) THEN ac END AS claimed_at,
    CASE WHEN st = 'Scheduled' THEN CASE WHEN att IS NULL THEN run_at ELSE ar + 1000 * CAST(pow(2, att - 1) AS BIGINT) END END AS run_at, priority,
    CASE WHEN settled AND error IS NOT NULL THEN error WHEN att > 1 AND NOT overrun THEN 'e' || (att - 1) END AS last_error, CASE WHEN att IS NULL THEN dedup_key END AS dedup_key,
    CASE WHEN st = 'Done' THEN ar END AS completed_at, CASE WHEN st = 'Dead' THEN ar END AS failed_at, CASE WHEN st = 'Claimed' THEN event_id * 7 + att END AS claim_token,
    CASE WHEN st = 'Claimed' THEN ac + 30000 END AS lease_expires_at, event_id, user_id, k, v, doc_id, seen_at FROM s3)"""
CONFIGS = f"config(queue, cfg_max_attempts, lease_ms, default_priority, base_ms, max_ms, keep_done_ms, dead_retention_ms) AS (VALUES {_values(CONFIG)})"
PAYLOADS = f"payloads AS (SELECT 'payloads/' || lpad(CAST(doc_id AS VARCHAR), 26, '0') AS payload_ref, CAST(strlen(text) AS BIGINT) AS bytes, substr(text, 1, 128) AS head FROM documents WHERE strlen(text) > {OFFLOAD} AND doc_id % 97 <> 5)"
