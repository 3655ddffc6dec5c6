"""Reads of the store: lookups, state listings with keyset pages, configuration, joins to payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import QueueConfig

# order of each state's listing; a page's cursor is these columns of its last row
ORDERS = {
    "Pending": ("priority", "id"),
    "Scheduled": ("run_at", "queue_bytes", "queue", "id"),
    "Claimed": ("id",),
    "Done": ("completed_at", "queue_bytes", "queue", "id"),
    "Dead": ("id",),
}


def with_order(jobs: DataFrame) -> DataFrame:
    """Adds ``queue_bytes``: stores keep a queue's length before its name, so short names sort first."""
    return jobs.withColumn("queue_bytes", F.octet_length("queue").cast("bigint"))


def after(columns: tuple[str, ...], cursor: tuple) -> Column:
    """Row position beyond a cursor; the row that the cursor names need not exist any more."""
    out = F.lit(False)
    for i in reversed(range(len(columns))):
        c, v = F.col(columns[i]), F.lit(cursor[i])
        out = (c > v) | ((c == v) & out)
    return out


def list_jobs(jobs: DataFrame, queue: str, status: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """One page of a queue's jobs in a state, with ``has_next``; the plan takes ``limit + 1`` rows.

    A limit of 0 or a cursor of another shape gives an empty page.
    """
    order = ORDERS[status]
    rows = with_order(jobs).where((F.col("queue") == queue) & (F.col("status") == status))
    if limit <= 0 or (cursor is not None and len(cursor) != len(order)):
        return rows.limit(0).withColumn("pos", F.lit(0).cast("bigint")).withColumn("has_next", F.lit(False))
    if cursor is not None:
        rows = rows.where(after(order, cursor))
    page = rows.orderBy(*order).limit(limit + 1)
    from pyspark.sql import Window

    page = page.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint")).withColumn("has_next", F.max("pos").over(Window.partitionBy()) > limit)
    return page.where(F.col("pos") <= limit)


def list_queues(log: DataFrame) -> DataFrame:
    """Queues that ever had a job, even if it is empty now; short names first."""
    return log.select("queue").distinct().withColumn("queue_bytes", F.octet_length("queue").cast("bigint"))


def queue_stats(jobs: DataFrame, done_ever: DataFrame | None = None, queues: DataFrame | None = None) -> DataFrame:
    """Five counters of each queue. ``done_ever(queue, done)`` replaces the recount, as done is cumulative."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).cast("bigint").alias(s.lower())
    out = jobs.groupBy("queue").agg(*[count(s) for s in ("Pending", "Claimed", "Done", "Dead", "Scheduled")])
    if done_ever is not None:
        out = out.drop("done").join(done_ever, "queue", "full").select("queue", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("pending", "claimed", "done", "dead", "scheduled")])
    if queues is not None:
        out = queues.select("queue").join(out, "queue", "left").na.fill(0)
    return out


def effective_config(queues: DataFrame, config: DataFrame, default: QueueConfig = QueueConfig()) -> DataFrame:
    """Configuration of each queue of ``queues(queue)``; ``config`` is a small dimension table.

    The retention of a configured queue may be NULL, which keeps forever; only a queue without
    configuration takes the default.
    """
    c = F.broadcast(config.withColumn("_has", F.lit(True)))
    out = queues.join(c, "queue", "left")
    pick = lambda name, d: F.when(F.col("_has").isNotNull(), F.col(name)).otherwise(F.lit(d).cast("bigint")).alias(name)
    return out.select(*queues.columns, pick("cfg_max_attempts", default.max_attempts), pick("lease_ms", default.lease_ms), pick("default_priority", default.default_priority), pick("base_ms", default.backoff_base_ms), pick("max_ms", default.backoff_max_ms), pick("keep_done_ms", default.keep_done_ms), pick("dead_retention_ms", default.dead_retention_ms))


def materialise_payloads(jobs: DataFrame, payloads: DataFrame) -> DataFrame:
    """``jobs(payload_ref)`` with what is stored apart; ``payload_missing`` where a reference dangles."""
    p = payloads.withColumn("_found", F.lit(True))
    return jobs.join(p, "payload_ref", "left").withColumn("payload_missing", F.col("payload_ref").isNotNull() & F.col("_found").isNull()).drop("_found")


def orphans(payloads: DataFrame, jobs: DataFrame) -> DataFrame:
    return payloads.join(jobs.select("payload_ref"), "payload_ref", "left_anti")


def dangling(jobs: DataFrame, payloads: DataFrame) -> DataFrame:
    return jobs.where("payload_ref IS NOT NULL").join(payloads.select("payload_ref"), "payload_ref", "left_anti")


def kv_scan(kv: DataFrame, prefix: str, limit: int, after_key: str | None = None) -> DataFrame:
    """Keys with a prefix in byte order, from beyond a key; an empty prefix takes all."""
    rows = kv.where(F.col("key").startswith(prefix))
    if after_key is not None:
        rows = rows.where(F.col("key") > after_key)
    return rows.orderBy("key").limit(limit)
