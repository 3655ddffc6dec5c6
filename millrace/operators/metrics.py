"""Counters, percentiles and windowed reports over the attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import running


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int], bucket: int = 256) -> DataFrame:
    """``n`` and, for each p, the value at place ``min(n * p div 100, n - 1)`` (from 0) in ascending order.

    Equal values are counted before anything is ordered, and counts of ranges of ``bucket`` values are added up before
    values inside a range, so a group's different values are spread over as many tasks as they fill ranges.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    c = running(counts.withColumn("_all", F.lit(0)), [*by, "_all"], F.floor(F.col(value) / bucket), [value], F.col("_c"), "_to")
    total = counts.groupBy(*by).agg(F.sum("_c").alias("n")) if by else counts.agg(F.sum("_c").alias("n"))
    for k in by:
        total = total.withColumnRenamed(k, f"_t_{k}")
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    c = c.join(total, on)  # without groups one row
    at = [F.expr(f"min(CASE WHEN _to > least(n * {p} div 100, n - 1) THEN `{value}` END)").alias(f"p{p}") for p in percents]
    return c.groupBy(*by).agg(F.max("n").cast("bigint").alias("n"), *at)


def log_changes(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Counter deltas (queue, metric, delta) of every transition in the log."""
    first = jobs.select("queue", F.expr("CASE WHEN run_at > enqueued_at THEN array(named_struct('metric', 'scheduled', 'delta', 1L), named_struct('metric', 'scheduled', 'delta', -1L), named_struct('metric', 'pending', 'delta', 1L)) ELSE array(named_struct('metric', 'pending', 'delta', 1L)) END AS d"))
    then = F.expr("""CASE outcome WHEN 'Completed' THEN array(named_struct('metric', 'done', 'delta', 1L))
        WHEN 'DeadLettered' THEN array(named_struct('metric', 'dead', 'delta', 1L))
        WHEN 'LeaseExpired' THEN array(named_struct('metric', 'pending', 'delta', 1L))
        ELSE array(named_struct('metric', 'scheduled', 'delta', 1L), named_struct('metric', 'scheduled', 'delta', -1L), named_struct('metric', 'pending', 'delta', 1L)) END""")
    claim = F.expr("array(named_struct('metric', 'pending', 'delta', -1L), named_struct('metric', 'claimed', 'delta', 1L), named_struct('metric', 'claimed', 'delta', -1L))")
    rest = attempts.select("queue", F.concat(claim, then).alias("d"))
    return first.unionByName(rest).select("queue", F.explode("d").alias("d")).select("queue", "d.metric", "d.delta")


def stats_from_log(changes: DataFrame) -> DataFrame:
    return changes.groupBy("queue", "metric").agg(F.sum("delta").alias("n"))


def queue_metrics(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Event counters; a nack counts only where it retries, a reap only where it requeues."""
    count = lambda o, name: F.count(F.when(F.col("outcome") == o, 1)).alias(name)
    a = attempts.groupBy("queue").agg(F.count("*").alias("claimed"), count("Completed", "completed"), count("Retried", "nacked"), count("DeadLettered", "dead_lettered"), count("LeaseExpired", "reaped"))
    return jobs.groupBy("queue").agg(F.count("*").alias("enqueued")).join(a, "queue", "left").na.fill(0)


def oldest_pending_age(jobs: DataFrame, now: int) -> DataFrame:
    """Age in seconds of each queue's next job to claim, not of the one that waits longest; 0 without jobs."""
    front = jobs.groupBy("queue").agg(F.min(F.when(F.col("status") == "Pending", F.struct("priority", "id", "enqueued_at"))).alias("f"))
    return front.select("queue", F.coalesce(F.greatest(F.lit(now) - F.col("f.enqueued_at"), F.lit(0)) / 1000.0, F.lit(0.0)).alias("age_s"))


def histogram(df: DataFrame, by: list[str], seconds: str, bounds: list[float]) -> DataFrame:
    """Counts up to each bound, as cumulative buckets, and of all."""
    return df.groupBy(*by).agg(*[F.count(F.when(F.col(seconds) <= b, 1)).alias(f"le_{b:g}") for b in bounds], F.count("*").alias("n"))
