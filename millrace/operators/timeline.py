"""Ordered analytics: claim order, step latencies, retry timelines, depth over time, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators.ordered import neighbour


def running_total(df: DataFrame, by: str, bucket: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``by`` in the order (bucket, order).

    Sums of whole buckets are added up first, then rows inside a bucket, so the rows of one group are
    spread over as many tasks as it has buckets. ``bucket`` columns must be a coarser form of the order.
    """
    sums = df.groupBy(by, *bucket).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(by, *bucket, (F.sum("_s").over(earlier) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy(by, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_in", F.sum(value).over(inside)).join(sums, [by, *bucket]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before")


def claim_order(jobs: DataFrame, id_head: int = 22) -> DataFrame:
    """Rank of each pending job within its queue: low priority number first, then id.

    Ids that share their first ``id_head`` characters are ranked together.
    """
    rows = jobs.where("status = 'Pending'").withColumns({"_head": F.substring("id", 1, id_head), "_one": F.lit(1).cast("bigint")})
    return running_total(rows, "queue", ["priority", "_head"], ["id"], "_one", "rank").drop("_head", "_one")


def claim_batch(jobs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each queue; the group limit prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("queue").orderBy("priority", "id")).cast("bigint")
    return jobs.where("status = 'Pending'").withColumn("rank", rank).where(F.col("rank") <= n)


def step_latency(samples: DataFrame) -> DataFrame:
    """``samples(run_id, step, elapsed)``: of a retried step the least counts; then the difference to the step before."""
    steps = samples.groupBy("run_id", "step").agg(F.min("elapsed").alias("elapsed"))
    w = Window.partitionBy("run_id").orderBy("step")
    return steps.withColumn("latency", F.col("elapsed") - F.lag("elapsed").over(w))


def run_e2e(samples: DataFrame, submits: DataFrame) -> DataFrame:
    """Submit to last step of each run; a step before its submit counts as no time."""
    last = samples.groupBy("run_id", "step").agg(F.min("elapsed").alias("elapsed")).groupBy("run_id").agg(F.max_by("elapsed", "step").alias("last_ms"), F.max("step").alias("last_step"))
    return last.join(submits, "run_id").select("run_id", "last_step", F.greatest(F.col("last_ms") - F.col("submitted_at"), F.lit(0)).alias("e2e_ms"))


def retry_timeline(attempts: DataFrame, base: int = 1000, most: int = 300_000) -> DataFrame:
    """When each attempt would start from durations and backoffs alone: running sum of the ones before it."""
    d = attempts.withColumn("delay", F.when(F.col("outcome") == "LeaseExpired", F.col("occ")).otherwise(F.col("occ") + S.backoff_delay("attempt", base, most)))
    w = Window.partitionBy("id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("waited", F.coalesce(F.sum("delay").over(w), F.lit(0)))


def state_durations(changes: DataFrame) -> DataFrame:
    """``changes(id, at_ms, seq, state)``: how long each state lasted; NULL for the last."""
    w = Window.partitionBy("id").orderBy("at_ms", "seq")
    return changes.withColumn("lasted_ms", F.lead("at_ms").over(w) - F.col("at_ms"))


def running_depth(changes: DataFrame, bucket_ms: int = 21_600_000) -> DataFrame:
    """``changes(queue, at_ms, seq, delta)``: depth after each change; times are added up by buckets first."""
    rows = changes.withColumn("_hour", F.expr(f"at_ms div {bucket_ms}"))
    return running_total(rows, "queue", ["_hour"], ["at_ms", "seq"], "delta", "depth").drop("_hour")


def heartbeat_gaps(beats: DataFrame) -> DataFrame:
    """Time between beats, whole intervals missed, and beats of a writer that another replaced."""
    rows = neighbour(beats.withColumn("_all", F.lit(0)), ["_all"], F.expr("counter div 4096"), ["counter"], F.col("at_ms"), "_last")
    top = beats.agg(F.max("epoch").alias("_top"))
    return rows.withColumn("gap_ms", F.col("at_ms") - F.col("_last")).crossJoin(F.broadcast(top)).select("counter", "gap_ms", F.expr("gap_ms div interval_ms AS missed"), (F.col("epoch") < F.col("_top")).alias("superseded"))


def seq_advance(polls: DataFrame) -> DataFrame:
    """Liveness without a clock: whether the durable sequence moved since the poll before; the first poll counts as alive."""
    rows = neighbour(polls.withColumn("_all", F.lit(0)), ["_all"], F.expr("poll div 4096"), ["poll"], F.col("durable_seq"), "_last")
    return rows.withColumn("alive", F.coalesce(F.col("durable_seq") > F.col("_last"), F.lit(True))).drop("_all", "_last")


def rate_schedule(schedules: DataFrame) -> DataFrame:
    """``schedules(name, text)`` of ``seconds:rate`` parts with running ends; one bad part rejects the whole text."""
    p = schedules.select("name", F.posexplode(F.split("text", ",")).alias("pos", "seg"))
    good = F.col("seg").rlike(r"\A[1-9][0-9]*:[0-9]+\z")
    p = p.select("name", F.col("pos").cast("bigint").alias("pos"), F.when(good, F.split_part("seg", F.lit(":"), F.lit(1)).try_cast("bigint")).alias("secs"), F.when(good, F.split_part("seg", F.lit(":"), F.lit(2)).try_cast("bigint")).alias("rate"))
    every = Window.partitionBy("name")
    p = p.withColumn("_bad", F.count(F.when(F.col("secs").isNull(), 1)).over(every)).where("_bad = 0").drop("_bad")
    return p.withColumn("until_s", F.sum("secs").over(every.orderBy("pos")))
