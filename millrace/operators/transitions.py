"""Set-based state transitions: state and commands in; new state, outcomes and effects out.

``jobs`` has the columns of ``schemas.JOB`` that the transition touches. Times are arguments, never the
clock. One call applies one batch of commands, of which each names a job at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators.ordered import running, stream_fold
from millrace.schemas import QueueConfig

DEFAULT = QueueConfig()
_null = lambda kind: F.lit(None).cast(kind)


def prepared(cmds: DataFrame, now_col: str = "now") -> DataFrame:
    """``cmds(id, queue, run_at, ...)``: Scheduled if due later than now, else Pending without a time."""
    late = F.col("run_at") > F.col(now_col)
    return cmds.withColumn("status", F.when(late, "Scheduled").otherwise("Pending")).withColumn("run_at", F.when(late, F.col("run_at")))


def fold_dedup(cmds: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Outcome of enqueues with a dedup key, in order, while each accepted job holds its key until its claim.

    ``cmds(id, queue, dedup_key, enqueued_at, claimed_at)``: acceptance depends on earlier acceptance. A
    command that comes after every earlier one of its key is claimed is new whatever went before, so it
    begins a segment. Those are found by running maxima and sums over buckets of time, so a hot key's segments
    are spread, and the commands of one pass in order, one by one. Without a key a command is always new.
    """
    until = F.coalesce("claimed_at", F.lit(1 << 62)).alias("until")
    rows = cmds.where("dedup_key IS NOT NULL").select("queue", "dedup_key", "id", "enqueued_at", until)
    by, at, order = ["queue", "dedup_key"], F.expr(f"enqueued_at div {bucket_ms}"), ["enqueued_at", "id"]
    rows = running(rows, by, at, order, F.col("until"), "held", "max", own=False)
    rows = running(rows, by, at, order, (F.col("enqueued_at") >= F.coalesce("held", F.lit(-(1 << 62)))).cast("bigint"), "seg")

    def accept(rows):
        holder, until = None, None
        for queue, key, _, at, job, end in rows:
            if until is not None and at < until:
                yield queue, key, job, "AlreadyEnqueued", holder
            else:
                holder, until = job, end
                yield queue, key, job, "New", None

    done = stream_fold(rows.select(*by, "seg", "enqueued_at", "id", "until"), [*by, "seg"], order, accept, "queue STRING, dedup_key STRING, id STRING, outcome STRING, existing STRING")
    free = cmds.where("dedup_key IS NULL").select("queue", "dedup_key", "id", F.lit("New").alias("outcome"), _null("string").alias("existing"))
    return done.unionByName(free)


def dedup_against(jobs: DataFrame, cmds: DataFrame) -> DataFrame:
    """Enqueues against the keys that waiting jobs hold; then against ids in use."""
    held = jobs.where("status IN ('Pending', 'Scheduled') AND dedup_key IS NOT NULL").groupBy("queue", "dedup_key").agg(F.min("id").alias("existing"))
    ids = jobs.select(F.col("id").alias("_used"))
    out = cmds.join(held, ["queue", "dedup_key"], "left").join(ids, F.col("id") == F.col("_used"), "left")
    return out.withColumn("outcome", F.when(F.col("existing").isNotNull(), "AlreadyEnqueued").when(F.col("_used").isNotNull(), "DuplicateJobId").otherwise("New")).drop("_used")


def enqueue(jobs: DataFrame, cmds: DataFrame) -> DataFrame:
    """The state with the commands that are new; counters follow from the rows."""
    new = prepared(dedup_against(jobs, cmds).where("outcome = 'New'"))
    return jobs.unionByName(new.select(*[F.col(c) if c in new.columns else _null(t).alias(c) for c, t in jobs.dtypes]), allowMissingColumns=True)


def claim(jobs: DataFrame, n: int, now: int) -> DataFrame:
    """The first ``n`` pending jobs of each queue become Claimed; others stay as they are."""
    won = jobs.where("status = 'Pending'").select("queue", "priority", "id").withColumn("_r", F.row_number().over(Window.partitionBy("queue").orderBy("priority", "id"))).where(F.col("_r") <= n).select("id", F.lit(True).alias("claimed_now"))
    out = jobs.join(won, "id", "left").withColumn("claimed_now", F.coalesce("claimed_now", F.lit(False)))
    c = F.col("claimed_now")
    return out.withColumns({
        "status": F.when(c, "Claimed").otherwise(F.col("status")), "attempts": F.col("attempts") + c.cast("bigint"),
        "claimed_at": F.when(c, F.lit(now)).otherwise(F.col("claimed_at")), "dedup_key": F.when(~c, F.col("dedup_key")),
    })


def fenced(jobs: DataFrame, settlements: DataFrame) -> DataFrame:
    """``settlements(id, token, ...)`` with ``fence``: Current, or ClaimLost where the token is stale or the job not claimed."""
    own = jobs.where("status = 'Claimed'").select(F.col("id").alias("_i"), F.col("claim_token").alias("_t"))
    return settlements.join(own, (F.col("id") == F.col("_i")) & (F.col("token") == F.col("_t")), "left").withColumn("fence", F.when(F.col("_i").isNull(), "ClaimLost").otherwise("Current")).drop("_i", "_t")


def ack(jobs: DataFrame, now: int, keep_done: str = "keep_done_ms") -> DataFrame:
    """Claimed rows that are acknowledged: Done where the queue keeps done jobs, else deleted (status NULL).

    The done counter grows by one in either case.
    """
    kept = F.col(keep_done).isNotNull()
    return jobs.withColumns({"status": F.when(kept, "Done"), "completed_at": F.when(kept, F.lit(now)), "history": F.when(kept, "Completed"), "done_delta": F.lit(1).cast("bigint")})


def nack(jobs: DataFrame, now: int, error: str | Column, base: str = "base_ms", most: str = "max_ms") -> DataFrame:
    """Claimed rows that fail: Dead from the last attempt on, else Pending or, with a backoff, Scheduled."""
    dead, wait = F.col("attempts") >= F.col("max_attempts"), S.backoff_delay("attempts", F.col(base), F.col(most))
    return jobs.withColumns({
        "status": F.when(dead, "Dead").when(wait > 0, "Scheduled").otherwise("Pending"),
        "run_at": F.when(~dead & (wait > 0), F.lit(now) + wait), "claimed_at": F.when(dead, F.col("claimed_at")), "failed_at": F.when(dead, F.lit(now)),
        "last_error": F.lit(error), "history": F.when(dead, "DeadLettered").otherwise("Retried"), "outcome": F.when(dead, "DeadLettered").otherwise("Retried"),
    })


def dead_letter(jobs: DataFrame, now: int, reason: str | Column) -> DataFrame:
    """Claimed rows that fail for good, whatever their attempts; the claim time is cleared."""
    return jobs.withColumns({"status": F.lit("Dead"), "claimed_at": _null("bigint"), "failed_at": F.lit(now), "last_error": F.lit(reason), "history": F.lit("DeadLettered")})


def reap(jobs: DataFrame, now: int, text: str = "lease expired", history: str = "LeaseExpired") -> DataFrame:
    """Claimed rows whose lease ended: requeued with the last error as it was, or Dead with the claim time kept."""
    dead = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns({
        "status": F.when(dead, "Dead").otherwise("Pending"), "claimed_at": F.when(dead, F.col("claimed_at")), "failed_at": F.when(dead, F.lit(now)),
        "last_error": F.when(dead, F.lit(text)).otherwise(F.col("last_error")), "history": F.when(dead, "DeadLettered").otherwise(history),
    })


def promote(jobs: DataFrame, now: int) -> DataFrame:
    """Scheduled rows that are due become Pending."""
    due = (F.col("status") == "Scheduled") & (F.col("run_at") <= now)
    return jobs.withColumns({"promoted": F.coalesce(due, F.lit(False)), "status": F.when(due, "Pending").otherwise(F.col("status")), "run_at": F.when(~F.coalesce(due, F.lit(False)), F.col("run_at"))})


def cancel(jobs: DataFrame, cmds: DataFrame) -> DataFrame:
    """``cmds(id)``: Removed while waiting, Requested while claimed, else NotFound."""
    out = cmds.join(jobs.select("id", "status"), "id", "left")
    return out.withColumn("outcome", F.when(F.col("status").isin("Pending", "Scheduled"), "Removed").when(F.col("status") == "Claimed", "Requested").otherwise("NotFound"))


def wake(jobs: DataFrame, cmds: DataFrame) -> DataFrame:
    """``cmds(id)``: Woken if scheduled, NotScheduled in another state, NotFound without the job."""
    out = cmds.join(jobs.select("id", "status"), "id", "left")
    return out.withColumn("outcome", F.when(F.col("status") == "Scheduled", "Woken").when(F.col("status").isNull(), "NotFound").otherwise("NotScheduled"))


def requeue_dead(jobs: DataFrame) -> DataFrame:
    """Dead rows start over; when they were enqueued stays."""
    return jobs.withColumns({"status": F.lit("Pending"), "attempts": F.lit(0).cast("bigint"), "claimed_at": _null("bigint"), "failed_at": _null("bigint"), "last_error": _null("string"), "history": F.lit("Requeued")})


def expired(jobs: DataFrame, now: int) -> DataFrame:
    """Done and dead rows beyond their queue's retention, strictly; NULL retention keeps forever."""
    done = (F.col("status") == "Done") & (F.col("completed_at") < S.cutoff(F.lit(now), "keep_done_ms"))
    dead = (F.col("status") == "Dead") & (F.col("failed_at") < S.cutoff(F.lit(now), "dead_retention_ms"))
    return jobs.where(done | dead)


def after_sweep(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of jobs, or of what belongs to jobs, without those of jobs that a sweep deletes."""
    return jobs.join(gone.select("id"), "id", "left_anti")


def wait_outcome(jobs: DataFrame, waits: DataFrame) -> DataFrame:
    """``waits(id, until)`` over ``jobs(id, done_at)``: Completed in time, else TimedOut; NotFound without the job."""
    out = waits.join(jobs, "id", "left")
    return out.withColumn("outcome", F.when(F.col("_known").isNull(), "NotFound").when(F.col("done_at") <= F.col("until"), "Completed").otherwise("TimedOut"))
