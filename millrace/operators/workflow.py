"""Multi-step runs, signals, memo entries, typed jobs: decisions as columns, matches as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators.ordered import neighbour, running


def decide(steps: DataFrame) -> DataFrame:
    """``steps(kind, message, attempts, max_attempts, external_cancel)`` with what settles each step.

    A cancel by the runner wins over one from outside, and that over any other outcome. ``status`` is
    the run's terminal status, NULL while it goes on; ``keep_effects`` says if staged effects commit.
    """
    k, out = F.col("kind"), F.col("external_cancel")
    spent = F.col("attempts") >= F.col("max_attempts")
    by_runner = k == "Cancel"
    status = F.when(by_runner | out, "cancelled").when(k == "Succeed", "succeeded").when(k.isin("Fail", "Permanent") | ((k == "Transient") & spent), "failed")
    settle = F.when(by_runner | out, "ack").when(k == "Permanent", "dead_letter").when(k == "Transient", "nack").otherwise("ack")
    error = F.when(by_runner, F.col("message")).when(out, F.lit(None).cast("string")).when(k.isin("Fail", "Permanent") | ((k == "Transient") & spent), F.col("message"))
    goes_on = ~(by_runner | out) & k.isin("Continue", "After", "OnSignal")
    return steps.withColumns({"status": status, "settle": settle, "error": error, "next_step": F.when(goes_on, F.col("step") + 1), "keep_effects": (by_runner | ~out) & ~((k == "Transient") & ~spent) & (k != "Permanent") & ~((k == "Transient") & spent)})


def next_steps(decided: DataFrame, now: int) -> DataFrame:
    """Enqueue commands of the steps that follow; they inherit priority and attempts."""
    d = decided.where("next_step IS NOT NULL")
    return d.select("run_id", F.col("next_step").alias("step"), F.concat(F.lit("run:"), F.col("run_id").cast("string"), F.lit(":"), F.col("next_step").cast("string")).alias("dedup_key"), F.when(F.col("kind") == "After", F.lit(now) + F.col("delay_ms")).alias("run_at"), "max_attempts")


def termination(decided: DataFrame, now: int, retain: bool = True) -> DataFrame:
    """Effects of runs that end: the record goes, a marker for retention, one notification."""
    d = decided.where("status IS NOT NULL")
    run = F.col("run_id").cast("string")
    parts = [F.struct(F.lit("kv_delete").alias("effect"), F.concat(F.lit("workflow/runs/"), run).alias("key"))]
    if retain:
        parts.append(F.struct(F.lit("kv_write").alias("effect"), S.run_marker_key(F.lit(now), run).alias("key")))
    parts.append(F.struct(F.lit("enqueue").alias("effect"), F.concat(F.lit("run:"), run, F.lit(":terminal")).alias("key")))
    return d.select("run_id", "status", F.explode(F.array(*parts)).alias("e")).select("run_id", "status", "e.*")


def _waits_and_signals(waiters: DataFrame, signals: DataFrame) -> DataFrame:
    """Waiters (``_w`` 1) and signals (0) in one table; a signal carries itself in ``_s``."""
    none = F.lit(None).cast("struct<at_ms: bigint, id: string>")
    return waiters.select("key", "at_ms", "id", F.lit(1).alias("_w"), none.alias("_s")).unionByName(signals.select("key", "at_ms", "id", F.lit(0).alias("_w"), F.struct(F.col("at_ms").cast("bigint").alias("at_ms"), "id").alias("_s")))


def _time_bucket(width: int):
    return F.expr(f"at_ms div {max(1, width)}")


def match_signals(waiters: DataFrame, signals: DataFrame, timeout: int, bucket_ms: int = 600_000) -> DataFrame:
    """The earliest signal of the same key from a waiter's start to its timeout, both ends included.

    An as-of pass over buckets of time: a waiter looks at its own bucket and at the first signal of the next bucket
    that has one, so no waiter meets more than one signal and a hot key is spread over its buckets.
    """
    both = _waits_and_signals(waiters, signals)
    near = neighbour(both, ["key"], _time_bucket(bucket_ms), ["at_ms", F.desc("_w"), "id"], F.col("_s"), "_next", back=False).where("_w = 1")
    hit = F.col("_next.at_ms") <= F.col("at_ms") + timeout
    found = near.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("at_ms").alias("_at"), F.when(hit, F.col("_next.id")).alias("signal_id"), F.when(hit, F.col("_next.at_ms")).alias("signal_at")).distinct()
    return waiters.join(found, (F.col("id") == F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("at_ms") == F.col("_at")), "left").drop("_id", "_key", "_at")


def buffered_signal(waiters: DataFrame, signals: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """As of each waiter's start, the last signal of its key before it; spread as ``match_signals`` is."""
    both = _waits_and_signals(waiters, signals)
    near = neighbour(both, ["key"], _time_bucket(bucket_ms), ["at_ms", F.desc("_w"), "id"], F.col("_s"), "_last").where("_w = 1")
    return near.select("id", "key", "at_ms", F.col("_last.id").alias("buffered"))


def signal_conflicts(waiters: DataFrame, timeout: int, bucket_ms: int = 600_000) -> DataFrame:
    """Waiters that start while an earlier waiter of the key still waits; the latest earlier one decides."""
    near = neighbour(waiters.select("id", "key", "at_ms"), ["key"], _time_bucket(bucket_ms), ["at_ms", "id"], F.struct("at_ms", "id"), "earlier")
    return near.where(F.col("at_ms") < F.col("earlier.at_ms") + timeout).select("id", "key", F.col("earlier.id").alias("conflicts_with"))


def lease_overlaps(leases: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """``leases(queue, id, attempt, claimed_at, recorded_at)`` with ``overlaps``: how many other leases of the queue were held at the same time.

    That is the leases that began before this one ended, less those that ended by its beginning and itself: two
    running sums over the ends in order, and no pair is made.
    """
    own = ["queue", "id", "attempt"]
    ends = leases.select(*own, F.col("claimed_at").alias("at_ms"), F.lit(1).alias("begin")).unionByName(leases.select(*own, F.col("recorded_at").alias("at_ms"), F.lit(0).alias("begin")))
    order = ["at_ms", "begin", "id", "attempt"]  # at one moment, what ends comes first
    rows = running(ends, ["queue"], _time_bucket(bucket_ms), order, F.col("begin").cast("bigint"), "_began")
    rows = running(rows, ["queue"], _time_bucket(bucket_ms), order, (1 - F.col("begin")).cast("bigint"), "_ended")
    return rows.groupBy(*own).agg((F.max(F.when(F.col("begin") == 0, F.col("_began"))) - F.max(F.when(F.col("begin") == 1, F.col("_ended"))) - 1).alias("overlaps"))


def run_status(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """``runs(run_id, cancel)`` that go on, over ``jobs(run_id, status)``: Cancelling, Running where a step is claimed, else Pending."""
    claimed = jobs.where("status = 'Claimed'").select("run_id", F.lit(True).alias("_held")).distinct()
    return runs.join(claimed, "run_id", "left").select("run_id", F.when(F.col("cancel"), "Cancelling").when(F.col("_held"), "Running").otherwise("Pending").alias("status"))


def run_cancel(cmds: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """``cmds(run_id)`` over runs that go on: requested while a step is claimed, removed while it waits, else not accepted."""
    live = jobs.where("status IN ('Pending', 'Scheduled', 'Claimed')").groupBy("run_id").agg(F.max(F.col("status") == "Claimed").alias("_held"))
    known = runs.select("run_id").join(live, "run_id", "left").withColumn("how", F.when(F.coalesce("_held", F.lit(True)), "requested").otherwise("removed"))
    return cmds.join(known.select("run_id", "how"), "run_id", "left").select("run_id", F.col("how").isNotNull().alias("accepted"), "how")


def submit_outcome(cmds: DataFrame, durable: DataFrame) -> DataFrame:
    """``cmds(run_id, input_hash)`` against live runs: New, Duplicate, or InputMismatch."""
    d = durable.select("run_id", F.col("input_hash").alias("_h"))
    return cmds.join(d, "run_id", "left").withColumn("outcome", F.when(F.col("_h").isNull(), "New").when(F.col("_h") == F.col("input_hash"), "Duplicate").otherwise("InputMismatch")).drop("_h")


def idempotent_submit(cmds: DataFrame, records: DataFrame, results: DataFrame) -> DataFrame:
    """``cmds(key, input_hash)``: InputMismatch, Cached (a result is stored), or Enqueue anew."""
    r = records.select("key", F.col("input_hash").alias("_h"), "job_id").join(results.select("job_id", F.lit(True).alias("_done")), "job_id", "left")
    return cmds.join(r, "key", "left").withColumn("outcome", F.when(F.col("_h").isNotNull() & (F.col("_h") != F.col("input_hash")), "InputMismatch").when(F.col("_done"), "Cached").otherwise("Enqueue")).drop("_h", "_done")


def dispatch(jobs: DataFrame, handlers: DataFrame, header: str = "type") -> DataFrame:
    """Handler of each job by its type; without header or handler the failure is permanent."""
    h = F.broadcast(handlers.select(F.col("type").alias(header), "handler"))
    return jobs.join(h, header, "left").withColumn("error", F.when(F.col(header).isNull(), "missing type header").when(F.col("handler").isNull(), "unknown job type"))


def job_outcome(runs: DataFrame) -> DataFrame:
    """``runs(ok, kind, attempts, max_attempts)``: what is stored; a transient failure only on the last attempt."""
    terminal = (F.col("kind") == "Permanent") | (F.col("attempts") >= F.col("max_attempts"))
    return runs.withColumns({"stored": F.when(F.col("ok"), "Success").when(terminal, "Failure"), "settle": F.when(F.col("ok"), "ack").when(F.col("kind") == "Permanent", "dead_letter").otherwise("nack")})


def join_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``jobs(id, status, last_error)`` with the stored outcome, else one made up from the last error."""
    r = results.select(F.col("job_id").alias("id"), "outcome")
    ended = F.col("status").isin("Done", "Dead")
    made_up = F.concat(F.lit("transient: "), F.coalesce("last_error", F.lit("job terminated without recording a result")))
    return jobs.join(r, "id", "left").withColumn("joined", F.coalesce("outcome", F.when(ended, made_up)))


def latest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last writer wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def memo_hits(calls: DataFrame, memo: DataFrame, on: list[str]) -> DataFrame:
    """Calls with the stored value; a miss is computed once for each key (``computes``)."""
    hit = calls.join(memo, on, "left")
    first = F.row_number().over(Window.partitionBy(*on).orderBy("call")) == 1
    return hit.withColumns({"hit": F.col("value").isNotNull(), "computes": F.col("value").isNull() & first})
