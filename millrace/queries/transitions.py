"""Transitions over the sample state."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import inspect as I
from millrace.operators import transitions as Z
from millrace.registry import query
from millrace.sources import fixtures as X

NOW = X.AS_OF
_SC = f"WITH {X.STATE}, {X.CONFIGS}, sc AS (SELECT s.*, CASE WHEN c.queue IS NULL THEN 1000 ELSE c.base_ms END AS base_ms, CASE WHEN c.queue IS NULL THEN 300000 ELSE c.max_ms END AS max_ms, c.keep_done_ms, CASE WHEN c.queue IS NULL THEN 604800000 ELSE c.dead_retention_ms END AS dead_retention_ms FROM state s LEFT JOIN config c ON s.queue = c.queue)"


def configured(spark, sf):
    return I.effective_config(X.state(spark, sf), X.config(spark))


_CMD = "cmds AS (SELECT 'new-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id, queue, CAST(user_id AS VARCHAR) AS dedup_key, priority, CASE WHEN k % 5 = 0 THEN {n} + k * 1000 - 20000 END AS run_at, {n}::BIGINT AS now, k FROM jobs)".format(n=NOW)


def _cmds(spark, sf):
    j = X.jobs(spark, sf)
    return j.select(F.concat(F.lit("new-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"), "queue", F.expr("CAST(user_id AS STRING) AS dedup_key"), "priority", F.expr(f"CASE WHEN k % 5 = 0 THEN {NOW} + k * 1000 - 20000 END AS run_at"), F.lit(NOW).alias("now"), "k")


_HELD = "held AS (SELECT queue, CAST(user_id AS VARCHAR) AS dedup_key, min(id) AS existing FROM state WHERE status IN ('Pending', 'Scheduled') AND attempts = 0 GROUP BY 1, 2)"


def _keyed(spark, sf):
    return X.state(spark, sf).withColumn("dedup_key", F.expr("CASE WHEN attempts = 0 THEN CAST(user_id AS STRING) END"))


@query("enqueue_state", f"WITH {X.STATE}, {_CMD}, {_HELD} SELECT c.id, c.queue, CASE WHEN run_at > now THEN 'Scheduled' ELSE 'Pending' END AS status, CASE WHEN run_at > now THEN run_at END AS run_at, c.priority FROM cmds c LEFT JOIN held h ON c.queue = h.queue AND c.dedup_key = h.dedup_key WHERE h.existing IS NULL")
def _(spark, sf):
    jobs = _keyed(spark, sf).select("id", "queue", "status", "run_at", "priority", "dedup_key")
    return Z.enqueue(jobs, _cmds(spark, sf)).where("id LIKE 'new-%'").select("id", "queue", "status", "run_at", "priority")


@query("enqueue_with_kv", f"WITH {X.STATE}, {_CMD}, {_HELD} SELECT 'app/jobs/' || c.id AS key, c.queue AS value FROM cmds c LEFT JOIN held h ON c.queue = h.queue AND c.dedup_key = h.dedup_key WHERE h.existing IS NULL")
def _(spark, sf):
    new = Z.dedup_against(_keyed(spark, sf), _cmds(spark, sf)).where("outcome = 'New'")
    return new.select(F.concat(F.lit("app/jobs/"), F.col("id")).alias("key"), F.col("queue").alias("value"))


@query("enqueue_batch", f"WITH {X.JOBS} SELECT queue, lpad(CAST(row_number() OVER (PARTITION BY queue ORDER BY event_id) - 1 AS VARCHAR), 26, '0') AS id, 'Pending' AS status, {NOW}::BIGINT AS enqueued_at, doc_id FROM jobs")
def _(spark, sf):
    from millrace.operators.ordered import running

    at = running(X.jobs(spark, sf), ["queue"], F.expr("event_id div 4096"), ["event_id"], F.lit(1).cast("bigint"), "at")
    return at.select("queue", F.lpad((F.col("at") - 1).cast("string"), 26, "0").alias("id"), F.lit("Pending").alias("status"), F.lit(NOW).alias("enqueued_at"), "doc_id")


@query("dedup_outcome", f"""WITH RECURSIVE {X.ATTEMPTS},
 c AS (SELECT j.id, j.queue, j.queue || '/' || CAST(j.user_id AS VARCHAR) AS kk, j.enqueued_at, a.claimed_at, row_number() OVER (PARTITION BY j.queue, j.user_id ORDER BY j.enqueued_at, j.id) AS rn FROM jobs j JOIN attempts a ON a.id = j.id AND a.attempt = 1),
 f AS (SELECT kk, rn, id, id AS held_by, claimed_at AS until_ms, 'New' AS outcome, CAST(NULL AS VARCHAR) AS existing FROM c WHERE rn = 1
  UNION ALL SELECT c.kk, c.rn, c.id, CASE WHEN c.enqueued_at < f.until_ms THEN f.held_by ELSE c.id END, CASE WHEN c.enqueued_at < f.until_ms THEN f.until_ms ELSE c.claimed_at END, CASE WHEN c.enqueued_at < f.until_ms THEN 'AlreadyEnqueued' ELSE 'New' END, CASE WHEN c.enqueued_at < f.until_ms THEN f.held_by END
  FROM f JOIN c ON c.kk = f.kk AND c.rn = f.rn + 1)
 SELECT id, outcome, existing FROM f""")
def _(spark, sf):
    first = X.attempts(spark, sf).where("attempt = 1").select("id", "claimed_at")
    cmds = X.jobs(spark, sf).select("id", "queue", F.col("user_id").cast("string").alias("dedup_key"), "enqueued_at").join(first, "id")
    return Z.fold_dedup(cmds).select("id", "outcome", "existing")


@query("duplicate_id_rejects", f"WITH {X.STATE}, c AS (SELECT CASE WHEN k % 2 = 0 THEN id ELSE 'fresh-' || event_id END AS id, queue FROM jobs) SELECT c.id, c.queue, CASE WHEN s.id IS NOT NULL THEN 'DuplicateJobId' ELSE 'New' END AS outcome FROM c LEFT JOIN state s ON c.id = s.id")
def _(spark, sf):
    c = X.jobs(spark, sf).select(F.expr("CASE WHEN k % 2 = 0 THEN id ELSE 'fresh-' || event_id END AS id"), "queue", F.lit(None).cast("string").alias("dedup_key"))
    return Z.dedup_against(X.state(spark, sf).select("id", "queue", "status", "dedup_key"), c).select("id", "queue", "outcome")


_SET = "se AS (SELECT id, CASE WHEN k % 3 = 0 THEN claim_token + 1 ELSE claim_token END AS token FROM state WHERE status = 'Claimed' UNION ALL SELECT id, event_id * 7 + attempts AS token FROM state WHERE status = 'Done')"


def _settlements(spark, sf):
    s = X.state(spark, sf)
    return s.where("status = 'Claimed'").select("id", F.expr("CASE WHEN k % 3 = 0 THEN claim_token + 1 ELSE claim_token END AS token")).unionByName(s.where("status = 'Done'").select("id", F.expr("event_id * 7 + attempts AS token")))


@query("settlement_fence", f"WITH {X.STATE}, {_SET} SELECT se.id, se.token, CASE WHEN s.id IS NULL THEN 'ClaimLost' ELSE 'Current' END AS fence FROM se LEFT JOIN state s ON se.id = s.id AND s.status = 'Claimed' AND s.claim_token = se.token")
def _(spark, sf):
    return Z.fenced(X.state(spark, sf), _settlements(spark, sf)).select("id", "token", "fence")


@query("ack_settle", f"{_SC} SELECT id, queue, CASE WHEN keep_done_ms IS NOT NULL THEN 'Done' END AS status, CASE WHEN keep_done_ms IS NOT NULL THEN {NOW}::BIGINT END AS completed_at, CASE WHEN keep_done_ms IS NOT NULL THEN 'Completed' END AS history, 1::BIGINT AS done_delta FROM sc WHERE status = 'Claimed'")
def _(spark, sf):
    return Z.ack(configured(spark, sf).where("status = 'Claimed'"), NOW).select("id", "queue", "status", "completed_at", "history", "done_delta")


@query("nack_settle", f"""{_SC}, b AS (SELECT *, least(base_ms * CAST(pow(2, attempts - 1) AS BIGINT), max_ms) AS wait FROM sc WHERE status = 'Claimed')
 SELECT id, CASE WHEN attempts >= max_attempts THEN 'Dead' ELSE 'Scheduled' END AS status, CASE WHEN attempts < max_attempts THEN {NOW} + wait END AS run_at, CASE WHEN attempts >= max_attempts THEN claimed_at END AS claimed_at,
 CASE WHEN attempts >= max_attempts THEN {NOW}::BIGINT END AS failed_at, 'boom' AS last_error, CASE WHEN attempts >= max_attempts THEN 'DeadLettered' ELSE 'Retried' END AS outcome FROM b""")
def _(spark, sf):
    return Z.nack(configured(spark, sf).where("status = 'Claimed'"), NOW, "boom").select("id", "status", "run_at", "claimed_at", "failed_at", "last_error", "outcome")


@query("dead_letter_settle", f"{_SC} SELECT id, 'Dead' AS status, CAST(NULL AS BIGINT) AS claimed_at, {NOW}::BIGINT AS failed_at, 'bad input' AS last_error, attempts FROM sc WHERE status = 'Claimed'")
def _(spark, sf):
    return Z.dead_letter(configured(spark, sf).where("status = 'Claimed'"), NOW, "bad input").select("id", "status", "claimed_at", "failed_at", "last_error", "attempts")


_CAN = "ca AS (SELECT CASE WHEN v % 11 = 0 THEN 'gone-' || event_id ELSE id END AS id FROM jobs)"


def _some(spark, sf):
    return X.jobs(spark, sf).select(F.expr("CASE WHEN v % 11 = 0 THEN 'gone-' || event_id ELSE id END AS id"))


@query("cancel_outcome", f"WITH {X.STATE}, {_CAN} SELECT ca.id, s.status, CASE WHEN s.status IN ('Pending', 'Scheduled') THEN 'Removed' WHEN s.status = 'Claimed' THEN 'Requested' ELSE 'NotFound' END AS outcome FROM ca LEFT JOIN state s ON ca.id = s.id")
def _(spark, sf):
    return Z.cancel(X.state(spark, sf), _some(spark, sf)).select("id", "status", "outcome")


@query("wake_outcome", f"WITH {X.STATE}, {_CAN} SELECT ca.id, s.status, CASE WHEN s.status = 'Scheduled' THEN 'Woken' WHEN s.status IS NULL THEN 'NotFound' ELSE 'NotScheduled' END AS outcome FROM ca LEFT JOIN state s ON ca.id = s.id")
def _(spark, sf):
    return Z.wake(X.state(spark, sf), _some(spark, sf)).select("id", "status", "outcome")


@query("requeue_dead", f"WITH {X.STATE} SELECT id, queue, 'Pending' AS status, 0::BIGINT AS attempts, CAST(NULL AS BIGINT) AS failed_at, enqueued_at, 'Requeued' AS history FROM state WHERE status = 'Dead'")
def _(spark, sf):
    return Z.requeue_dead(X.state(spark, sf).where("status = 'Dead'")).select("id", "queue", "status", "attempts", "failed_at", "enqueued_at", "history")


@query("promote_due", f"WITH {X.STATE} SELECT id, queue, 'Pending' AS status, CAST(NULL AS BIGINT) AS run_at FROM state WHERE status = 'Scheduled' AND run_at <= {NOW}")
def _(spark, sf):
    return Z.promote(X.state(spark, sf), NOW).where("promoted").select("id", "queue", "status", "run_at")


def _reap(name: str, text: str, history: str, where: str):
    @query(name, f"WITH {X.STATE} SELECT id, CASE WHEN attempts >= max_attempts THEN 'Dead' ELSE 'Pending' END AS status, CASE WHEN attempts >= max_attempts THEN claimed_at END AS claimed_at, CASE WHEN attempts >= max_attempts THEN {NOW}::BIGINT END AS failed_at, CASE WHEN attempts >= max_attempts THEN '{text}' ELSE last_error END AS last_error, CASE WHEN attempts >= max_attempts THEN 'DeadLettered' ELSE '{history}' END AS history FROM state WHERE {where}")
    def run(spark, sf):
        return Z.reap(X.state(spark, sf).where(where), NOW, text, history).select("id", "status", "claimed_at", "failed_at", "last_error", "history")


_reap("reap_expired", "lease expired", "LeaseExpired", f"status = 'Claimed' AND lease_expires_at <= {NOW}")
_reap("open_requeue", "claim interrupted by process exit", "Interrupted", "status = 'Claimed'")

_LATE = NOW + 10_500_000_000
_EXP = f"((status = 'Done' AND completed_at < {_LATE} - keep_done_ms) OR (status = 'Dead' AND failed_at < {_LATE} - dead_retention_ms))"
_DONE = f"status = 'Done' AND completed_at < {NOW} - keep_done_ms"


@query("expired_done", f"{_SC} SELECT id, queue, completed_at FROM sc WHERE {_DONE}")
def _(spark, sf):
    return Z.expired(configured(spark, sf), NOW).where("status = 'Done'").select("id", "queue", "completed_at")


@query("expired_dead", f"{_SC} SELECT id, queue, failed_at FROM sc WHERE status = 'Dead' AND failed_at < {NOW} - dead_retention_ms")
def _(spark, sf):
    return Z.expired(configured(spark, sf), NOW).where("status = 'Dead'").select("id", "queue", "failed_at")


@query("after_sweep", f"{_SC} SELECT queue, status, count(*) AS n FROM sc WHERE NOT coalesce(({_EXP.replace(str(_LATE), str(NOW))}), false) GROUP BY queue, status")
def _(spark, sf):
    c = configured(spark, sf)
    return Z.after_sweep(c, Z.expired(c, NOW)).groupBy("queue", "status").agg(F.count("*").alias("n"))


@query("history_after_sweep", f"{_SC}, gone AS (SELECT id FROM sc WHERE ({_EXP.replace(str(_LATE), str(NOW))})) SELECT a.queue, a.outcome, count(*) AS n FROM attempts a LEFT JOIN gone ON a.id = gone.id WHERE gone.id IS NULL GROUP BY a.queue, a.outcome")
def _(spark, sf):
    left = Z.after_sweep(X.attempts(spark, sf), Z.expired(configured(spark, sf), NOW))
    return left.groupBy("queue", "outcome").agg(F.count("*").alias("n"))


@query("wait_outcome", f"WITH {X.ATTEMPTS}, w AS (SELECT CASE WHEN v % 13 = 0 THEN 'none-' || event_id ELSE id END AS id, enqueued_at + 5000 AS until_ms FROM jobs), e AS (SELECT id, max(recorded_at) AS done_at FROM attempts GROUP BY id) SELECT w.id, CASE WHEN e.id IS NULL THEN 'NotFound' WHEN e.done_at <= w.until_ms THEN 'Completed' ELSE 'TimedOut' END AS outcome FROM w LEFT JOIN e ON w.id = e.id")
def _(spark, sf):
    w = X.jobs(spark, sf).select(F.expr("CASE WHEN v % 13 = 0 THEN 'none-' || event_id ELSE id END AS id"), F.expr("enqueued_at + 5000 AS until"))
    e = X.attempts(spark, sf).groupBy("id").agg(F.max("recorded_at").alias("done_at")).withColumn("_known", F.lit(True))
    return Z.wait_outcome(e, w).select("id", "outcome")


@query("lease_extend", f"WITH {X.STATE} SELECT id, greatest(lease_expires_at, claimed_at + 10000 + v % 40000 + 5000) AS lease_expires_at FROM state WHERE status = 'Claimed'")
def _(spark, sf):
    s = X.state(spark, sf).where("status = 'Claimed'")
    return s.select("id", S.lease_extended("lease_expires_at", F.col("claimed_at") + 10_000, F.col("v") % 40_000).alias("lease_expires_at"))


@query("lease_renew", f"WITH {X.STATE}, {_SET} SELECT se.id, s.claimed_at + 12000 AS lease_expires_at, s.id IS NOT NULL AS renewed FROM se LEFT JOIN state s ON se.id = s.id AND s.status = 'Claimed' AND s.claim_token = se.token")
def _(spark, sf):
    f = Z.fenced(X.state(spark, sf), _settlements(spark, sf))
    s = X.state(spark, sf).select("id", "claimed_at")
    ok = F.col("fence") == "Current"
    return f.join(s, "id", "left").select("id", F.when(ok, F.col("claimed_at") + 12_000).alias("lease_expires_at"), ok.alias("renewed"))
