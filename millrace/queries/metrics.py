"""Counters, percentiles, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import timeline as T
from millrace.registry import query
from millrace.sources import fixtures as X


@query("stats_from_log", f"""WITH {X.ATTEMPTS},
 c AS (SELECT queue, 'pending' AS metric, 1 AS delta FROM jobs UNION ALL SELECT queue, 'pending', -1 FROM attempts UNION ALL SELECT queue, 'pending', 1 FROM attempts WHERE outcome IN ('Retried', 'LeaseExpired')
  UNION ALL SELECT queue, 'claimed', 0 FROM attempts UNION ALL SELECT queue, 'done', 1 FROM attempts WHERE outcome = 'Completed' UNION ALL SELECT queue, 'dead', 1 FROM attempts WHERE outcome = 'DeadLettered'
  UNION ALL SELECT queue, 'scheduled', 0 FROM attempts WHERE outcome = 'Retried' UNION ALL SELECT queue, 'scheduled', 0 FROM jobs WHERE run_at > enqueued_at)
 SELECT queue, metric, CAST(sum(delta) AS BIGINT) AS n FROM c GROUP BY queue, metric""")
def _(spark, sf):
    return M.stats_from_log(M.log_changes(X.jobs(spark, sf), X.attempts(spark, sf)))


@query("queue_metrics", f"""WITH {X.ATTEMPTS}, a AS (SELECT queue, count(*) AS claimed, count(*) FILTER (outcome = 'Completed') AS completed, count(*) FILTER (outcome = 'Retried') AS nacked,
 count(*) FILTER (outcome = 'DeadLettered') AS dead_lettered, count(*) FILTER (outcome = 'LeaseExpired') AS reaped FROM attempts GROUP BY queue)
 SELECT j.queue, j.enqueued, a.claimed, a.completed, a.nacked, a.dead_lettered, a.reaped FROM (SELECT queue, count(*) AS enqueued FROM jobs GROUP BY queue) j JOIN a ON j.queue = a.queue""")
def _(spark, sf):
    return M.queue_metrics(X.jobs(spark, sf), X.attempts(spark, sf))


@query("latency_histogram", f"WITH {X.ATTEMPTS} SELECT queue, " + ", ".join(f"count(*) FILTER ((claimed_at - enqueued_at) / 1000.0 <= {b}) AS le_{b:g}" for b in (1, 10, 60, 600, 3600)) + ", count(*) AS n FROM attempts GROUP BY queue")
def _(spark, sf):
    a = X.attempts(spark, sf).withColumn("s", (F.col("claimed_at") - F.col("enqueued_at")) / 1000.0)
    return M.histogram(a, ["queue"], "s", [1, 10, 60, 600, 3600])


@query("queue_depth", f"WITH {X.STATE} SELECT coalesce(queue, '*') AS queue, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Claimed') AS claimed FROM state GROUP BY ROLLUP (queue)")
def _(spark, sf):
    c = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return X.state(spark, sf).rollup("queue").agg(c("Pending"), c("Claimed")).select(F.coalesce("queue", F.lit("*")).alias("queue"), "pending", "claimed")


@query("oldest_pending_age", f"WITH {X.STATE}, r AS (SELECT queue, enqueued_at, row_number() OVER (PARTITION BY queue ORDER BY priority, id) AS rn FROM state WHERE status = 'Pending') SELECT q.queue, CASE WHEN r.queue IS NULL THEN 0.0::DOUBLE ELSE greatest({X.AS_OF} - r.enqueued_at, 0) / 1000.0::DOUBLE END AS age_s FROM (SELECT DISTINCT queue FROM state) q LEFT JOIN r ON q.queue = r.queue AND rn = 1")
def _(spark, sf):
    return M.oldest_pending_age(X.state(spark, sf), X.AS_OF)


def pct(value: str, by: str, rel: str, ps=(50, 95, 99)) -> str:
    """Nearest-rank percentiles in DuckDB."""
    part = f"PARTITION BY {by}" if by else ""
    pick = ", ".join(f"max({value}) FILTER (rn - 1 = least(n * {p} // 100, n - 1)) AS p{p}" for p in ps)
    head = f"{by}, " if by else ""
    return f"SELECT {head}max(n) AS n, {pick} FROM (SELECT *, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {rel})" + (f" GROUP BY {by}" if by else "")


@query("pct_by_queue", f"WITH {X.ATTEMPTS} {pct('occ', 'queue', 'attempts')}")
def _(spark, sf):
    return M.nearest_rank(X.attempts(spark, sf), ["queue"], "occ", [50, 95, 99])


_CLAIMS = "claims AS (SELECT (claimed_at - (SELECT min(claimed_at) FROM attempts)) // 3600000 AS win, claimed_at - enqueued_at AS wait FROM attempts WHERE attempt = 1)"


def _claims(spark, sf):
    a = X.attempts(spark, sf)
    t0 = a.agg(F.min("claimed_at").alias("t0"))
    return a.where("attempt = 1").crossJoin(F.broadcast(t0)).select(F.expr("(claimed_at - t0) div 3600000").alias("win"), (F.col("claimed_at") - F.col("enqueued_at")).alias("wait"))


@query("claim_drain_windows", f"WITH {X.ATTEMPTS}, {_CLAIMS} {pct('wait', 'win', 'claims')}")
def _(spark, sf):
    return M.nearest_rank(_claims(spark, sf), ["win"], "wait", [50, 95, 99])


@query("cold_start_summary", f"WITH {X.ATTEMPTS}, o AS (SELECT queue, occ, row_number() OVER (PARTITION BY queue ORDER BY claimed_at, id) AS k FROM attempts), warm AS (SELECT queue, occ FROM o WHERE k > 1), w AS ({pct('occ', 'queue', 'warm', (50, 99))}) SELECT w.queue, f.occ AS first_ms, w.n, w.p50, w.p99 FROM w JOIN o f ON w.queue = f.queue AND f.k = 1")
def _(spark, sf):
    a = X.attempts(spark, sf)
    first = a.groupBy("queue").agg(F.min(F.struct("claimed_at", "id", "attempt", "occ")).alias("f"))
    warm = a.join(F.broadcast(first), "queue").where("NOT (id = f.id AND attempt = f.attempt)").select("queue", "occ")
    return M.nearest_rank(warm, ["queue"], "occ", [50, 99]).join(first.select("queue", F.col("f.occ").alias("first_ms")), "queue")


_ENDS = "ends AS (SELECT recorded_at // 21600000 AS win, recorded_at - enqueued_at AS e2e FROM attempts WHERE outcome = 'Completed')"


@query("steady_state_windows", f"""WITH {X.ATTEMPTS}, {_ENDS}, e AS (SELECT enqueued_at // 21600000 AS win, count(*) AS enqueued FROM jobs GROUP BY 1), d AS ({pct('e2e', 'win', 'ends')}),
 c AS (SELECT claimed_at // 21600000 AS win, count(*) AS claims FROM attempts GROUP BY 1)
 SELECT win, coalesce(enqueued, 0) AS enqueued, coalesce(n, 0) AS done, coalesce(p50, 0) AS e2e_p50, coalesce(p95, 0) AS e2e_p95, coalesce(p99, 0) AS e2e_p99, coalesce(claims, 0) AS claims FROM e FULL JOIN d USING (win) FULL JOIN c USING (win)""")
def _(spark, sf):
    j, a = X.jobs(spark, sf), X.attempts(spark, sf)
    win = lambda c: F.expr(f"{c} div 21600000").alias("win")
    e = j.groupBy(win("enqueued_at")).agg(F.count("*").alias("enqueued"))
    d = M.nearest_rank(a.where("outcome = 'Completed'").select(win("recorded_at"), (F.col("recorded_at") - F.col("enqueued_at")).alias("e2e")), ["win"], "e2e", [50, 95, 99])
    c = a.groupBy(win("claimed_at")).agg(F.count("*").alias("claims"))
    out = e.join(d, "win", "full").join(c, "win", "full").na.fill(0)
    return out.select("win", "enqueued", F.col("n").alias("done"), *[F.col(f"p{p}").alias(f"e2e_p{p}") for p in (50, 95, 99)], "claims")


@query("payload_sweep", f"""WITH {X.ATTEMPTS}, s AS (SELECT CASE WHEN n_chars < 1024 THEN 64 WHEN n_chars < 4096 THEN 1024 WHEN n_chars < 16384 THEN 4096 ELSE 16384 END::BIGINT AS payload_bytes, strlen(text) AS size, doc_id FROM documents),
 g AS (SELECT s.payload_bytes, count(*) AS puts, count(DISTINCT a.id) AS jobs, CAST(sum(s.size) AS BIGINT) AS stored FROM attempts a JOIN s ON a.doc_id = s.doc_id GROUP BY s.payload_bytes)
 SELECT payload_bytes, jobs, puts, stored // jobs AS bytes_per_job, round(stored / (jobs * payload_bytes)::DOUBLE, 4) AS store_amp, round(puts / jobs::DOUBLE, 4) AS puts_per_job FROM g""")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN n_chars < 1024 THEN 64L WHEN n_chars < 4096 THEN 1024L WHEN n_chars < 16384 THEN 4096L ELSE 16384L END AS payload_bytes"), F.octet_length("text").cast("bigint").alias("size"))
    # a job's attempts are summed before the join, so no document row is multiplied by them
    a = X.attempts(spark, sf).groupBy("doc_id", "id").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sum("c").alias("puts"), F.count("*").alias("jobs"))
    g = a.join(d, "doc_id").groupBy("payload_bytes").agg(F.sum("puts").alias("puts"), F.sum("jobs").alias("jobs"), F.sum(F.col("size") * F.col("puts")).alias("stored"))
    return g.select("payload_bytes", "jobs", "puts", F.expr("stored div jobs AS bytes_per_job"), F.round(F.col("stored") / (F.col("jobs") * F.col("payload_bytes")), 4).alias("store_amp"), F.round(F.col("puts") / F.col("jobs"), 4).alias("puts_per_job"))


@query("shard_balance", f"WITH {X.ATTEMPTS}, s AS (SELECT user_id % 8 AS shard, recorded_at // 86400000 AS day FROM attempts) SELECT shard, day, count(*) AS n FROM s GROUP BY GROUPING SETS ((shard), (day), (shard, day), ())")
def _(spark, sf):
    a = X.attempts(spark, sf).select(F.expr("user_id % 8 AS shard"), F.expr("recorded_at div 86400000 AS day"))
    return a.groupingSets([["shard"], ["day"], ["shard", "day"], []], "shard", "day").agg(F.count("*").alias("n"))


_STORM = "held AS (SELECT (claimed_at // 3600000) AS win, count(*) AS held FROM attempts WHERE overrun GROUP BY 1), live AS (SELECT (recorded_at // 3600000) AS win, count(*) AS live FROM attempts WHERE NOT overrun GROUP BY 1)"


@query("reaper_storm_windows", f"WITH {X.ATTEMPTS}, {_STORM} SELECT win, coalesce(held, 0) AS held, coalesce(live, 0) AS live FROM held FULL JOIN live USING (win)")
def _(spark, sf):
    a = X.attempts(spark, sf)
    held = a.where("overrun").groupBy(F.expr("claimed_at div 3600000").alias("win")).agg(F.count("*").alias("held"))
    live = a.where("NOT overrun").groupBy(F.expr("recorded_at div 3600000").alias("win")).agg(F.count("*").alias("live"))
    return held.join(live, "win", "full").na.fill(0)


@query("reaper_storm_summary", f"WITH {X.ATTEMPTS}, s AS (SELECT queue, count(*) AS reaped, min(recorded_at) AS t0, max(recorded_at) AS t1 FROM attempts WHERE outcome = 'LeaseExpired' GROUP BY queue) SELECT queue, reaped, (t1 - t0) // 1000 AS secs, reaped * 3600 // greatest((t1 - t0) // 1000, 1) AS per_hour FROM s")
def _(spark, sf):
    s = X.attempts(spark, sf).where("outcome = 'LeaseExpired'").groupBy("queue").agg(F.count("*").alias("reaped"), F.min("recorded_at").alias("t0"), F.max("recorded_at").alias("t1"))
    return s.select("queue", "reaped", F.expr("(t1 - t0) div 1000 AS secs"), F.expr("reaped * 3600 div greatest((t1 - t0) div 1000, 1L) AS per_hour"))


# ---------------------------------------------------------------- order


@query("claim_order", f"WITH {X.STATE} SELECT id, queue, priority, row_number() OVER (PARTITION BY queue ORDER BY priority, id) AS rank FROM state WHERE status = 'Pending'")
def _(spark, sf):
    return T.claim_order(X.state(spark, sf)).select("id", "queue", "priority", "rank")


@query("claim_batch", f"WITH {X.STATE}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority, id) AS rank FROM state WHERE status = 'Pending') SELECT id, queue, 'Claimed' AS status, attempts + 1 AS attempts, {X.AS_OF}::BIGINT AS claimed_at, CAST(NULL AS VARCHAR) AS dedup_key FROM r WHERE rank <= 16")
def _(spark, sf):
    from millrace.operators import transitions as Z

    return Z.claim(X.state(spark, sf), 16, X.AS_OF).where("claimed_now").select("id", "queue", "status", "attempts", "claimed_at", "dedup_key")


_STEPS = "samples AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS step, epoch_us(l_shipdate) // 1000 AS elapsed FROM lineitem)"


def steps(spark, sf):
    return X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("step"), X.millis("l_shipdate").alias("elapsed"))


@query("step_transitions", f"WITH {_STEPS}, m AS (SELECT run_id, step, min(elapsed) AS elapsed FROM samples GROUP BY run_id, step) SELECT run_id, step, elapsed - lag(elapsed) OVER (PARTITION BY run_id ORDER BY step) AS latency FROM m")
def _(spark, sf):
    return T.step_latency(steps(spark, sf)).select("run_id", "step", "latency")


@query("run_e2e", f"WITH {_STEPS}, m AS (SELECT run_id, step, min(elapsed) AS elapsed, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS k FROM samples GROUP BY run_id, step) SELECT m.run_id, m.step AS last_step, greatest(m.elapsed - epoch_us(o.o_orderdate) // 1000, 0) AS e2e_ms FROM m JOIN orders o ON o.o_orderkey = m.run_id WHERE m.k = 1")
def _(spark, sf):
    return T.run_e2e(steps(spark, sf), X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), X.millis("o_orderdate").alias("submitted_at")))


@query("retry_timeline", f"WITH {X.ATTEMPTS} SELECT id, attempt, claimed_at - min(claimed_at) OVER (PARTITION BY id) AS waited FROM attempts")
def _(spark, sf):
    return T.retry_timeline(X.attempts(spark, sf)).select("id", "attempt", "waited")


_CH = """ch AS (SELECT id, queue, enqueued_at AS at_ms, 0 AS seq, 'Waiting' AS state FROM jobs UNION ALL SELECT id, queue, claimed_at, attempt * 2, 'Claimed' FROM attempts
 UNION ALL SELECT id, queue, recorded_at, attempt * 2 + 1, CASE outcome WHEN 'Completed' THEN 'Done' WHEN 'DeadLettered' THEN 'Dead' ELSE 'Waiting' END FROM attempts)"""


def _changes(spark, sf):
    j = X.jobs(spark, sf).select("id", "queue", F.col("enqueued_at").alias("at_ms"), F.lit(0).cast("bigint").alias("seq"), F.lit("Waiting").alias("state"))
    a = X.attempts(spark, sf)
    c = a.select("id", "queue", F.col("claimed_at").alias("at_ms"), (F.col("attempt") * 2).alias("seq"), F.lit("Claimed").alias("state"))
    e = a.select("id", "queue", F.col("recorded_at").alias("at_ms"), (F.col("attempt") * 2 + 1).alias("seq"), F.expr("CASE outcome WHEN 'Completed' THEN 'Done' WHEN 'DeadLettered' THEN 'Dead' ELSE 'Waiting' END AS state"))
    return j.unionByName(c).unionByName(e)


@query("state_durations", f"WITH {X.ATTEMPTS}, {_CH}, l AS (SELECT queue, state, lead(at_ms) OVER (PARTITION BY id ORDER BY at_ms, seq) - at_ms AS ms FROM ch) SELECT queue, state, count(ms) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS longest_ms FROM l GROUP BY queue, state")
def _(spark, sf):
    d = T.state_durations(_changes(spark, sf))
    return d.groupBy("queue", "state").agg(F.count("lasted_ms").alias("n"), F.sum("lasted_ms").alias("total_ms"), F.max("lasted_ms").alias("longest_ms"))


@query("running_depth", f"""WITH {X.ATTEMPTS}, e AS (SELECT queue, enqueued_at AS at_ms, event_id * 2 AS seq, 1 AS delta FROM jobs UNION ALL SELECT a.queue, a.recorded_at, CAST(a.id AS BIGINT) * 2 + 1, -1 FROM attempts a WHERE outcome IN ('Completed', 'DeadLettered'))
 SELECT queue, at_ms, seq, CAST(sum(delta) OVER (PARTITION BY queue ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM e""")
def _(spark, sf):
    j = X.jobs(spark, sf).select("queue", F.col("enqueued_at").alias("at_ms"), (F.col("event_id") * 2).alias("seq"), F.lit(1).cast("bigint").alias("delta"))
    a = X.attempts(spark, sf).where("outcome IN ('Completed', 'DeadLettered')").select("queue", F.col("recorded_at").alias("at_ms"), (F.col("id").cast("bigint") * 2 + 1).alias("seq"), F.lit(-1).cast("bigint").alias("delta"))
    return T.running_depth(j.unionByName(a)).select("queue", "at_ms", "seq", "depth")
