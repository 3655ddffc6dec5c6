"""Runs, signals, memo entries, typed jobs, bulk items and the key-value namespace over sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import bulk as B
from millrace.operators import kv as K
from millrace.operators import workflow as W
from millrace.registry import query
from millrace.sources import fixtures as X

NOW, DAY = X.AS_OF, 86_400_000

_KIND = "CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN 'Cancel' WHEN 1 THEN 'Fail' WHEN 2 THEN 'Permanent' WHEN 3 THEN 'Transient' WHEN 4 THEN 'Succeed' WHEN 5 THEN 'After' WHEN 6 THEN 'OnSignal' ELSE 'Continue' END"
_STEP = f"st AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS step, l_partkey AS part, {_KIND} AS kind, 'm' || l_partkey AS message, 1 + l_partkey % 3 AS attempts, 3::BIGINT AS max_attempts, l_discount = 0.05 AS external_cancel, l_suppkey * 1000 AS delay_ms FROM lineitem)"
_DEC = _STEP + """, dec AS (SELECT *, CASE WHEN kind = 'Cancel' OR external_cancel THEN 'cancelled' WHEN kind = 'Succeed' THEN 'succeeded' WHEN kind IN ('Fail', 'Permanent') OR (kind = 'Transient' AND attempts >= max_attempts) THEN 'failed' END AS status,
 CASE WHEN kind = 'Cancel' OR external_cancel THEN 'ack' WHEN kind = 'Permanent' THEN 'dead_letter' WHEN kind = 'Transient' THEN 'nack' ELSE 'ack' END AS settle,
 CASE WHEN kind = 'Cancel' THEN message WHEN external_cancel THEN NULL WHEN kind IN ('Fail', 'Permanent') OR (kind = 'Transient' AND attempts >= max_attempts) THEN message END AS error,
 CASE WHEN kind <> 'Cancel' AND NOT external_cancel AND kind IN ('Continue', 'After', 'OnSignal') THEN step + 1 END AS next_step,
 kind = 'Cancel' OR (NOT external_cancel AND kind NOT IN ('Transient', 'Permanent')) AS keep_effects FROM st)"""


def _decided(spark, sf):
    li = X.table(spark, sf, "lineitem")
    st = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("step"), F.col("l_partkey").alias("part"), F.expr(_KIND).alias("kind"), F.expr("'m' || l_partkey AS message"), F.expr("1 + l_partkey % 3 AS attempts"), F.lit(3).cast("bigint").alias("max_attempts"), (F.col("l_discount") == 0.05).alias("external_cancel"), (F.col("l_suppkey") * 1000).alias("delay_ms"))
    return W.decide(st)


@query("step_decision", f"WITH {_DEC} SELECT run_id, step, part, status, settle, error, next_step, keep_effects FROM dec")
def _(spark, sf):
    return _decided(spark, sf).select("run_id", "step", "part", "status", "settle", "error", "next_step", "keep_effects")


@query("step_advance", f"WITH {_DEC} SELECT run_id, next_step AS step, 'run:' || run_id || ':' || next_step AS dedup_key, CASE WHEN kind = 'After' THEN {NOW} + delay_ms END AS run_at, max_attempts FROM dec WHERE next_step IS NOT NULL")
def _(spark, sf):
    return W.next_steps(_decided(spark, sf), NOW)


@query("run_terminate", f"""WITH {_DEC}, t AS (SELECT run_id, status FROM dec WHERE status IS NOT NULL) SELECT run_id, status, 'kv_delete' AS effect, 'workflow/runs/' || run_id AS key FROM t UNION ALL SELECT run_id, status, 'kv_write', 'workflow/terminals/' || lpad('{NOW}', 20, '0') || '/' || run_id FROM t UNION ALL SELECT run_id, status, 'enqueue', 'run:' || run_id || ':terminal' FROM t""")
def _(spark, sf):
    return W.termination(_decided(spark, sf), NOW)


@query("run_notifications", f"WITH {_DEC} SELECT run_id, status, count(*) AS deliveries FROM dec WHERE status IN ('failed', 'cancelled') GROUP BY run_id, status")
def _(spark, sf):
    t = W.termination(_decided(spark, sf), NOW).where("effect = 'enqueue' AND status IN ('failed', 'cancelled')")
    return t.groupBy("run_id", "status").agg(F.count("*").alias("deliveries"))


# live orders are runs; a line of such an order is a step, of which the last stands for the run's job
_RUN = "ru AS (SELECT o_orderkey AS run_id, o_custkey % 10 = 0 AS cancel FROM orders WHERE o_orderstatus = 'O'), rj AS (SELECT l_orderkey AS run_id, arg_max(CASE l_suppkey % 4 WHEN 0 THEN 'Claimed' WHEN 1 THEN 'Scheduled' ELSE 'Pending' END, l_linenumber * 1000000 + l_suppkey) AS status FROM lineitem GROUP BY 1)"


def _live_runs(spark, sf):
    runs = X.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10 == 0).alias("cancel"))
    status = F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'Claimed' WHEN 1 THEN 'Scheduled' ELSE 'Pending' END")
    jobs = X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max_by(status, F.struct("l_linenumber", "l_suppkey")).alias("status"))
    return runs, jobs


@query("run_status", f"WITH {_RUN} SELECT ru.run_id, CASE WHEN ru.cancel THEN 'Cancelling' WHEN rj.status = 'Claimed' THEN 'Running' ELSE 'Pending' END AS status FROM ru LEFT JOIN rj ON ru.run_id = rj.run_id")
def _(spark, sf):
    return W.run_status(*_live_runs(spark, sf))


@query("run_cancel", f"WITH {_RUN}, c AS (SELECT c_custkey * 3 AS run_id FROM customer) SELECT c.run_id, ru.run_id IS NOT NULL AS accepted, CASE WHEN ru.run_id IS NULL THEN NULL WHEN rj.status IN ('Pending', 'Scheduled') THEN 'removed' ELSE 'requested' END AS how FROM c LEFT JOIN ru ON ru.run_id = c.run_id LEFT JOIN rj ON rj.run_id = c.run_id")
def _(spark, sf):
    return W.run_cancel(X.table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("run_id")), *_live_runs(spark, sf))


@query("run_submit_outcome", "WITH c AS (SELECT c_custkey AS run_id, sha256(CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 'in' || c_custkey END) AS h FROM customer), d AS (SELECT o_orderkey AS run_id, sha256('in' || o_orderkey) AS h FROM orders WHERE o_orderstatus = 'O') SELECT c.run_id, CASE WHEN d.h IS NULL THEN 'New' WHEN d.h = c.h THEN 'Duplicate' ELSE 'InputMismatch' END AS outcome FROM c LEFT JOIN d ON c.run_id = d.run_id")
def _(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), S.sha256_hex(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 'in' || c_custkey END")).alias("input_hash"))
    d = X.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("run_id"), S.sha256_hex(F.expr("'in' || o_orderkey")).alias("input_hash"))
    return W.submit_outcome(c, d).select("run_id", "outcome")


_CUT = 880_000_000_000


@query("run_markers_expired", f"SELECT o_orderkey AS run_id, epoch_us(o_orderdate) // 1000 AS ended_at FROM orders WHERE o_orderstatus = 'F' AND epoch_us(o_orderdate) // 1000 < {_CUT}")
def _(spark, sf):
    return X.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), X.millis("o_orderdate").alias("ended_at")).where(F.col("ended_at") < _CUT)


_WAIT = "w AS (SELECT id, user_id AS key, enqueued_at AS t FROM jobs WHERE queue = 'signup'), s AS (SELECT id, user_id AS key, enqueued_at AS t FROM jobs WHERE queue = 'purchase')"


def _waiters(spark, sf, queue="signup"):
    return X.jobs(spark, sf).where(F.col("queue") == queue).select("id", F.col("user_id").alias("key"), F.col("enqueued_at").alias("at_ms"))


@query("signal_match", f"WITH {X.JOBS}, {_WAIT}, m AS (SELECT w.id, s.id AS signal_id, s.t AS signal_at, row_number() OVER (PARTITION BY w.id ORDER BY s.t, s.id) AS rn FROM w JOIN s ON w.key = s.key AND s.t >= w.t AND s.t <= w.t + {DAY}) SELECT w.id, w.key, w.t AS at_ms, m.signal_id, m.signal_at FROM w LEFT JOIN m ON w.id = m.id AND m.rn = 1")
def _(spark, sf):
    return W.match_signals(_waiters(spark, sf), _waiters(spark, sf, "purchase"), DAY)


@query("signal_buffered", f"WITH {X.JOBS}, {_WAIT}, m AS (SELECT w.id, s.id AS buffered, row_number() OVER (PARTITION BY w.id ORDER BY s.t DESC, s.id DESC) AS rn FROM w JOIN s ON w.key = s.key AND s.t < w.t) SELECT w.id, w.key, w.t AS at_ms, m.buffered FROM w LEFT JOIN m ON w.id = m.id AND m.rn = 1")
def _(spark, sf):
    return W.buffered_signal(_waiters(spark, sf), _waiters(spark, sf, "purchase"))


@query("signal_conflicts", f"WITH {X.JOBS}, {_WAIT}, l AS (SELECT id, key, t, lag(t) OVER o AS pt, lag(id) OVER o AS pid FROM w WINDOW o AS (PARTITION BY key ORDER BY t, id)) SELECT id, key, pid AS conflicts_with FROM l WHERE t < pt + {DAY}")
def _(spark, sf):
    return W.signal_conflicts(_waiters(spark, sf), DAY)


@query("lease_overlap", f"WITH {X.ATTEMPTS}, l AS (SELECT queue, id, attempt, claimed_at, recorded_at FROM attempts) SELECT a.queue, a.id, a.attempt, count(b.id) AS overlaps FROM l a LEFT JOIN l b ON a.queue = b.queue AND a.id <> b.id AND a.claimed_at < b.recorded_at AND b.claimed_at < a.recorded_at GROUP BY a.queue, a.id, a.attempt")
def _(spark, sf):
    return W.lease_overlaps(X.attempts(spark, sf).select("queue", "id", "attempt", "claimed_at", "recorded_at"))


# ---------------------------------------------------------------- memo, results, typed jobs

_MEMO = "memo AS (SELECT conv_id AS run_id, turn AS step, sha256(text) AS key, min(length(text)) AS value FROM conversations WHERE role = 'user' GROUP BY 1, 2, 3), calls AS (SELECT conv_id AS run_id, turn AS step, sha256(text) AS key, conv_id * 1000 + turn AS call FROM conversations)"


def _memo(spark, sf):
    c = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), S.sha256_hex("text").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("call"), "role", F.length("text").cast("bigint").alias("size"))
    memo = c.where("role = 'user'").groupBy("run_id", "step", "key").agg(F.min("size").alias("value"))
    return c.drop("role", "size"), memo


@query("memo_lookup", f"WITH {_MEMO} SELECT c.run_id, c.step, m.value FROM calls c LEFT JOIN memo m ON c.run_id = m.run_id AND c.step = m.step AND c.key = m.key")
def _(spark, sf):
    calls, memo = _memo(spark, sf)
    return calls.join(memo, ["run_id", "step", "key"], "left").select("run_id", "step", "value")


@query("memo_hits", f"WITH {_MEMO} SELECT c.run_id, c.step, c.call, m.value IS NOT NULL AS hit, m.value IS NULL AND row_number() OVER (PARTITION BY c.run_id, c.step, c.key ORDER BY c.call) = 1 AS computes FROM calls c LEFT JOIN memo m ON c.run_id = m.run_id AND c.step = m.step AND c.key = m.key")
def _(spark, sf):
    calls, memo = _memo(spark, sf)
    return W.memo_hits(calls, memo, ["run_id", "step", "key"]).select("run_id", "step", "call", "hit", "computes")


@query("memo_sweep", f"WITH {_MEMO}, x AS (SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND epoch_us(o_orderdate) // 1000 < {_CUT}) SELECT run_id, step, key FROM memo WHERE run_id IN (SELECT run_id FROM x)")
def _(spark, sf):
    _, memo = _memo(spark, sf)
    gone = X.table(spark, sf, "orders").where("o_orderstatus = 'F'").where(X.millis("o_orderdate") < _CUT).select(F.col("o_orderkey").alias("run_id"))
    return memo.join(gone, "run_id", "left_semi").select("run_id", "step", "key")


@query("step_replay", f"WITH {_MEMO}, o AS (SELECT conv_id AS run_id, turn AS step, sha256(text) AS key, {NOW} - turn * 60000 AS stored_at FROM conversations WHERE role = 'assistant') SELECT c.run_id, c.step, o.stored_at IS NOT NULL AS replayed, CASE WHEN o.stored_at IS NOT NULL THEN greatest(120000 - greatest({NOW} - o.stored_at, 0), 0) END AS remaining_ms FROM calls c LEFT JOIN o ON c.run_id = o.run_id AND c.step = o.step AND c.key = o.key")
def _(spark, sf):
    calls, _m = _memo(spark, sf)
    o = X.table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), S.sha256_hex("text").alias("key"), (F.lit(NOW) - F.col("turn") * 60_000).alias("stored_at"))
    j = calls.join(o, ["run_id", "step", "key"], "left")
    return j.select("run_id", "step", F.col("stored_at").isNotNull().alias("replayed"), F.when(F.col("stored_at").isNotNull(), S.remaining_delay("stored_at", F.lit(NOW), F.lit(120_000).cast("bigint"))).alias("remaining_ms"))


_RES = "res AS (SELECT id AS job_id, attempt AS seq, CASE outcome WHEN 'Completed' THEN 'success:' || attempt ELSE 'failure:' || coalesce(error, '') END AS outcome, recorded_at FROM attempts WHERE outcome IN ('Completed', 'DeadLettered') AND k % 4 <> 0)"


def _results(spark, sf):
    return X.attempts(spark, sf).where("outcome IN ('Completed', 'DeadLettered') AND k % 4 <> 0").select(F.col("id").alias("job_id"), F.col("attempt").alias("seq"), F.expr("CASE outcome WHEN 'Completed' THEN 'success:' || attempt ELSE 'failure:' || coalesce(error, '') END AS outcome"), "recorded_at")


@query("result_latest", f"WITH {X.ATTEMPTS}, r AS (SELECT id AS job_id, attempt AS seq, outcome, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS rn FROM attempts) SELECT job_id, outcome, seq FROM r WHERE rn = 1")
def _(spark, sf):
    return W.latest(X.attempts(spark, sf).select(F.col("id").alias("job_id"), F.col("attempt").alias("seq"), "outcome"), "job_id", "outcome", "seq")


@query("result_markers_expired", f"WITH {X.ATTEMPTS}, {_RES} SELECT job_id, recorded_at AS terminal_at_ms FROM res WHERE recorded_at < {NOW}")
def _(spark, sf):
    m = _results(spark, sf).select("job_id", S.result_marker_name("recorded_at", "job_id").alias("marker"))
    m = m.unionByName(m.limit(0).select("job_id", F.lit("not a marker").alias("marker")))
    return m.select("job_id", S.parse_result_marker("marker").alias("terminal_at_ms")).where(F.col("terminal_at_ms") < NOW)


@query("result_sweep", f"WITH {X.ATTEMPTS}, {_RES} SELECT count(*) AS kept, count(DISTINCT job_id) AS jobs FROM res WHERE NOT recorded_at < {NOW}")
def _(spark, sf):
    r = _results(spark, sf)
    gone = r.where(F.col("recorded_at") < NOW).select("job_id")
    return r.join(gone, "job_id", "left_anti").agg(F.count("*").alias("kept"), F.countDistinct("job_id").alias("jobs"))


@query("job_result", f"WITH {X.STATE}, {_RES} SELECT s.id, s.status, r.outcome FROM state s LEFT JOIN res r ON s.id = r.job_id")
def _(spark, sf):
    return X.state(spark, sf).join(_results(spark, sf).select(F.col("job_id").alias("id"), "outcome"), "id", "left").select("id", "status", "outcome")


@query("job_join", f"WITH {X.STATE}, {_RES} SELECT s.id, coalesce(r.outcome, CASE WHEN s.status IN ('Done', 'Dead') THEN 'transient: ' || coalesce(s.last_error, 'job terminated without recording a result') END) AS joined FROM state s LEFT JOIN res r ON s.id = r.job_id")
def _(spark, sf):
    return W.join_results(X.state(spark, sf).select("id", "status", "last_error"), _results(spark, sf)).select("id", "joined")


@query("job_outcome", f"WITH {X.ATTEMPTS} SELECT id, attempt, CASE WHEN outcome = 'Completed' THEN 'Success' WHEN permanent OR attempt >= max_attempts THEN 'Failure' END AS stored, CASE WHEN outcome = 'Completed' THEN 'ack' WHEN permanent THEN 'dead_letter' ELSE 'nack' END AS settle FROM attempts")
def _(spark, sf):
    r = X.attempts(spark, sf).select("id", F.col("attempt").alias("attempts"), "max_attempts", (F.col("outcome") == "Completed").alias("ok"), F.when(F.col("permanent"), "Permanent").otherwise("Transient").alias("kind"))
    return W.job_outcome(r).select("id", F.col("attempts").alias("attempt"), "stored", "settle")


@query("job_dispatch", f"WITH {X.JOBS}, j AS (SELECT id, CASE WHEN k % 10 = 0 THEN NULL ELSE queue END AS type FROM jobs), h(type, handler) AS (VALUES ('view', 'ViewJob'), ('click', 'ClickJob'), ('purchase', 'PurchaseJob')) SELECT j.id, h.handler, CASE WHEN j.type IS NULL THEN 'missing type header' WHEN h.handler IS NULL THEN 'unknown job type' END AS error FROM j LEFT JOIN h ON j.type = h.type")
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", F.expr("CASE WHEN k % 10 = 0 THEN NULL ELSE queue END AS type"))
    h = spark.createDataFrame([("view", "ViewJob"), ("click", "ClickJob"), ("purchase", "PurchaseJob")], "type STRING, handler STRING")
    return W.dispatch(j, h).select("id", "handler", "error")


@query("idempotent_submit", f"WITH {X.ATTEMPTS}, {_RES}, c AS (SELECT id AS key, CASE WHEN v % 3 = 0 THEN 'changed' ELSE 'h' || v END AS input_hash FROM jobs), r AS (SELECT id AS key, 'h' || v AS input_hash, id AS job_id FROM jobs WHERE k % 2 = 0) SELECT c.key, CASE WHEN r.key IS NOT NULL AND r.input_hash <> c.input_hash THEN 'InputMismatch' WHEN x.job_id IS NOT NULL THEN 'Cached' ELSE 'Enqueue' END AS outcome FROM c LEFT JOIN r ON c.key = r.key LEFT JOIN res x ON x.job_id = r.job_id")
def _(spark, sf):
    j = X.jobs(spark, sf)
    c = j.select(F.col("id").alias("key"), F.expr("CASE WHEN v % 3 = 0 THEN 'changed' ELSE 'h' || v END AS input_hash"))
    r = j.where("k % 2 = 0").select(F.col("id").alias("key"), F.expr("'h' || v AS input_hash"), F.col("id").alias("job_id"))
    return W.idempotent_submit(c, r, _results(spark, sf)).select("key", "outcome")


# ---------------------------------------------------------------- bulk

_ITEMS = "items AS (SELECT d.doc_id AS run_id, CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'interrupted' ELSE 'succeeded' END AS status, CAST(strlen(d.text) AS DOUBLE) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _items(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left")
    status = F.expr("CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'interrupted' ELSE 'succeeded' END AS status")
    cost = F.create_map(F.lit("chars"), F.octet_length("text").cast("double"), F.lit("calls"), F.lit(1.0)).alias("cost")
    items = d.select(F.col("doc_id").alias("run_id"), status, cost)
    # each item is delivered at least once; every third twice, the second time as cancelled
    again = items.where("run_id % 3 = 0").select("run_id", F.lit("cancelled").alias("status"), "cost")
    return B.once(items.withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1))))


@query("bulk_report", f"WITH {_ITEMS} SELECT count(*) AS completed, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('succeeded', 'failed')) AS cancelled FROM items")
def _(spark, sf):
    return B.report(_items(spark, sf))


@query("cost_rollup", f"WITH {_ITEMS} SELECT 'chars' AS metric, round(sum(chars), 3) AS amount FROM items WHERE status = 'succeeded' UNION ALL SELECT 'calls', round(CAST(count(*) AS DOUBLE), 3) FROM items WHERE status = 'succeeded'")
def _(spark, sf):
    return B.cost_rollup(_items(spark, sf))


@query("bulk_progress", f"WITH {_ITEMS}, c AS (SELECT count(*) AS completed FROM items) SELECT completed, 1500::BIGINT AS total, round(completed / 12.5::DOUBLE, 6) AS rate, round((1500.0::DOUBLE - completed) / (completed / 12.5::DOUBLE), 3) AS eta_s, completed >= 1500 AS is_done FROM c")
def _(spark, sf):
    return B.progress(B.report(_items(spark, sf)), 1500, 12.5)


@query("fail_threshold", f"WITH {_ITEMS}, f AS (SELECT count(*) FILTER (status = 'failed') AS failed FROM items), p(pct) AS (VALUES (1.0::DOUBLE), (2.5::DOUBLE), (5.0::DOUBLE), (50.0::DOUBLE)) SELECT pct, failed, failed / 1500.0::DOUBLE * 100 > pct AS exceeded FROM f, p")
def _(spark, sf):
    return B.over_threshold(B.report(_items(spark, sf)), 1500, [1.0, 2.5, 5.0, 50.0])


@query("failed_run_ids", f"WITH {_ITEMS} SELECT run_id FROM items WHERE status = 'failed'")
def _(spark, sf):
    return _items(spark, sf).where("status = 'failed'").select("run_id")


@query("bulk_submit", "SELECT doc_id, 'item-' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS run_id, sha256(text) AS input_hash FROM documents")
def _(spark, sf):
    d = X.table(spark, sf, "documents")
    # places come from counts of id ranges and a number inside a range, so no task ranks all items
    r = d.select("doc_id", S.sha256_hex("text").alias("input_hash"), F.expr("doc_id div 4096 AS rng"))
    from pyspark.sql import Window

    before = r.groupBy("rng").agg(F.count("*").alias("c")).select("rng", (F.sum("c").over(Window.orderBy("rng")) - F.col("c")).alias("b"))
    at = r.withColumn("i", F.row_number().over(Window.partitionBy("rng").orderBy("doc_id")) - 1).join(F.broadcast(before), "rng")
    return at.select("doc_id", F.concat(F.lit("item-"), (F.col("b") + F.col("i")).cast("string")).alias("run_id"), "input_hash")


@query("bulk_cumulative", f"WITH {X.ATTEMPTS}, s AS (SELECT recorded_at // {DAY} AS day, count(*) AS n FROM attempts WHERE outcome = 'Completed' GROUP BY 1) SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS completed FROM s")
def _(spark, sf):
    from pyspark.sql import Window

    s = X.attempts(spark, sf).where("outcome = 'Completed'").groupBy(F.expr(f"recorded_at div {DAY} AS day")).agg(F.count("*").alias("n"))
    return s.withColumn("completed", F.sum("n").over(Window.orderBy("day")))


@query("resume_replay", f"WITH {X.ATTEMPTS} SELECT queue, count(*) AS executions, count(DISTINCT id) AS items, count(*) - count(DISTINCT id) AS saved FROM attempts GROUP BY queue")
def _(spark, sf):
    per = X.attempts(spark, sf).groupBy("queue", "id").agg(F.count("*").alias("c"))
    return per.groupBy("queue").agg(F.sum("c").alias("executions"), F.count("*").alias("items")).withColumn("saved", F.col("executions") - F.col("items"))


@query("fanout_phases", f"WITH {X.ATTEMPTS}, p AS (SELECT v % 3 AS phase, id, min(claimed_at) AS a, max(recorded_at) AS b, count(*) AS c FROM attempts GROUP BY 1, 2) SELECT phase, count(*) AS jobs, (max(b) - min(a)) // 1000 AS secs, CAST(sum(c) AS BIGINT) AS executed, round(count(*) / greatest((max(b) - min(a)) // 1000, 1)::DOUBLE, 6) AS jobs_per_s FROM p GROUP BY phase")
def _(spark, sf):
    p = X.attempts(spark, sf).groupBy(F.expr("v % 3 AS phase"), "id").agg(F.min("claimed_at").alias("a"), F.max("recorded_at").alias("b"), F.count("*").alias("c"))
    g = p.groupBy("phase").agg(F.count("*").alias("jobs"), F.expr("(max(b) - min(a)) div 1000 AS secs"), F.sum("c").alias("executed"))
    return g.withColumn("jobs_per_s", F.round(F.col("jobs") / F.greatest("secs", F.lit(1)), 6))


_DOC = "'TITLE: ' || CASE WHEN k % 7 = 0 THEN '' ELSE 'Event ' || id END || chr(10) || CASE WHEN k % 2 = 0 THEN 'type : ' || CASE WHEN k % 4 = 0 THEN 'Invoice' ELSE 'CLAIM' END || chr(10) ELSE '' END || 'Total: ' || v || chr(10) || 'NOTE: ' || CASE WHEN k % 3 = 0 THEN 'Amount Due: soon' WHEN k % 3 = 1 THEN 'an INCIDENT' ELSE 'nothing' END || chr(10) || 'no colon' || chr(10) || ': empty' || chr(10) || 'TOTAL: ' || (v + 1)"
_FULL = f"d0 AS (SELECT id, k, v, CASE WHEN k % 11 = 5 THEN '   ' ELSE {_DOC} END AS text FROM jobs)"
_LN = _FULL + """, ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d0 WHERE trim(text) <> ''),
 kv AS (SELECT id, pos, upper(trim(substr(line, 1, strpos(line, ':') - 1))) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value FROM ln WHERE strpos(line, ':') > 0),
 lastv AS (SELECT id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY pos DESC) AS rn FROM kv WHERE key <> '' AND value <> '') WHERE rn = 1),
 ex AS (SELECT d.id, trim(d.text) = '' AS blank, max(value) FILTER (key = 'TITLE') AS title, max(value) FILTER (key = 'TYPE') AS type, max(value) FILTER (key = 'TOTAL') AS total, max(value) FILTER (key = 'NOTE') AS note FROM d0 d LEFT JOIN lastv l ON d.id = l.id GROUP BY d.id, d.text)"""


def _docs(spark, sf):
    return X.jobs(spark, sf).select("id", F.expr(f"CASE WHEN k % 11 = 5 THEN '   ' ELSE {_DOC} END AS text"))


@query("doc_extract", f"WITH {X.JOBS}, {_LN} SELECT id, title, type, total, note FROM ex")
def _(spark, sf):
    e = B.extract_fields(_docs(spark, sf))
    return e.select("id", "title", *[F.element_at("fields", k.upper()).alias(k) for k in ("type", "total", "note")])


_CLS = "CASE WHEN type IS NOT NULL THEN lower(type) WHEN lower(note) LIKE '%amount due%' THEN 'invoice' WHEN lower(note) LIKE '%incident%' THEN 'claim' ELSE 'unknown' END"


@query("doc_classify", f"WITH {X.JOBS}, {_LN} SELECT id, {_CLS} AS class, CASE WHEN type IS NOT NULL THEN 0.95::DOUBLE WHEN lower(note) LIKE '%amount due%' OR lower(note) LIKE '%incident%' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM ex WHERE NOT blank")
def _(spark, sf):
    return B.classify_fields(B.extract_fields(_docs(spark, sf)).where("fields IS NOT NULL")).select("id", "class", "confidence")


@query("doc_validate", f"WITH {X.JOBS}, {_LN}, c AS (SELECT *, {_CLS} AS class FROM ex WHERE NOT blank) SELECT id, title IS NOT NULL AND class NOT IN ('invoice', 'claim') AS passed, concat_ws(';', CASE WHEN title IS NULL THEN 'missing TITLE field' END, CASE WHEN class = 'invoice' AND total IS NULL THEN 'missing TOTAL field' END, CASE WHEN class = 'invoice' THEN 'missing DATE field' END, CASE WHEN class = 'claim' THEN 'missing CLAIM_ID field' END) AS warnings FROM c")
def _(spark, sf):
    v = B.validate_fields(B.classify_fields(B.extract_fields(_docs(spark, sf)).where("fields IS NOT NULL")))
    return v.select("id", "passed", F.array_join("warnings", ";").alias("warnings"))


# ---------------------------------------------------------------- key-value

_KVC = "kc AS (SELECT 'k' || (user_id % 20) || '/' || queue AS key, event_id AS seq, CASE WHEN k % 10 = 0 THEN 'delete' WHEN k % 10 < 6 THEN 'put' WHEN k % 10 < 9 THEN 'cas' ELSE 'cad' END AS op, CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(v % 3 AS VARCHAR) END AS expected, CAST(v % 3 AS VARCHAR) AS value FROM jobs)"


def _kv_cmds(spark, sf):
    return X.jobs(spark, sf).selectExpr("'k' || (user_id % 20) || '/' || queue AS key", "event_id AS seq", "CASE WHEN k % 10 = 0 THEN 'delete' WHEN k % 10 < 6 THEN 'put' WHEN k % 10 < 9 THEN 'cas' ELSE 'cad' END AS op", "CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(v % 3 AS STRING) END AS expected", "CAST(v % 3 AS STRING) AS value")


_FOLD = f"""WITH RECURSIVE {X.JOBS}, {_KVC}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn, count(*) OVER (PARTITION BY key) AS cnt FROM kc),
 f AS (SELECT key, 0::BIGINT AS rn, CAST(NULL AS VARCHAR) AS cur, 0::BIGINT AS applied, 0::BIGINT AS refused FROM (SELECT DISTINCT key FROM kc)
  UNION ALL SELECT f.key, n.rn, CASE WHEN n.op = 'put' THEN n.value WHEN n.op = 'delete' THEN NULL WHEN f.cur IS DISTINCT FROM n.expected THEN f.cur WHEN n.op = 'cas' THEN n.value END,
   f.applied + CASE WHEN n.op IN ('put', 'delete') OR f.cur IS NOT DISTINCT FROM n.expected THEN 1 ELSE 0 END, f.refused + CASE WHEN n.op IN ('cas', 'cad') AND f.cur IS DISTINCT FROM n.expected THEN 1 ELSE 0 END
  FROM f JOIN n ON n.key = f.key AND n.rn = f.rn + 1)"""


@query("kv_fold", f"{_FOLD} SELECT f.key, f.cur AS value FROM f JOIN (SELECT key, max(cnt) AS cnt FROM n GROUP BY key) m ON f.key = m.key AND f.rn = m.cnt WHERE f.cur IS NOT NULL")
def _(spark, sf):
    return K.fold(_kv_cmds(spark, sf)).where("value IS NOT NULL").select("key", "value")


@query("kv_cas", f"{_FOLD} SELECT f.key, f.applied, f.refused FROM f JOIN (SELECT key, max(cnt) AS cnt FROM n GROUP BY key) m ON f.key = m.key AND f.rn = m.cnt")
def _(spark, sf):
    return K.fold(_kv_cmds(spark, sf)).select("key", "applied", "refused")


_OPS = "ops AS (SELECT user_id AS run_id, 'app/' || (k % 5) AS key, event_id AS seq, CASE WHEN v % 3 = 0 THEN 'delete' ELSE 'put' END AS op FROM jobs)"


def _ops(spark, sf):
    return X.jobs(spark, sf).selectExpr("user_id AS run_id", "'app/' || (k % 5) AS key", "event_id AS seq", "CASE WHEN v % 3 = 0 THEN 'delete' ELSE 'put' END AS op")


@query("effects_conflicts", f"WITH {X.JOBS}, {_OPS} SELECT o.run_id, o.key, o.seq, o.op, EXISTS (SELECT 1 FROM ops p WHERE p.run_id = o.run_id AND p.key = o.key AND p.seq < o.seq AND p.op <> o.op) AS conflict FROM ops o")
def _(spark, sf):
    return K.conflicts(_ops(spark, sf))


@query("effects_apply", f"WITH {X.JOBS}, {_KVC}, w AS (SELECT key, max(value) AS value FROM kc WHERE op = 'put' GROUP BY key), b AS (SELECT 'k' || o_custkey % 30 || '/view' AS key, max(o_orderpriority) AS value FROM orders GROUP BY 1), d AS (SELECT DISTINCT key FROM kc WHERE op = 'cad' AND value = '0') SELECT key, value FROM (SELECT * FROM b WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT * FROM w) WHERE key NOT IN (SELECT key FROM d)")
def _(spark, sf):
    c = _kv_cmds(spark, sf)
    writes = c.where("op = 'put'").groupBy("key").agg(F.max("value").alias("value"))
    base = X.table(spark, sf, "orders").groupBy(F.expr("'k' || o_custkey % 30 || '/view' AS key")).agg(F.max("o_orderpriority").alias("value"))
    return K.apply_effects(base, writes, c.where("op = 'cad' AND value = '0'").select("key").distinct())


@query("effects_validate", f"WITH {X.JOBS}, {_OPS}, c AS (SELECT o.*, EXISTS (SELECT 1 FROM ops p WHERE p.run_id = o.run_id AND p.key = o.key AND p.seq < o.seq AND p.op <> o.op) AS conflict FROM ops o) SELECT seq, CASE WHEN seq % 17 = 0 THEN 'sealed' WHEN seq % 13 = 0 THEN 'reserved' WHEN seq % 11 = 0 THEN 'too_large' WHEN conflict THEN 'conflict' ELSE 'ok' END AS verdict FROM c")
def _(spark, sf):
    c = K.conflicts(_ops(spark, sf))
    key = F.when(F.col("seq") % 13 == 0, F.concat(F.lit("workflow/"), F.col("key"))).otherwise(F.col("key"))
    return c.select("seq", S.effect_verdict(F.col("seq") % 17 == 0, key, F.when(F.col("seq") % 11 == 0, 262_145).otherwise(262_144), F.col("conflict")).alias("verdict"))
