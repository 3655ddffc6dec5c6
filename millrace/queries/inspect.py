"""Lookups, listings, configuration, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import inspect as I
from millrace.registry import query
from millrace.sources import fixtures as X

_LIST = "id, queue, status, priority, run_at, completed_at, attempts"
_COLS = [c.strip() for c in _LIST.split(",")]
LIMIT = 25
_ONE = "00000000000000000000000042"
_CURSOR = 100


def _listing(name: str, status: str, queue: str, order: str):
    @query(name, f"WITH {X.STATE}, p AS (SELECT {_LIST}, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () > {LIMIT} AS has_next FROM state WHERE queue = '{queue}' AND status = '{status}') SELECT * FROM p WHERE pos <= {LIMIT}")
    def run(spark, sf):
        return I.list_jobs(X.state(spark, sf), queue, status, LIMIT).select(*_COLS, "pos", "has_next")


for _s, _q, _o in (("Pending", "view", "priority, id"), ("Scheduled", "click", "run_at, strlen(queue), queue, id"), ("Claimed", "purchase", "id"), ("Done", "signup", "completed_at, strlen(queue), queue, id"), ("Dead", "error", "id")):
    _listing(f"list_jobs_{_s.lower()}", _s, _q, _o)


@query("list_jobs_page2", f"WITH {X.STATE}, p AS (SELECT {_LIST}, row_number() OVER (ORDER BY priority, id) AS pos, count(*) OVER () > {LIMIT} AS has_next FROM state WHERE queue = 'view' AND status = 'Pending' AND (priority > 100 OR (priority = 100 AND id > lpad('{_CURSOR}', 26, '0')))) SELECT * FROM p WHERE pos <= {LIMIT}")
def _(spark, sf):
    return I.list_jobs(X.state(spark, sf), "view", "Pending", LIMIT, (100, str(_CURSOR).rjust(26, "0"))).select(*_COLS, "pos", "has_next")


@query("dead_jobs", f"WITH {X.STATE} SELECT id, failed_at, last_error, attempts FROM state WHERE queue = 'view' AND status = 'Dead' AND id > '{_ONE}' ORDER BY id LIMIT {LIMIT}")
def _(spark, sf):
    return I.list_jobs(X.state(spark, sf), "view", "Dead", LIMIT, (_ONE,)).select("id", "failed_at", "last_error", "attempts")


@query("get_job", f"WITH {X.STATE}, {X.PAYLOADS} SELECT s.id, s.queue, s.status, s.attempts, s.priority, s.enqueued_at, p.bytes AS payload_bytes FROM state s LEFT JOIN payloads p ON p.payload_ref = 'payloads/' || lpad(CAST(s.doc_id AS VARCHAR), 26, '0') WHERE s.id = '{_ONE}'")
def _(spark, sf):
    one = X.state(spark, sf).where(F.col("id") == _ONE).withColumn("payload_ref", _ref())
    return I.materialise_payloads(one, X.payloads(spark, sf)).select("id", "queue", "status", "attempts", "priority", "enqueued_at", F.col("bytes").alias("payload_bytes"))


@query("list_queues", f"WITH {X.JOBS} SELECT queue, strlen(queue) AS queue_bytes FROM jobs GROUP BY queue")
def _(spark, sf):
    return I.list_queues(X.jobs(spark, sf)).orderBy("queue_bytes", "queue")


_STATS = "count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Claimed') AS claimed, count(*) FILTER (status = 'Done') AS done, count(*) FILTER (status = 'Dead') AS dead, count(*) FILTER (status = 'Scheduled') AS scheduled"


@query("queue_stats", f"WITH {X.STATE} SELECT queue, {_STATS} FROM state GROUP BY queue")
def _(spark, sf):
    return I.queue_stats(X.state(spark, sf))


@query("attempt_history", f"WITH {X.ATTEMPTS} SELECT id, attempt, claimed_at, recorded_at, outcome, error FROM attempts WHERE id IN ('{_ONE}', lpad('77', 26, '0'), lpad('123', 26, '0'))")
def _(spark, sf):
    ids = [_ONE, "77".rjust(26, "0"), "123".rjust(26, "0")]
    return X.attempts(spark, sf).where(F.col("id").isin(ids)).select("id", "attempt", "claimed_at", "recorded_at", "outcome", "error").orderBy("id", "attempt")


@query("attempt_history_agg", f"WITH {X.ATTEMPTS} SELECT id, count(*) AS n, string_agg(outcome, '>' ORDER BY attempt) AS path FROM attempts GROUP BY id")
def _(spark, sf):
    hist = F.array_sort(F.collect_list(F.struct("attempt", "outcome")))
    return X.attempts(spark, sf).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(hist, lambda x: x["outcome"]), ">").alias("path"))


_KV = "kv AS (SELECT 'app/orders/' || o_orderkey || '/status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT 'app/customers/' || c_custkey, c_mktsegment FROM customer)"


def _kv(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("app/orders/"), F.col("o_orderkey").cast("string"), F.lit("/status")).alias("key"), F.col("o_orderstatus").alias("value"))
    return o.unionByName(X.table(spark, sf, "customer").select(F.concat(F.lit("app/customers/"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value")))


@query("kv_get", f"WITH {_KV} SELECT key, value FROM kv WHERE key = 'app/orders/17/status'")
def _(spark, sf):
    return _kv(spark, sf).where("key = 'app/orders/17/status'")


@query("kv_scan", f"WITH {_KV} SELECT key, value FROM kv WHERE key LIKE 'app/orders/1%' AND key > 'app/orders/11/status' ORDER BY key LIMIT 50")
def _(spark, sf):
    return I.kv_scan(_kv(spark, sf), "app/orders/1", 50, "app/orders/11/status")


@query("queue_config_effective", f"WITH {X.JOBS}, {X.CONFIGS}, q AS (SELECT DISTINCT queue FROM jobs) SELECT q.queue, CASE WHEN c.queue IS NULL THEN 3 ELSE cfg_max_attempts END AS cfg_max_attempts, CASE WHEN c.queue IS NULL THEN 30000 ELSE lease_ms END AS lease_ms, CASE WHEN c.queue IS NULL THEN 1000 ELSE default_priority END AS default_priority, CASE WHEN c.queue IS NULL THEN 1000 ELSE base_ms END AS base_ms, CASE WHEN c.queue IS NULL THEN 300000 ELSE max_ms END AS max_ms, keep_done_ms, CASE WHEN c.queue IS NULL THEN 604800000 ELSE dead_retention_ms END AS dead_retention_ms FROM q LEFT JOIN config c ON q.queue = c.queue")
def _(spark, sf):
    return I.effective_config(X.jobs(spark, sf).select("queue").distinct(), X.config(spark))


def _ref():
    return F.concat(F.lit("payloads/"), F.lpad(F.col("doc_id").cast("string"), 26, "0"))


def _job_payloads(spark, sf):
    """Jobs with the reference that a payload beyond the threshold has."""
    d = X.table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"), "text")
    j = X.state(spark, sf).join(d, "doc_id")
    return j.withColumn("payload_ref", F.when(S.offloaded("size", X.OFFLOAD), _ref()))


_JP = f"jp AS (SELECT s.*, strlen(d.text) AS size, d.text, CASE WHEN strlen(d.text) > {X.OFFLOAD} THEN 'payloads/' || lpad(CAST(s.doc_id AS VARCHAR), 26, '0') END AS payload_ref FROM state s JOIN documents d ON s.doc_id = d.doc_id)"


@query("payload_offload", f"WITH {X.STATE}, {_JP} SELECT queue, count(*) AS n, count(payload_ref) AS offloaded, CAST(sum(CASE WHEN payload_ref IS NULL THEN size ELSE 0 END) AS BIGINT) AS inline_bytes FROM jp GROUP BY queue")
def _(spark, sf):
    j = _job_payloads(spark, sf)
    return j.groupBy("queue").agg(F.count("*").alias("n"), F.count("payload_ref").alias("offloaded"), F.sum(F.when(F.col("payload_ref").isNull(), F.col("size")).otherwise(0)).alias("inline_bytes"))


@query("payload_materialize", f"WITH {X.STATE}, {X.PAYLOADS}, {_JP} SELECT jp.id, jp.payload_ref, p.bytes, jp.payload_ref IS NOT NULL AND p.payload_ref IS NULL AS payload_missing FROM jp LEFT JOIN payloads p ON jp.payload_ref = p.payload_ref")
def _(spark, sf):
    return I.materialise_payloads(_job_payloads(spark, sf).select("id", "payload_ref"), X.payloads(spark, sf)).select("id", "payload_ref", "bytes", "payload_missing")


@query("payload_orphans", f"WITH {X.STATE}, {X.PAYLOADS}, {_JP} SELECT payload_ref, bytes FROM payloads WHERE payload_ref NOT IN (SELECT payload_ref FROM jp WHERE payload_ref IS NOT NULL AND status = 'Claimed')")
def _(spark, sf):
    live = _job_payloads(spark, sf).where("status = 'Claimed' AND payload_ref IS NOT NULL")
    return I.orphans(X.payloads(spark, sf), live).select("payload_ref", "bytes")


@query("payload_dangling", f"WITH {X.STATE}, {X.PAYLOADS}, {_JP} SELECT id, payload_ref FROM jp WHERE payload_ref IS NOT NULL AND payload_ref NOT IN (SELECT payload_ref FROM payloads)")
def _(spark, sf):
    return I.dangling(_job_payloads(spark, sf).select("id", "payload_ref"), X.payloads(spark, sf))


@query("job_view", f"WITH {X.STATE}, {_JP} SELECT id, queue, status, size AS payload_len, substr(text, 1, 128) || CASE WHEN length(text) > 128 THEN '…' ELSE '' END AS preview, payload_ref IS NOT NULL AS offloaded, lease_expires_at FROM jp WHERE status = 'Claimed'")
def _(spark, sf):
    j = _job_payloads(spark, sf).where("status = 'Claimed'")
    return j.select("id", "queue", "status", F.col("size").alias("payload_len"), F.concat(F.substring("text", 1, 128), F.when(F.length("text") > 128, "…").otherwise("")).alias("preview"), F.col("payload_ref").isNotNull().alias("offloaded"), "lease_expires_at")


@query("lease_expiry", f"WITH {X.STATE}, {X.CONFIGS} SELECT s.id, s.queue, s.claimed_at + coalesce(c.lease_ms, 30000) AS expires_at FROM state s LEFT JOIN config c ON s.queue = c.queue WHERE status = 'Claimed'")
def _(spark, sf):
    s = I.effective_config(X.state(spark, sf).where("status = 'Claimed'").select("id", "queue", "claimed_at"), X.config(spark))
    return s.select("id", "queue", (F.col("claimed_at") + F.col("lease_ms")).alias("expires_at"))


@query("leases_due", f"WITH {X.STATE} SELECT id, queue, lease_expires_at FROM state WHERE status = 'Claimed' AND lease_expires_at <= {X.AS_OF} ORDER BY lease_expires_at, queue, id")
def _(spark, sf):
    return X.state(spark, sf).where((F.col("status") == "Claimed") & (F.col("lease_expires_at") <= X.AS_OF)).select("id", "queue", "lease_expires_at").orderBy("lease_expires_at", "queue", "id")


@query("last_error", f"WITH {X.ATTEMPTS}, r AS (SELECT id, error, attempt, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS rn FROM attempts WHERE error IS NOT NULL) SELECT id, error AS last_error, attempt FROM r WHERE rn = 1")
def _(spark, sf):
    return X.attempts(spark, sf).where("error IS NOT NULL").groupBy("id").agg(F.max_by("error", "attempt").alias("last_error"), F.max("attempt").alias("attempt"))


_BEATS = "beats AS (SELECT row_number() OVER (ORDER BY event_id) AS counter, enqueued_at AS at_ms, 3600000::BIGINT AS interval_ms, CAST(floor((enqueued_at - 1704067200000) / 864000000.0) AS BIGINT) AS epoch FROM jobs WHERE queue = 'error')"


def beats(spark, sf):
    """Heartbeats: the error events; the writer changes every ten days."""
    from millrace.operators.ordered import running

    j = running(X.jobs(spark, sf).where("queue = 'error'"), ["queue"], F.expr("event_id div 4096"), ["event_id"], F.lit(1).cast("bigint"), "counter")
    return j.select("counter", F.col("enqueued_at").alias("at_ms"), F.lit(3_600_000).cast("bigint").alias("interval_ms"), F.expr("(enqueued_at - 1704067200000) div 864000000 AS epoch"))


@query("heartbeat_latest", f"WITH {X.JOBS}, {_BEATS} SELECT counter, at_ms, interval_ms, epoch FROM beats ORDER BY counter DESC LIMIT 1")
def _(spark, sf):
    b = beats(spark, sf)
    return b.agg(F.max_by(F.struct(*b.columns), "counter").alias("b")).select("b.*")


@query("heartbeat_gaps", f"WITH {X.JOBS}, {_BEATS} SELECT counter, at_ms - lag(at_ms) OVER (ORDER BY counter) AS gap_ms, (at_ms - lag(at_ms) OVER (ORDER BY counter)) // interval_ms AS missed, epoch < max(epoch) OVER () AS superseded FROM beats")
def _(spark, sf):
    from millrace.operators.timeline import heartbeat_gaps

    return heartbeat_gaps(beats(spark, sf))


@query("store_activity", f"WITH {X.ATTEMPTS} SELECT max(recorded_at) AS last_flush_at_ms, (SELECT max(CAST(floor((enqueued_at - 1704067200000) / 864000000.0) AS BIGINT)) FROM jobs) AS writer_epoch, count(*) AS durable_seq FROM attempts")
def _(spark, sf):
    a = X.attempts(spark, sf)
    return a.agg(F.max("recorded_at").alias("last_flush_at_ms"), F.max(F.expr("(enqueued_at - 1704067200000) div 864000000")).alias("writer_epoch"), F.count("*").alias("durable_seq"))


@query("seq_advance", f"WITH {X.JOBS}, p AS (SELECT CAST(floor(enqueued_at / 10800000.0) AS BIGINT) AS poll, max(event_id) AS durable_seq FROM jobs WHERE queue = 'purchase' GROUP BY 1) SELECT poll, durable_seq, coalesce(durable_seq > lag(durable_seq) OVER (ORDER BY poll), true) AS alive FROM p")
def _(spark, sf):
    from millrace.operators.timeline import seq_advance

    polls = X.jobs(spark, sf).where("queue = 'purchase'").groupBy(F.expr("enqueued_at div 10800000").alias("poll")).agg(F.max("event_id").alias("durable_seq"))
    return seq_advance(polls)
