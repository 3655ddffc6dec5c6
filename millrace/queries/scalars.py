"""Scalar semantics over sample columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import cron as C
from millrace.registry import query
from millrace.sources import fixtures as X
from millrace.sources import jsonl

NOW = X.AS_OF


@query("backoff_delay", f"WITH {X.JOBS} SELECT id, k % 40 AS attempts, CASE WHEN v % 5 = 0 THEN 0 ELSE least((v % 5)::DOUBLE * 100 * least(pow(2, greatest(k % 40 - 1, 0)), 4294967295), 60000 + v)::BIGINT END AS delay_ms FROM jobs")
def _(spark, sf):
    j = X.jobs(spark, sf)
    return j.select("id", F.expr("k % 40 AS attempts"), S.backoff_delay(F.expr("k % 40"), F.expr("(v % 5) * 100"), F.expr("60000 + v")).alias("delay_ms"))


@query("remaining_delay", f"WITH {X.JOBS} SELECT id, greatest(k * 60000 - greatest({NOW} - enqueued_at, 0), 0) AS remaining_ms FROM jobs")
def _(spark, sf):
    return X.jobs(spark, sf).select("id", S.remaining_delay("enqueued_at", F.lit(NOW), F.col("k") * 60_000).alias("remaining_ms"))


@query("key_roundtrip", f"WITH {X.JOBS} SELECT id, lpad(upper(to_hex(enqueued_at)), 16, '0') AS field, enqueued_at AS parsed FROM jobs")
def _(spark, sf):
    return X.jobs(spark, sf).select("id", S.key_field("enqueued_at").alias("field"), S.parse_key_field(S.key_field("enqueued_at")).alias("parsed"))


@query("marker_keys", f"WITH {X.JOBS} SELECT id, 'workflow/terminals/' || lpad(CAST(enqueued_at AS VARCHAR), 20, '0') || '/' || id AS run_key, lpad(CAST(18446744073709551615::HUGEINT - enqueued_at AS VARCHAR), 20, '0') || '_' || id AS result_name, enqueued_at AS parsed FROM jobs")
def _(spark, sf):
    name = S.result_marker_name("enqueued_at", "id")
    return X.jobs(spark, sf).select("id", S.run_marker_key("enqueued_at", "id").alias("run_key"), name.alias("result_name"), S.parse_result_marker(name).alias("parsed"))


@query("input_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.sha256_hex("text").alias("hash"))


@query("memo_content", "SELECT doc_id, 'content:' || sha256(text) AS memo_key, count(*) OVER (PARTITION BY sha256(text)) AS same FROM documents")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("content:"), S.sha256_hex("text")).alias("memo_key"))
    return d.join(d.groupBy("memo_key").agg(F.count("*").alias("same")), "memo_key").select("doc_id", "memo_key", "same")


@query("idempotency_key", "SELECT 'Normalise:' || sha256(lower(text)) AS idem_key, min(doc_id) AS first_doc, count(*) AS submits FROM documents GROUP BY 1")
def _(spark, sf):
    return X.table(spark, sf, "documents").groupBy(F.concat(F.lit("Normalise:"), S.sha256_hex(F.lower("text"))).alias("idem_key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("submits"))


@query("http_class", "SELECT page_id, [200, 404, 408, 429, 500][page_id % 5 + 1]::BIGINT AS status, ['success', 'permanent', 'transient', 'transient', 'transient'][page_id % 5 + 1] AS class, substr(html, 1, 200) AS preview FROM pages")
def _(spark, sf):
    s = F.expr("element_at(array(200L, 404L, 408L, 429L, 500L), CAST(page_id % 5 + 1 AS INT))")
    return X.table(spark, sf, "pages").select("page_id", s.alias("status"), S.http_class(s).alias("class"), F.substring("html", 1, 200).alias("preview"))


# Error kinds and whether a retry cannot help.
ERRORS = [
    ("queue", "Serialization", True), ("queue", "Deserialization", True), ("queue", "JobNotFound", True), ("queue", "InvalidState", True), ("queue", "ClaimLost", True), ("queue", "CancelRequested", True),
    ("queue", "KvValueTooLarge", True), ("queue", "InvalidId", True), ("queue", "DuplicateJobId", True), ("queue", "InvalidQueueName", True), ("queue", "PayloadMissing", True), ("queue", "Storage", False),
    ("queue", "PayloadStore", False), ("queue", "StoreNotInitialized", False), ("workflow", "MissingHeader", True), ("workflow", "InvalidStepHeader", True), ("workflow", "ReservedHeaderInSubmit", True),
    ("workflow", "InvalidRunId", True), ("workflow", "InputMismatch", True), ("workflow", "ReservedKvKey", True), ("workflow", "ConflictingKvEffect", True), ("workflow", "EffectsSealed", True),
    ("workflow", "Serialization", True), ("workflow", "Store", False), ("jobs", "Encode", True), ("jobs", "Decode", True), ("jobs", "JobNotFound", True), ("jobs", "ReservedHeader", True),
    ("jobs", "InputMismatch", True), ("jobs", "Store", False), ("webhooks", "MissingUrl", True), ("webhooks", "InvalidMethod", True), ("webhooks", "InvalidTimeout", True), ("webhooks", "PermanentDelivery", True), ("webhooks", "Delivery", False),
]


def _errors_sql() -> str:
    return "errors(layer, kind, permanent) AS (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in ERRORS) + ")"


_KINDS = ["Storage", "ClaimLost", "Store", "InputMismatch", "Delivery", "MissingUrl", "Unheard"]
_LAYERS = ["queue", "workflow", "jobs", "webhooks"]


@query("error_class", f"WITH {X.JOBS}, {_errors_sql()}, e AS (SELECT {_LAYERS}[k % 4 + 1] AS layer, {_KINDS}[v % 7 + 1] AS kind FROM jobs) SELECT e.layer, e.kind, coalesce(x.permanent, false) AS permanent, count(*) AS n FROM e LEFT JOIN errors x ON e.layer = x.layer AND e.kind = x.kind GROUP BY 1, 2, 3")
def _(spark, sf):
    pick = lambda xs, c, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % n + 1).cast("int"))
    e = X.jobs(spark, sf).select(pick(_LAYERS, "k", 4).alias("layer"), pick(_KINDS, "v", 7).alias("kind"))
    known = F.broadcast(spark.createDataFrame(ERRORS, "layer STRING, kind STRING, permanent BOOLEAN"))
    return e.join(known, ["layer", "kind"], "left").groupBy("layer", "kind", F.coalesce("permanent", F.lit(False)).alias("permanent")).agg(F.count("*").alias("n"))


_HDR = """h AS (SELECT id, CASE v % 6 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '-5' WHEN 4 THEN CAST(v AS VARCHAR) ELSE CAST(v * 100000000 AS VARCHAR) END AS x FROM jobs)"""
_HDR_EXPR = "CASE v % 6 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '-5' WHEN 4 THEN CAST(v AS STRING) ELSE CAST(v * 100000000 AS STRING) END"


@query("webhook_timeout", f"WITH {X.JOBS}, {_HDR} SELECT id, CASE WHEN x IS NULL THEN 30000 WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS BIGINT) END AS timeout_ms, x IS NOT NULL AND NOT regexp_matches(x, '^[0-9]+$') AS permanent FROM h")
def _(spark, sf):
    t = S.timeout_ms(F.expr(_HDR_EXPR))
    return X.jobs(spark, sf).select("id", t.alias("timeout_ms"), t.isNull().alias("permanent"))


@query("step_headers", f"WITH {X.JOBS}, {_HDR} SELECT id, CASE WHEN regexp_matches(x, '^[0-9]+$') AND CAST(x AS BIGINT) <= 4294967295 THEN CAST(x AS BIGINT) END AS step, CASE WHEN x IS NULL THEN 'missing header' WHEN NOT regexp_matches(x, '^[0-9]+$') OR CAST(x AS BIGINT) > 4294967295 THEN 'invalid step header' END AS error FROM h")
def _(spark, sf):
    x = F.expr(_HDR_EXPR)
    n = S.step_number(x)
    return X.jobs(spark, sf).select("id", n.alias("step"), F.when(x.isNull(), "missing header").when(n.isNull(), "invalid step header").alias("error"))


@query("webhook_headers", "SELECT page_id, url AS webhook_url, 'POST' AS webhook_method, CASE WHEN page_id % 2 = 0 THEN CAST(page_id * 10 AS VARCHAR) END AS webhook_timeout_ms, CAST(page_id AS VARCHAR) AS http_x_page, CASE WHEN page_id % 2 = 0 THEN 4 ELSE 3 END::BIGINT AS n FROM pages")
def _(spark, sf):
    p = X.table(spark, sf, "pages")
    http = F.transform_keys(F.create_map(F.lit("x-page"), F.col("page_id").cast("string")), lambda k, _: F.concat(F.lit("http."), k))
    base = F.create_map(F.lit("webhook.url"), F.col("url"), F.lit("webhook.method"), F.lit("POST"))
    late = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("webhook.timeout_ms"), (F.col("page_id") * 10).cast("string"))).otherwise(F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    m = F.map_concat(base, late, http)
    return p.select("page_id", m.alias("m")).select("page_id", F.element_at("m", "webhook.url").alias("webhook_url"), F.element_at("m", "webhook.method").alias("webhook_method"), F.element_at("m", "webhook.timeout_ms").alias("webhook_timeout_ms"), F.element_at("m", "http.x-page").alias("http_x_page"), F.size("m").cast("bigint").alias("n"))


@query("user_headers", f"WITH {X.JOBS} SELECT id, 2::BIGINT AS n, 'tenant=' || CAST(user_id AS VARCHAR) || ',type=' || queue AS headers FROM jobs")
def _(spark, sf):
    h = F.create_map(F.lit("workflow.run_id"), F.col("id"), F.lit("workflow.step"), F.col("k").cast("string"), F.lit("tenant"), F.col("user_id").cast("string"), F.lit("type"), F.col("queue"))
    u = S.user_headers(h)
    said = F.array_join(F.array_sort(F.transform(F.map_entries(u), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return X.jobs(spark, sf).select("id", F.size(u).cast("bigint").alias("n"), said.alias("headers"))


_IDS = "CASE v % 5 WHEN 0 THEN id WHEN 1 THEN '' WHEN 2 THEN 'has space ' || id WHEN 3 THEN repeat('x', CAST(100 + k AS INT)) ELSE id || chr(10) END"


@query("validate_ids", f"WITH {X.JOBS}, c AS (SELECT event_id, {_IDS} AS x FROM jobs) SELECT event_id, length(x) BETWEEN 1 AND 128 AND regexp_full_match(x, '[A-Za-z0-9_-]*') AS ok_id, strlen(x) BETWEEN 1 AND 255 AS ok_queue FROM c")
def _(spark, sf):
    x = F.expr(_IDS)
    return X.jobs(spark, sf).select("event_id", S.valid_id(x).alias("ok_id"), S.valid_queue_name(x).alias("ok_queue"))


@query("cursor_hex", f"WITH {X.JOBS} SELECT id, lower(hex(queue || '/' || id)) AS cursor, queue || '/' || id AS decoded FROM jobs")
def _(spark, sf):
    k = F.concat("queue", F.lit("/"), "id")
    return X.jobs(spark, sf).select("id", F.lower(F.hex(k)).alias("cursor"), F.unhex(F.lower(F.hex(k))).cast("string").alias("decoded"))


@query("wordcount", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS chars FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.word_count("text").alias("words"), F.octet_length("text").cast("bigint").alias("chars"))


_LINES = """lines AS (SELECT event_id, CASE v % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN '{"id": "' || id || '", "n": ' || k || '}' WHEN 3 THEN '{"id": broken' ELSE '{"id": "' || id || '", "n": ' || v || '}' END AS value FROM jobs)"""


@query("jsonl_read", f"WITH {X.JOBS}, {_LINES} SELECT event_id, value NOT LIKE '%broken%' AS ok, CASE WHEN value NOT LIKE '%broken%' THEN regexp_extract(value, '\"id\": \"([0-9]+)\"', 1) END AS id, CASE WHEN value NOT LIKE '%broken%' THEN CAST(regexp_extract(value, '\"n\": ([0-9]+)', 1) AS BIGINT) END AS n FROM lines WHERE trim(value) <> ''")
def _(spark, sf):
    value = F.expr("""CASE v % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN '{"id": "' || id || '", "n": ' || k || '}' WHEN 3 THEN '{"id": broken' ELSE '{"id": "' || id || '", "n": ' || v || '}' END""")
    lines = X.jobs(spark, sf).select(F.concat(F.col("event_id").cast("string"), F.lit("\t")).alias("e"), value.alias("value"))
    got = jsonl.parse_lines(lines.select("value", "e"), "id STRING, n BIGINT", extra=["e"])
    return got.select(F.regexp_replace("e", "\t", "").cast("bigint").alias("event_id"), "ok", "record.id", "record.n")


@query("jsonl_emit", "SELECT d.doc_id, '{\"run_id\":\"' || d.doc_id || '\",\"status\":\"' || CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'succeeded' END || '\"' || CASE WHEN l.toxic = 1 THEN ',\"error\":\"toxic\"}' ELSE ',\"output\":' || d.n_chars || '}' END AS line FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id")
    bad = F.col("toxic") == 1
    line = jsonl.output_line(F.col("doc_id").cast("string"), F.when(bad, "failed").otherwise("succeeded"), F.when(~bad, F.col("n_chars")), F.when(bad, "toxic"))
    # the order of the fields is fixed: run_id, status, output, error
    return d.select("doc_id", line.alias("line"))


@query("webhook_hook", "SELECT o_orderkey AS run_id, 'https://hooks.example.com/' || o_custkey AS webhook_url, CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status FROM orders WHERE o_orderstatus <> 'O' AND o_custkey % 3 = 0")
def _(spark, sf):
    o = X.table(spark, sf, "orders").withColumn("callback_url", F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("https://hooks.example.com/"), F.col("o_custkey").cast("string"))))
    return o.where("o_orderstatus <> 'O' AND callback_url IS NOT NULL").select(F.col("o_orderkey").alias("run_id"), F.col("callback_url").alias("webhook_url"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status"))


_SCHED = ["60:0,300:500,120:2000", "10:5", "abc", "10:5,20", "", "0:10", "30:100,30:0"]


@query("rate_schedule", "WITH s(name, text) AS (VALUES " + ", ".join(f"('s{i}', '{t}')" for i, t in enumerate(_SCHED)) + "), p AS (SELECT name, text, unnest(string_split(text, ',')) AS seg, unnest(range(len(string_split(text, ',')))) AS pos FROM s), q AS (SELECT name, pos, CASE WHEN regexp_full_match(seg, '[1-9][0-9]*:[0-9]+') THEN CAST(split_part(seg, ':', 1) AS BIGINT) END AS secs, CASE WHEN regexp_full_match(seg, '[1-9][0-9]*:[0-9]+') THEN CAST(split_part(seg, ':', 2) AS BIGINT) END AS rate FROM p), g AS (SELECT name FROM q GROUP BY name HAVING count(*) = count(secs)) SELECT q.name, q.pos, q.secs, q.rate, CAST(sum(secs) OVER (PARTITION BY q.name ORDER BY pos) AS BIGINT) AS until_s FROM q JOIN g ON q.name = g.name")
def _(spark, sf):
    from millrace.operators.timeline import rate_schedule

    return rate_schedule(spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(_SCHED)], "name STRING, text STRING"))


SCHEDULES = {"daily": "0 9 * * *", "hourly": "0 * * * *", "weekday": "0 9 * * 1-5", "days": "30 6 13 * 5"}
_START, _END = 1_704_067_200_000, 1_706_659_200_000
_CRON = "m AS (SELECT range AS fire_at, epoch_ms(range) AS t FROM range({a}, {b}, 60000)), f AS (SELECT 'daily' AS name, fire_at FROM m WHERE hour(t) = 9 AND minute(t) = 0 UNION ALL SELECT 'hourly', fire_at FROM m WHERE minute(t) = 0 UNION ALL SELECT 'weekday', fire_at FROM m WHERE hour(t) = 9 AND minute(t) = 0 AND dayofweek(t) BETWEEN 1 AND 5 UNION ALL SELECT 'days', fire_at FROM m WHERE hour(t) = 6 AND minute(t) = 30 AND (day(t) = 13 OR dayofweek(t) = 5))"


@query("cron_firings", f"WITH {_CRON.format(a=_START + 60_000, b=_END + 1)} SELECT name, fire_at, 'cron:' || name || ':' || fire_at AS dedup_key FROM f")
def _(spark, sf):
    return C.firings(spark, SCHEDULES, _START, _END)


@query("cron_next", f"WITH {_CRON.format(a=NOW + 60_000, b=NOW + 40 * 86_400_000)} SELECT name, min(fire_at) AS next_fire FROM f GROUP BY name")
def _(spark, sf):
    return C.next_firing(spark, SCHEDULES, NOW)
