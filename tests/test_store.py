"""Boundaries of scalars, transitions, paging, key-value folds, cron and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import bulk as B
from millrace.operators import cron as C
from millrace.operators import inspect as I
from millrace.operators import kv as K
from millrace.operators import metrics as M
from millrace.operators import timeline as T
from millrace.operators import transitions as Z
from millrace.operators import workflow as W
from millrace.schemas import QueueConfig, RuntimeConfig
from millrace.sources import fixtures as X
from millrace.sources import jsonl


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("attempts, want", [(1, 1000), (2, 2000), (3, 4000), (4, 8000), (20, 60000), (0, 1000), (10_000, 60000)])
def test_backoff(spark, attempts, want):
    assert one(spark, S.backoff_delay(F.lit(attempts), 1000, 60_000)) == want


def test_backoff_edges(spark):
    assert one(spark, S.backoff_delay(F.lit(5), 0, 60_000)) == 0
    assert one(spark, S.backoff_delay(F.lit(40), 1, 10**15)) == 4_294_967_295
    assert one(spark, S.backoff_delay(F.lit(32), 1, 10**15)) == 2_147_483_648


def test_saturation(spark):
    assert one(spark, S.remaining_delay(F.lit(100), F.lit(50), F.lit(30))) == 30
    assert one(spark, S.remaining_delay(F.lit(100), F.lit(500), F.lit(30))) == 0
    assert one(spark, S.cutoff(F.lit(5), F.lit(9))) == 0


@pytest.mark.parametrize("text, want", [("a-b_C9", True), ("", False), ("x" * 128, True), ("x" * 129, False), ("a\n", False), ("é", False), (None, False)])
def test_ids(spark, text, want):
    assert one(spark, S.valid_id(F.lit(text).cast("string"))) is want


def test_queue_name_counts_bytes(spark):
    assert one(spark, S.valid_queue_name(F.lit("é" * 127))) is True
    assert one(spark, S.valid_queue_name(F.lit("é" * 128))) is False


@pytest.mark.parametrize("status, want", [(200, "success"), (299, "success"), (301, "transient"), (404, "permanent"), (408, "transient"), (429, "transient"), (500, "transient")])
def test_http(spark, status, want):
    assert one(spark, S.http_class(F.lit(status))) == want


def test_markers(spark):
    assert one(spark, S.parse_result_marker(S.result_marker_name(F.lit(1_700_000_000_000), F.lit("j")))) == 1_700_000_000_000
    assert one(spark, S.parse_result_marker(F.lit("nonsense"))) is None


def test_step_header(spark):
    assert one(spark, S.step_number(F.lit("4294967295"))) == 4_294_967_295
    assert one(spark, S.step_number(F.lit("4294967296"))) is None
    assert one(spark, S.step_number(F.lit("x"))) is None


def test_settings():
    with pytest.raises(ValueError):
        QueueConfig(max_attempts=0)
    with pytest.raises(ValueError):
        QueueConfig(keep_done_ms=0)
    with pytest.raises(ValueError):
        RuntimeConfig(max_concurrent_steps=0)
    assert RuntimeConfig().max_concurrent_steps == 16


JOB = "id STRING, queue STRING, status STRING, attempts BIGINT, max_attempts BIGINT, priority BIGINT, run_at BIGINT, claimed_at BIGINT, last_error STRING, dedup_key STRING, claim_token BIGINT, base_ms BIGINT, max_ms BIGINT"


def jobs(spark, *rows):
    base = dict(id="a", queue="q", status="Claimed", attempts=1, max_attempts=3, priority=1000, run_at=None, claimed_at=5, last_error=None, dedup_key=None, claim_token=7, base_ms=1000, max_ms=300_000)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], JOB)


def test_nack(spark):
    df = Z.nack(jobs(spark, {}, {"id": "b", "base_ms": 0}, {"id": "c", "attempts": 3}), 100, "boom")
    got = {r["id"]: r for r in df.collect()}
    assert (got["a"]["status"], got["a"]["run_at"], got["a"]["claimed_at"], got["a"]["outcome"]) == ("Scheduled", 1100, None, "Retried")
    assert (got["b"]["status"], got["b"]["run_at"]) == ("Pending", None)
    assert (got["c"]["status"], got["c"]["claimed_at"], got["c"]["failed_at"], got["c"]["last_error"]) == ("Dead", 5, 100, "boom")


def test_reap_keeps_last_error(spark):
    got = {r["id"]: r for r in Z.reap(jobs(spark, {"last_error": "old"}, {"id": "b", "attempts": 3}), 100).collect()}
    assert (got["a"]["status"], got["a"]["last_error"], got["a"]["history"]) == ("Pending", "old", "LeaseExpired")
    assert (got["b"]["status"], got["b"]["last_error"], got["b"]["claimed_at"]) == ("Dead", "lease expired", 5)


def test_dead_letter_clears_claim(spark):
    r = Z.dead_letter(jobs(spark, {}), 9, "bad").first()
    assert (r["status"], r["claimed_at"], r["failed_at"]) == ("Dead", None, 9)


def test_promote_boundary(spark):
    df = Z.promote(jobs(spark, {"status": "Scheduled", "run_at": 10}, {"id": "b", "status": "Scheduled", "run_at": 11}), 10)
    assert {r["id"]: r["status"] for r in df.collect()} == {"a": "Pending", "b": "Scheduled"}


def test_claim_order_and_dedup_release(spark):
    rows = [{"id": i, "status": "Pending", "priority": p, "attempts": 0, "dedup_key": "k"} for i, p in (("a", 1000), ("b", 10), ("c", 10))]
    got = {r["id"]: r for r in Z.claim(jobs(spark, *rows), 2, 50).collect()}
    assert [got[i]["status"] for i in "abc"] == ["Pending", "Claimed", "Claimed"]
    assert got["b"]["attempts"] == 1 and got["b"]["dedup_key"] is None and got["a"]["dedup_key"] == "k"


def test_fence(spark):
    s = spark.createDataFrame([("a", 7), ("a", 8), ("x", 7)], "id STRING, token BIGINT")
    assert sorted((r["id"], r["token"], r["fence"]) for r in Z.fenced(jobs(spark, {}), s).collect()) == [("a", 7, "Current"), ("a", 8, "ClaimLost"), ("x", 7, "ClaimLost")]


def test_retention_is_strict(spark):
    rows = spark.createDataFrame([("a", "Done", 90, None, 10, 10), ("b", "Done", 89, None, 10, 10), ("c", "Done", 1, None, None, 10), ("d", "Dead", None, 89, None, 10), ("e", "Dead", None, 1, 10, None)], "id STRING, status STRING, completed_at BIGINT, failed_at BIGINT, keep_done_ms BIGINT, dead_retention_ms BIGINT")
    assert sorted(r["id"] for r in Z.expired(rows, 100).collect()) == ["b", "d"]


def test_pages_join_up(spark):
    rows = jobs(spark, *[{"id": f"{i:02}", "status": "Pending", "priority": i % 3} for i in range(17)])
    whole = [r["id"] for r in I.list_jobs(rows, "q", "Pending", 100).orderBy("pos").collect()]
    seen, cursor = [], None
    while True:
        page = I.list_jobs(rows, "q", "Pending", 5, cursor).orderBy("pos").collect()
        seen += [r["id"] for r in page]
        if not page or not page[-1]["has_next"]:
            break
        cursor = (page[-1]["priority"], page[-1]["id"])
    assert seen == whole and len(seen) == 17
    assert I.list_jobs(rows, "q", "Pending", 0).count() == 0
    assert I.list_jobs(rows, "q", "Pending", 5, ("one field",)).count() == 0


def test_dedup_fold(spark):
    cmds = spark.createDataFrame([("a", "q", "k", 0, 10), ("b", "q", "k", 5, 100), ("c", "q", "k", 10, 50), ("d", "q", None, 6, 9), ("e", "q", "k", 20, None)], "id STRING, queue STRING, dedup_key STRING, enqueued_at BIGINT, claimed_at BIGINT")
    got = {r["id"]: (r["outcome"], r["existing"]) for r in Z.fold_dedup(cmds).collect()}
    assert got == {"a": ("New", None), "b": ("AlreadyEnqueued", "a"), "c": ("New", None), "d": ("New", None), "e": ("AlreadyEnqueued", "c")}


def test_kv_fold(spark):
    cmds = spark.createDataFrame([("k", 1, "cas", None, "1"), ("k", 2, "cas", None, "2"), ("k", 3, "cas", "1", "3"), ("k", 4, "cad", "1", None), ("k", 5, "cad", "3", None), ("k", 6, "put", None, "9")], "key STRING, seq BIGINT, op STRING, expected STRING, value STRING")
    r = K.fold(cmds).first()
    assert (r["value"], r["applied"], r["refused"]) == ("9", 4, 2)


def test_write_and_delete_of_a_key_deletes(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", "1")], "key STRING, value STRING")
    w = spark.createDataFrame([("a", "2"), ("c", "2")], "key STRING, value STRING")
    d = spark.createDataFrame([("c",)], "key STRING")
    assert sorted(map(tuple, K.apply_effects(kv, w, d).collect())) == [("a", "2"), ("b", "1")]


def test_nearest_rank(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), "id")
    r = M.nearest_rank(df, ["g"], "id", [0, 50, 99, 100]).first()
    assert (r["n"], r["p0"], r["p50"], r["p99"], r["p100"]) == (100, 0, 50, 99, 99)


def test_retried_step_takes_the_least(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 0, 4), (1, 2, 9)], "run_id BIGINT, step BIGINT, elapsed BIGINT")
    assert sorted((r["step"], r["latency"]) for r in T.step_latency(s).collect()) == sorted([(0, None), (2, 5)], key=lambda x: x[0])


def test_cancel_precedence(spark):
    rows = [("Cancel", True), ("Succeed", True), ("Succeed", False), ("Transient", False), ("Continue", False)]
    df = spark.createDataFrame([(1, i, k, "m", 1, 3, c) for i, (k, c) in enumerate(rows)], "run_id BIGINT, step BIGINT, kind STRING, message STRING, attempts BIGINT, max_attempts BIGINT, external_cancel BOOLEAN")
    got = [(r["status"], r["error"], r["keep_effects"], r["next_step"]) for r in W.decide(df).orderBy("step").collect()]
    assert got == [("cancelled", "m", True, None), ("cancelled", None, False, None), ("succeeded", None, True, None), (None, None, False, None), (None, None, True, 5)]


def test_signal_bounds(spark):
    w = spark.createDataFrame([("w1", 1, 100), ("w2", 2, 100)], "id STRING, key BIGINT, at_ms BIGINT")
    s = spark.createDataFrame([("s0", 1, 99), ("s1", 1, 150), ("s2", 1, 150), ("s3", 2, 151)], "id STRING, key BIGINT, at_ms BIGINT")
    assert {r["id"]: r["signal_id"] for r in W.match_signals(w, s, 50).collect()} == {"w1": "s1", "w2": None}
    assert {r["id"]: r["buffered"] for r in W.buffered_signal(w, s).collect()} == {"w1": "s0", "w2": None}


def test_documents(spark):
    rows = [("invoice", "TITLE: April invoice\nTYPE: invoice\nTOTAL: 120.00\nDATE: 2026-04-30\n"), ("claim", "TITLE: Water damage\nTYPE: claim\nCLAIM_ID: C-7\n"), ("memo", "TITLE: Reminder\nNOTE: amount due next week\n"), ("blank", "   \n")]
    e = B.extract_fields(spark.createDataFrame(rows, "id STRING, text STRING"))
    assert e.where("fields IS NULL").select("id").first()["id"] == "blank"
    v = {r["id"]: r for r in B.validate_fields(B.classify_fields(e.where("fields IS NOT NULL"))).collect()}
    assert (v["invoice"]["class"], v["invoice"]["confidence"], v["invoice"]["passed"]) == ("invoice", 0.95, True)
    assert (v["memo"]["class"], v["memo"]["confidence"], v["memo"]["warnings"]) == ("invoice", 0.7, ["missing TOTAL field", "missing DATE field"])
    assert v["claim"]["passed"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1}\n\n   \n{bad\n{"a": 2, "b": "x"}\n')
    got = [(r["ok"], r["record"] and r["record"]["a"]) for r in jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl"), "a BIGINT, b STRING").collect()]
    assert sorted(got, key=repr) == sorted([(True, 1), (False, None), (True, 2)], key=repr)
    out = spark.createDataFrame([("r", "succeeded", "o", None), ("s", "failed", None, "e")], "run_id STRING, status STRING, output STRING, error STRING")
    jsonl.write_jsonl(out, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"run_id":"r","status":"succeeded","output":"o"}', '{"run_id":"s","status":"failed","error":"e"}']


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "a * * * *", "*/0 * * * *", "* * 0 * *"])
def test_cron_rejects(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_cron(spark):
    t0 = 600_000
    assert C.next_firing(spark, {"m": "* * * * *"}, t0).first()["next_fire"] == t0 + 60_000
    got = [r["fire_at"] for r in C.firings(spark, {"d": "*/30 0 1 1 *"}, -1, 3_600_000).orderBy("fire_at").collect()]
    assert got == [0, 1_800_000]


def test_invariants(spark, sf):
    jobs, attempts, state = X.jobs(spark, sf), X.attempts(spark, sf), X.state(spark, sf)
    assert state.count() == jobs.count() == state.select("id").distinct().count()
    stats = {(r["queue"], r["metric"]): r["n"] for r in M.stats_from_log(M.log_changes(jobs, attempts)).collect()}
    ends = attempts.where("outcome IN ('Completed', 'DeadLettered')").groupBy("queue").count().collect()
    for r in ends:
        assert stats[r["queue"], "done"] + stats[r["queue"], "dead"] == r["count"]
        assert stats[r["queue"], "claimed"] == 0 and stats[r["queue"], "pending"] == 0


def test_lease_timer(spark, tmp_path):
    from millrace.shipping import ship
    from millrace.streaming import processors as P
    from millrace.streaming.run import drain

    ship(spark)
    rows = [("a", 1, "claim", 1, 31_000), ("a", 2, "settle", 1, None), ("b", 3, "claim", 2, 33_000), ("c", 4, "claim", 3, 34_000), ("c", 50_000, "settle", 9, None), ("z", 900_000, "settle", 1, None)]
    spark.createDataFrame(rows, "id STRING, at BIGINT, kind STRING, token BIGINT, expires_ms BIGINT").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id STRING, at BIGINT, kind STRING, token BIGINT, expires_ms BIGINT").parquet(str(tmp_path / "in"))
    s = s.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "1 second")
    out = drain(P.stateful(s, "id", P.LeaseTimer, "EventTime"), "update")
    got = {(r["id"], r["event"]) for r in out.collect()}
    assert {("a", "settled"), ("c", "ClaimLost"), ("z", "ClaimLost"), ("b", "expired"), ("c", "expired")} == got


def stream_of(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds")


def test_cron_does_not_fill_gaps(spark, tmp_path):
    from millrace.shipping import ship
    from millrace.streaming import processors as P
    from millrace.streaming.run import drain

    ship(spark)
    t0 = 600_000
    rows = [("m", "* * * * *", t0), ("m", "* * * * *", t0 + 330_000), ("m", "* * * * *", t0 + 359_999), ("m", "* * * * *", t0 + 360_000)]
    s = stream_of(spark, rows, "name STRING, expression STRING, at BIGINT", str(tmp_path / "in"))
    assert sorted(r["fire_at"] for r in drain(P.stateful(s, "name", P.CronNoBackfill), "update").collect()) == [t0 + 60_000, t0 + 360_000]


def test_next_after_agrees_with_the_minutes(spark):
    for e in ("0 9 * * 1-5", "30 6 13 * 5", "*/20 3,4 * 2 *", "59 23 31 12 *"):
        for now in (0, 1_709_251_199_000, 1_735_689_540_000):
            assert C.next_after(e, now) == C.next_firing(spark, {"x": e}, now).first()["next_fire"]
    leap, before_2100 = 1_740_787_200_000, 4_100_000_000_000
    for now in (leap, before_2100):
        assert C.next_after("0 0 29 2 *", now) == C.next_firing(spark, {"x": "0 0 29 2 *"}, now).first()["next_fire"]
    assert C.next_after("0 0 29 2 *", leap) == 1_835_395_200_000 and C.next_after("0 0 29 2 *", before_2100) == 4_233_686_400_000
    assert C.next_after("0 0 31 2 *", 0) is None and C.next_firing(spark, {"x": "0 0 31 2 *"}, 0).count() == 0


def test_signal_wait(spark, tmp_path):
    from millrace.shipping import ship
    from millrace.streaming import processors as P
    from millrace.streaming.run import drain

    ship(spark)
    rows = [
        ("a", 1000, "wait", "w1", 500), ("a", 1500, "signal", "s1", None), ("a", 2000, "signal", "s2", None), ("a", 2100, "signal", "s3", None), ("a", 3000, "wait", "w2", 100),
        ("b", 1000, "wait", "w3", 100), ("b", 1050, "wait", "w4", 100), ("b", 1101, "signal", "s4", None), ("b", 1200, "wait", "w5", 10),
        ("c", 1000, "wait", "w6", 100), ("z", 900_000, "signal", "s9", None),
    ]
    s = stream_of(spark, rows, "ckey STRING, at BIGINT, kind STRING, id STRING, timeout_ms BIGINT", str(tmp_path / "in"))
    got = sorted((r["waiter"], r["event"], r["signal"]) for r in drain(P.stateful(s, "ckey", P.SignalWait, "EventTime"), "update").collect())
    assert got == [("w1", "matched", "s1"), ("w2", "matched", "s3"), ("w3", "timed_out", None), ("w4", "conflict", None), ("w5", "matched", "s4"), ("w6", "timed_out", None)]


def test_one_hot_key_is_spread(spark):
    """A key with most rows: folds, as-of passes and ranks agree with a plain pass, and its segments fill many tasks."""
    import random

    from millrace.operators import ordered as O

    rng, rows, value, applied, refused = random.Random(4), [], None, 0, 0
    for seq in range(20_000):
        op, expected, new = rng.choice(["put", "delete", "cas", "cas", "cas", "cad"]), rng.choice([None, "a", "b"]), rng.choice(["a", "b"])
        rows.append(("hot", seq, op, expected, new))
        if op in ("put", "delete") or value == expected:
            value, applied = new if op in ("put", "cas") else None, applied + 1
        else:
            refused += 1
    cmds = spark.createDataFrame(rows, "key STRING, seq BIGINT, op STRING, expected STRING, value STRING")
    assert tuple(K.fold(cmds).first()) == ("hot", value, applied, refused)
    parts = O.running(cmds, ["key"], F.expr("seq div 512"), ["seq"], F.col("op").isin("put", "delete").cast("bigint"), "seg").repartition(16, "key", "seg")
    shares = [r["count"] for r in parts.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(shares) >= 14 and max(shares) < 3 * 20_000 / 16
    df = spark.createDataFrame([("g", rng.randrange(5000), rng.choice([None, "x", "y"])) for _ in range(3000)], "g STRING, at BIGINT, v STRING").withColumn("n", F.monotonically_increasing_id())
    order = sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[3]))
    for back in (True, False):
        for own in (True, False):
            got = {r["n"]: r["x"] for r in O.neighbour(df, ["g"], F.expr("at div 100"), ["at", "n"], F.col("v"), "x", back, own).collect()}
            last = None
            for r in order if back else reversed(order):
                here = r[2] if own and r[2] is not None else last
                assert got[r[3]] == here
                last = r[2] if r[2] is not None else last


def test_lease_overlaps(spark):
    import random

    rng = random.Random(5)
    rows = [("q", f"j{i}", 1, t, t + 1 + rng.randrange(300)) for i in range(200) for t in [rng.randrange(5000)]]
    got = {r["id"]: r["overlaps"] for r in W.lease_overlaps(spark.createDataFrame(rows, "queue STRING, id STRING, attempt BIGINT, claimed_at BIGINT, recorded_at BIGINT"), 100).collect()}
    assert got == {a[1]: sum(a[1] != b[1] and a[3] < b[4] and b[3] < a[4] for b in rows) for a in rows}
