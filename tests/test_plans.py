"""The store, worker loops and bulk runs from end to end."""

import pytest

from millrace.plans import workers
from millrace.plans.store import TaskStore
from millrace.schemas import QueueConfig


class Clock:
    now = 1_700_000_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return TaskStore(spark, str(tmp_path / "s"), {"q": QueueConfig(max_attempts=2, lease_ms=1000, backoff_base_ms=0, keep_done_ms=5000, dead_retention_ms=5000)}, clock)


def test_life_of_jobs(store, spark, clock):
    out = store.enqueue([{"queue": "q", "payload": "a", "dedup_key": "k"}, {"queue": "q", "payload": "b", "dedup_key": "k"}, {"queue": "q", "payload": "c", "priority": 1}, {"queue": "q", "payload": "d", "run_at": clock.now + 500}]).collect()
    assert [r["outcome"] for r in out] == ["New", "AlreadyEnqueued", "New", "New"] and out[1]["existing"] == out[0]["id"]
    assert store.stats("q") == {"pending": 2, "claimed": 0, "done": 0, "dead": 0, "scheduled": 1}
    first, second = store.claim("q", 5).collect()
    assert (bytes(first["payload"]), first["attempts"], second["dedup_key"]) == (b"c", 1, None)
    assert [r["fence"] for r in store.ack([(first["id"], first["claim_token"] + 9)]).collect()] == ["ClaimLost"]
    assert [r["fence"] for r in store.ack([(first["id"], first["claim_token"])], {"seen/c": "1"}).collect()] == ["Current"]
    assert store.kv_get("seen/c") == "1" and store.get_job(first["id"])["status"] == "Done"
    store.nack([(second["id"], second["claim_token"])], "boom")
    again = store.claim("q", 1).first()
    assert (again["id"], again["attempts"], again["last_error"]) == (second["id"], 2, "boom")
    clock.now += 1000
    assert store.reap() == 1 and store.get_job(second["id"])["status"] == "Dead" and store.promote() == 1
    assert [h["outcome"] for h in store.attempt_history(second["id"])] == ["Retried", "DeadLettered"]
    assert store.stats("q") == {"pending": 1, "claimed": 0, "done": 1, "dead": 1, "scheduled": 0}
    assert store.requeue_dead([second["id"]]) == 1 and store.get_job(second["id"])["attempts"] == 0
    assert store.cancel([second["id"], "nobody", first["id"]]) == {second["id"]: "Removed", "nobody": "NotFound", first["id"]: "NotFound"}
    clock.now += 5001
    assert store.sweep() == 1 and store.get_job(first["id"]) is None and store.stats("q")["done"] == 1 and store.list_queues() == ["q"]


def test_claims_wait(store, clock):
    slept = []

    def pause(ms):
        slept.append(ms)
        clock.now += ms

    assert store.claim_wait("q", 2, 350, pause).isEmpty() and slept == [200, 150]
    store.enqueue([{"queue": "q", "payload": "a", "run_at": clock.now + 300}, {"queue": "r", "payload": "b"}])
    got = store.claim_wait("q", 2, 10_000, pause).collect()
    assert [bytes(r["payload"]) for r in got] == [b"a"] and slept[2:] == [200, 200]
    assert len(store.claim_wait("r", 2, 0, pause).collect()) == 1 and len(slept) == 4


def test_reopening_requeues_claims(store, spark, clock):
    store.enqueue([{"queue": "q", "payload": "a"}])
    job = store.claim("q", 1).first()
    again = TaskStore(spark, store.path, store.configs, clock)
    row = again.get_job(job["id"])
    assert (row["status"], row["claim_token"]) == ("Pending", None) and [h["outcome"] for h in again.attempt_history(job["id"])] == ["Interrupted"]
    assert again.ack([(job["id"], job["claim_token"])]).first()["fence"] == "ClaimLost"


def test_ids_and_wake(store, clock):
    got = store.enqueue([{"queue": "q", "payload": "a", "id": "one", "run_at": clock.now + 10_000}, {"queue": "q", "payload": "a", "id": "one"}]).collect()
    assert [r["outcome"] for r in got] == ["New", "DuplicateJobId"]
    assert store.wake(["one", "two"]) == {"one": "Woken", "two": "NotFound"} and store.get_job("one")["woken_at"] == clock.now
    with pytest.raises(ValueError):
        store.enqueue([{"queue": "q", "id": "no good"}])


def test_compare_and_set(store):
    store.kv_apply([{"key": "a", "op": "put", "value": "1"}])
    got = store.kv_apply([{"key": "a", "op": "cas", "expected": "2", "value": "3"}, {"key": "a", "op": "cas", "expected": "1", "value": "4"}, {"key": "b", "op": "cas", "value": "5"}]).collect()
    assert {r["key"]: (r["value"], r["applied"], r["refused"]) for r in got} == {"a": ("4", 1, 1), "b": ("5", 1, 0)}
    assert store.kv_get("a") == "4" and store.kv_get("zz") is None


def test_bulk(store):
    def pipeline(n):
        if n == 13:
            raise workers.PermanentFailure("unlucky")
        if n == 4:
            raise RuntimeError("always")
        return 2 * n

    report = workers.run_bulk(store, [1, 2, 13, 4], pipeline, queue="q")
    assert (report.total, report.succeeded, report.failed) == (4, 2, 2)
    assert report.results == {"item-0": 2, "item-1": 4} and report.failed_run_ids == ["item-2", "item-3"]
    assert report.exceeds(49.9) and not report.exceeds(50)
    assert store.get_job("item-3")["attempts"] == 2 and store.get_job("item-2")["attempts"] == 1
    assert workers.run_bulk(store, [1, 2], pipeline, queue="q").total == 0


def runner(step):
    n = step["payload"]
    if n == "wait":
        return {"kind": "OnSignal", "payload": "woken", "key": "go", "timeout_ms": 60_000}
    if n == "woken":
        return {"kind": "Succeed", "result": step["signal"]}
    if n == "bad":
        raise workers.PermanentFailure("no way")
    if n == "flaky":
        if step["attempt"] < 2:
            raise RuntimeError("again")
        return {"kind": "Succeed", "result": step["attempt"]}
    if n == "later":
        return {"kind": "After", "payload": 2, "delay_ms": 5000}
    return {"kind": "Continue", "payload": n + 1} if n < 2 else {"kind": "Succeed", "result": n}


def test_runs(store, clock):
    from millrace.plans.runs import Runs

    ended = {}
    runs = Runs(store, "q", lambda o: ended.__setitem__(o["run_id"], (o["status"], o["final_step"], o["result"], o["error"])))
    assert [runs.submit("a", 0), runs.submit("a", 0), runs.submit("a", 1)] == ["New", "Duplicate", "InputMismatch"]
    for name, start in (("b", "bad"), ("c", "wait"), ("d", "flaky"), ("e", "later"), ("f", 0)):
        runs.submit(name, start)
    assert runs.status("f") == "Pending" and runs.cancel("f") and not runs.cancel("nobody")
    runs.work(runner)
    assert ended == {"f": ("cancelled", 0, None, None), "a": ("succeeded", 2, 2, None), "b": ("failed", 0, None, "no way"), "d": ("succeeded", 0, 2, None)}
    assert runs.status("a") is None and runs.status("c") == "Pending"
    assert runs.signal("go", {"x": 1}) == "Delivered" and runs.signal("go", 2) == "Buffered"
    clock.now += 5000
    runs.work(runner)
    assert ended["c"] == ("succeeded", 1, {"x": 1}, None) and ended["e"] == ("succeeded", 1, 2, None)


class Crash(Exception):
    pass


def stop_at(store, step):
    def reached(at):
        if at == step:
            raise Crash(at)

    store.log.reached = reached


@pytest.mark.parametrize("step, kept", [("tables", False), ("half", False), ("pending", False), ("published", True)])
def test_a_crash_leaves_the_version_before_or_after(spark, store, clock, step, kept):
    store.kv_put({"a": "1"})
    stop_at(store, step)
    with pytest.raises(Crash):
        store.kv_put({"a": "2", "b": "2"})
    again = TaskStore(spark, store.path, store.configs, clock, recover=False)
    assert (again.kv_get("a"), again.kv_get("b")) == (("2", "2") if kept else ("1", None))
    again.kv_put({"c": "3"})
    assert TaskStore(spark, store.path, store.configs, clock, recover=False).kv_get("c") == "3"


def test_a_second_writer_and_torn_pointers(spark, store, clock, tmp_path):
    import glob
    import os

    from millrace.plans.store import StoreReader
    from millrace.plans.versions import StaleWriter

    store.kv_put({"a": "1"})
    reader, follower = StoreReader(spark, store.path), StoreReader(spark, store.path, follow=True)
    other = TaskStore(spark, store.path, store.configs, clock)
    with pytest.raises(StaleWriter):
        store.kv_put({"a": "2"})
    other.kv_put({"a": "3"})
    assert (reader.kv_get("a"), follower.kv_get("a")) == ("1", "3") and reader.refresh() and reader.kv_get("a") == "3"
    (tmp_path / "s" / "CURRENT-999999999999").write_text('{"version": 9')
    assert TaskStore(spark, store.path, store.configs, clock).kv_get("a") == "3"
    for name in glob.glob(f"{store.path}/CURRENT-*"):
        os.remove(name)
    with pytest.raises(RuntimeError):
        TaskStore(spark, store.path, store.configs, clock)
    other.closed = False
    with pytest.raises(FileNotFoundError):
        StoreReader(spark, str(tmp_path / "nothing"))


def test_many_versions_are_merged_and_closed(spark, store, clock):
    for n in range(15):
        store.kv_put({"k": str(n), f"k{n}": "x" if n % 2 else None})
    assert store.kv_get("k") == "14" and len(store.meta["tables"]["kv"]) < 13
    assert [r["key"] for r in store.kv_scan("k", 3).collect()] == ["k", "k1", "k11"] and [r["key"] for r in store.kv_scan("k", 9, "k3").collect()] == ["k5", "k7", "k9"]
    store.vacuum(2)
    store.close()
    with pytest.raises(RuntimeError):
        store.kv_put({"k": "no"})
    again = TaskStore(spark, store.path, store.configs, clock)
    assert again.kv_get("k") == "14" and again.kv_many(["k", "k1", "k2"]) == {"k": "14", "k1": "x"}


def test_effects_commit_with_their_settlement(store, clock):
    store.enqueue([{"queue": "q", "payload": str(n), "max_attempts": 1 + n % 2, "dedup_key": f"d{n}"} for n in range(5)])
    jobs = store.claim("q", 5).collect()
    pair = lambda n: (jobs[n]["id"], jobs[n]["claim_token"])
    effects = [{"id": jobs[n]["id"], "put": (f"done/{n}", "1")} for n in range(4)] + [{"id": jobs[n]["id"], "enqueue": {"queue": "next", "payload": str(n), "dedup_key": f"n{n // 2}"}} for n in range(4)]
    effects += [{"id": jobs[0]["id"], "put": ("both", "1")}, {"id": jobs[0]["id"], "delete": "both"}, {"put": ("whole", "1")}]
    store.kv_put({"both": "0"})
    version = store.meta["version"]
    # an ack, a nack that retries (its effects don't commit), a nack that kills, and a lost claim
    said, enqueued = store.settle_with([(*pair(0), "ack", None), (*pair(1), "nack", "boom"), (*pair(2), "nack", "last"), (jobs[3]["id"], 999, "ack", None)], effects)
    got = {r["id"]: (r["fence"], r["outcome"]) for r in said.collect()}
    assert [got[jobs[n]["id"]] for n in range(4)] == [("Current", "Completed"), ("Current", "Retried"), ("Current", "DeadLettered"), ("ClaimLost", None)]
    assert store.meta["version"] == version + 1  # one version for all of it
    assert store.kv_many(["done/0", "done/1", "done/2", "done/3", "both", "whole"]) == {"done/0": "1", "done/2": "1"}
    assert sorted(r["outcome"] for r in enqueued.collect()) == ["New", "New"] and store.stats("next")["pending"] == 2
    assert [r["fence"] for r in store.dead_letter([pair(4)], "bad", {"why": "bad"}).collect()] == ["Current"] and store.kv_get("why") == "bad"
    # an enqueue that finds its key taken drops itself, not the settlement
    job = store.claim("q", 1).first()
    _, again = store.settle_with([(job["id"], job["claim_token"], "ack", None)], [{"id": job["id"], "enqueue": {"queue": "next", "payload": "x", "dedup_key": "n0"}}])
    assert [r["outcome"] for r in again.collect()] == ["AlreadyEnqueued"] and store.get_job(job["id"])["status"] == "Done"
    # a removal's effects commit, those of a job that isn't there do not
    waiting = store.list_jobs("next", "Pending", 1).first()["id"]
    assert store.cancel([waiting], {"gone": "1"}) == {waiting: "Removed"} and store.kv_get("gone") == "1"
    assert store.cancel(["nobody"], {"gone": "2"}) == {"nobody": "NotFound"} and store.kv_get("gone") == "1"


def test_removal_deletes_history_and_payloads(spark, tmp_path, clock):
    store = TaskStore(spark, str(tmp_path / "s"), {"q": QueueConfig(max_attempts=2, backoff_base_ms=0, keep_done_ms=5000, dead_retention_ms=5000)}, clock, offload_bytes=10)
    store.enqueue([{"queue": "q", "payload": "a payload that is long", "id": i} for i in ("one", "two", "three", "four")] + [{"queue": "free", "payload": "another long payload", "id": "five"}])
    assert store.get_job("one")["payload"] is None and store.table("payloads").count() == 5
    jobs = {r["id"]: r for r in store.claim("q", 9).collect()} | {r["id"]: r for r in store.claim("free", 9).collect()}
    assert bytes(jobs["one"]["payload"]) == b"a payload that is long" and not jobs["one"]["payload_missing"]
    store.settle_with([(i, jobs[i]["claim_token"], a, "e") for i, a in (("one", "ack"), ("two", "dead_letter"), ("three", "nack"), ("four", "nack"), ("five", "ack"))])
    assert store.get_job("five") is None and store.attempt_history("five") == [] and store.stats("free")["done"] == 1  # done jobs of this queue aren't kept
    assert {r["id"] for r in store.table("payloads").collect()} == {"one", "two", "three", "four"}
    assert store.cancel(["four"]) == {"four": "Removed"} and store.attempt_history("four") == []
    clock.now += 5001
    assert store.sweep() == 2 and store.attempt_history("one") == store.attempt_history("two") == []
    assert [h["outcome"] for h in store.attempt_history("three")] == ["Retried"] and {r["id"] for r in store.table("payloads").collect()} == {"three"}
    store.enqueue([{"queue": "q", "payload": "x", "id": "one"}])
    (job,) = [r for r in store.claim("q", 9).collect() if r["id"] == "one"]
    store.nack([("one", job["claim_token"])], "again")
    assert [h["error"] for h in store.attempt_history("one")] == ["again"]  # the new job's history alone
    store._publish(payloads=spark.createDataFrame([("three", None)], "id STRING, payload BINARY"))
    store.reap()
    assert [r["payload_missing"] for r in store.payload_of(store.table("jobs").where("id = 'three'")).collect()] == [True]


def test_leases_waits_and_kv_with_a_job(store, clock):
    out = store.enqueue([{"queue": "q", "payload": "a", "dedup_key": "k", "kv": {"job/a": "queued"}}, {"queue": "q", "payload": "b", "dedup_key": "k", "kv": {"job/b": "queued"}}]).collect()
    assert store.kv_many(["job/a", "job/b"]) == {"job/a": "queued"} and out[0]["id"] < store.enqueue([{"queue": "z", "payload": "c"}]).first()["id"] and len(out[0]["id"]) == 26
    job = store.claim("q", 1).first()
    pair, end = (job["id"], job["claim_token"]), job["lease_expires_at"]
    assert [(r["fence"], r["lease_expires_at"]) for r in store.extend([pair], 10).collect()] == [("Current", end)]
    assert [(r["fence"], r["lease_expires_at"]) for r in store.renew([pair], 10).collect()] == [("Current", clock.now + 10)]
    assert [r["fence"] for r in store.renew([(job["id"], 77)], 10).collect()] == ["ClaimLost"]
    assert store.cancel([job["id"]]) == {job["id"]: "Requested"} and [r["fence"] for r in store.renew([pair], 99).collect()] == ["CancelRequested"]

    def pause(ms):
        clock.now += ms

    assert store.wait_for_completion("nobody", 10, pause) == ("NotFound", None) and store.wait_for_completion(job["id"], 300, pause) == ("TimedOut", None)
    assert store.wait_for_completion(job["id"], 10_000, lambda ms: store.ack([pair]))[1]["status"] == "Done"
    store.enqueue([{"queue": "z", "payload": "d", "id": "later", "run_at": clock.now + 50}])
    assert store.wait_for_completion("later", 10_000, lambda ms: store.cancel(["later"])) == ("Completed", None)
    store.enqueue([{"queue": "z", "payload": "d", "id": "later", "run_at": clock.now + 50}])
    assert store.wake(["later"], b"up", {"woke": "1"}) == {"later": "Woken"} and bytes(store.get_job("later")["wake_payload"]) == b"up" and store.kv_get("woke") == "1"


def test_memo_effects_and_sinks(spark, store, tmp_path, clock):
    from millrace.sources.sinks import JsonlSink, write_report

    calls = tmp_path / "calls"
    calls.mkdir()

    def pipeline(n, ctx):
        import uuid

        def compute():
            (calls / f"{n}-{uuid.uuid4().hex}").write_text("x")
            return n * ctx.state("times")

        ctx.put(f"seen/{n}", ctx.job_id)
        value = ctx.memoize("multiply", n, compute)
        if ctx.attempt < 2 and n == 2:
            raise RuntimeError("after the memo")
        if n == 3:
            ctx.submit("after", json.dumps(n))
        return value

    import json

    sink = JsonlSink(str(tmp_path / "out"))
    report = workers.run_bulk(store, spark.createDataFrame([("r1", "1"), ("r2", "2"), ("r3", "3")], "run_id STRING, item STRING"), pipeline, queue="q", sink=sink, state={"times": 10})
    assert (report.total, report.succeeded, report.results) == (3, 3, {"r1": 10, "r2": 20, "r3": 30})
    assert len(list(calls.iterdir())) == 3  # the retried item took the stored value
    assert store.kv_many(["seen/1", "seen/2", "seen/3"]) == {"seen/1": "r1", "seen/2": "r2", "seen/3": "r3"} and store.stats("after")["pending"] == 1
    sink.write(spark.createDataFrame([("r1", "failed", None, "late")], "run_id STRING, status STRING, output STRING, error STRING"))
    assert sorted((r["run_id"], r["output"]) for r in sink.read(spark).collect()) == [("r1", "10"), ("r2", "20"), ("r3", "30")]
    write_report(report.outputs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_replay_and_durable_notifications(store, clock, tmp_path):
    from millrace.plans.runs import ENDED, Runs

    ran, told, broken = tmp_path / "ran", [], [True]
    ran.mkdir()

    def step(s):
        import uuid

        (ran / uuid.uuid4().hex).write_text(s["run_id"])
        return {"kind": "Succeed", "result": s["payload"]}

    def hook(o):
        if broken:
            raise RuntimeError("down")
        told.append((o["run_id"], o["status"], o["result"]))

    runs = Runs(store, "q", hook)
    runs.submit("a", 5)
    stop = store.settle_with
    store.settle_with = lambda *a, **k: (_ for _ in ()).throw(Crash())  # the outcome is stored, its settlement is lost
    with pytest.raises(Crash):
        runs.work(step, rounds=1)
    store.settle_with = stop
    clock.now += 1000
    runs.work(step, rounds=1)
    assert len(list(ran.iterdir())) == 1 and told == [] and runs.status("a") is None
    broken.clear()
    clock.now += 10_000
    store.promote()
    assert runs.deliver() == 1 and told == [("a", "succeeded", 5)] and runs.deliver() == 0
    assert runs.signal("k", 1) == "Buffered" and runs.clear_signal("k") and not runs.clear_signal("k")
    store.kv_put({workers.memo_key("a", "s", 1): "2", workers.memo_key("b", "s", 1): "2"})
    assert [r["key"][: len(ENDED)] for r in store.kv_scan(ENDED).collect()] == [ENDED]
    clock.now += 10_000
    runs.sweep(1000)
    assert store.kv_scan(ENDED).count() == 0 and store.kv_many([workers.memo_key("a", "s", 1), workers.memo_key("b", "s", 1)]) == {workers.memo_key("b", "s", 1): "2"}
    runs.clear_memos("b")
    assert store.kv_scan(workers.MEMO).count() == 0


class Adder:
    name, max_attempts = "add", 2

    def idempotency_key(self, x):
        return x["key"]

    def run(self, x, ctx):
        if x.get("bad"):
            raise ValueError("cannot")
        if x.get("down"):
            raise RuntimeError("down")
        return x["a"] + x["b"]

    def classify(self, error):
        return "Permanent" if isinstance(error, ValueError) else "Transient"


def test_typed_jobs(store, clock):
    from millrace.plans.jobs import InputMismatch, JobFailed, JobRunner

    runner = JobRunner(store, [Adder()], "q")
    said, first = runner.submit_idempotent("add", {"key": "k", "a": 1, "b": 2})
    again, second = runner.submit_idempotent("add", {"key": "k", "a": 1, "b": 2})
    assert (said, again, first.id) == ("Enqueue", "Pending", second.id) and first.status() == "Pending"
    with pytest.raises(InputMismatch):
        runner.submit_idempotent("add", {"key": "k", "a": 1, "b": 3})
    bad, down, odd = runner.submit("add", {"bad": 1}), runner.submit("add", {"down": 1}), store.enqueue([{"queue": "q", "payload": "1", "headers": {"type": "none"}}]).first()["id"]
    assert runner.work() == 5
    assert first.join() == 3 and runner.submit_idempotent("add", {"key": "k", "a": 1, "b": 2})[0] == "Cached"
    for handle, attempts in ((bad, 1), (down, 2)):
        with pytest.raises(JobFailed):
            handle.join()
        assert store.get_job(handle.id)["attempts"] == attempts
    assert store.get_job(odd)["last_error"] == "unknown job type none"
