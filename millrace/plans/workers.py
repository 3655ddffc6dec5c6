"""Worker loops and bulk runs: claimed jobs go to Python handlers on the executors, outcomes come back as rows.

A handler is called with ``(payload, headers, attempt)`` and, if it takes a fourth argument, a ``Context``, in
which it stages effects, asks for memoised values and reads shared state. All outcomes of a batch, with
the effects that they stage, are committed as one version of the store.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.store import TaskStore

MEMO, RESULT = "memo/", "bulk/result/"


class PermanentFailure(Exception):
    """A handler raises this where a retry cannot help."""


class FailWith(Exception):
    """A failure whose staged effects commit if the job dies of it; ``permanent`` kills it at once."""

    def __init__(self, message: str, permanent: bool = False):
        super().__init__(message)
        self.permanent = permanent


def memo_key(run_id: str, step: str, payload) -> str:
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return f"{MEMO}{sha(run_id)}/{step}/{sha(json.dumps(payload, sort_keys=True))}"


class Context:
    """What a handler may do besides returning; sealed when it returns."""

    def __init__(self, job_id: str, attempt: int, headers: dict, memos: dict, state: dict):
        self.job_id, self.attempt, self.headers, self._memos, self._state = job_id, attempt, headers, memos, state
        self.effects: list[dict] = []
        self.learned: dict[str, str] = {}
        self._sealed = False

    def _stage(self, **effect) -> None:
        if self._sealed:
            raise RuntimeError("effects are staged before the handler returns")
        self.effects.append(effect)

    def put(self, key: str, value: str) -> None:
        if any(e.get("delete") == key for e in self.effects):
            raise PermanentFailure(f"{key} is both written and deleted")
        self._stage(put=(key, value))

    def delete(self, key: str) -> None:
        if any("put" in e and e["put"][0] == key for e in self.effects):
            raise PermanentFailure(f"{key} is both written and deleted")
        self._stage(delete=key)

    def submit(self, queue: str, payload: str, **more) -> None:
        """Another job, that is enqueued if this one's outcome commits."""
        self._stage(enqueue={"queue": queue, "payload": payload, **more})

    def state(self, name: str):
        return self._state[name]

    def memoize(self, step: str, payload, compute: Callable[[], object]):
        """The stored value of (run, step, payload), else what ``compute`` gives; errors are not kept, and what cannot be read is a miss.

        New values are stored with the batch, whatever becomes of the job.
        """
        key = memo_key(self.headers.get("run_id", self.job_id), step, payload)
        for known in (self.learned, self._memos):
            try:
                return json.loads(known[key])
            except (KeyError, ValueError):
                pass
        value = compute()
        self.learned[key] = json.dumps(value)
        return value


OUTCOME = "id STRING, token BIGINT, outcome STRING, error STRING, result STRING, effects STRING, learned STRING"


def with_memos(store: TaskStore, claimed: DataFrame) -> DataFrame:
    """``claimed`` with ``memos``, the stored values of each job's run."""
    run = F.coalesce(F.element_at("headers", "run_id"), F.col("id"))
    own = claimed.withColumn("_run", F.sha2(run.cast("binary"), 256))
    kept = store.table("kv").where(F.col("key").startswith(MEMO)).withColumn("_run", F.split_part("key", F.lit("/"), F.lit(2)))
    kept = kept.join(F.broadcast(own.select("_run").distinct()), "_run", "left_semi")  # a batch's runs
    kept = kept.groupBy("_run").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("memos"))
    return own.join(kept, "_run", "left").drop("_run")


def process(claimed: DataFrame, handler: Callable, concurrency: int = 16, state: dict | None = None) -> DataFrame:
    """One row of ``OUTCOME`` for each claimed job; the handler runs in parallel tasks."""
    in_context = len(inspect.signature(handler).parameters) > 3
    names = [c.split()[0] for c in OUTCOME.split(", ")]

    def go(batches):
        for batch in batches:
            out = []
            for job, token, payload, headers, attempt, missing, memos in zip(*(c.to_pylist() for c in batch.columns)):
                ctx, said, result, keep = Context(job, attempt, dict(headers or []), dict(memos or []), state or {}), ("ack", None), None, True
                try:
                    if missing:
                        raise PermanentFailure("payload missing")
                    result = json.dumps(handler(payload, ctx.headers, attempt, ctx) if in_context else handler(payload, ctx.headers, attempt))
                except FailWith as e:
                    said = ("dead_letter" if e.permanent else "nack"), str(e)
                except PermanentFailure as e:
                    said, keep = ("dead_letter", str(e)), False
                except Exception as e:
                    said, keep = ("nack", str(e)), False
                ctx._sealed = True
                out.append((job, token, *said, result, json.dumps(ctx.effects if keep else []), json.dumps(ctx.learned)))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "token" else pa.string()) for n, c in zip(names, cols)], names)

    if "memos" not in claimed.columns:
        claimed = claimed.withColumn("memos", F.lit(None).cast("map<string,string>"))
    missing = F.col("payload_missing") if "payload_missing" in claimed.columns else F.lit(False)
    own = claimed.select("id", F.col("claim_token").alias("token"), "payload", "headers", "attempts", missing.alias("payload_missing"), "memos")
    return own.repartition(concurrency, "id").mapInArrow(go, OUTCOME)


def effects_of(row) -> list[dict]:
    """Effects of one outcome row, in the form that the store takes."""
    return [{"id": row["id"], **({"put": tuple(e["put"])} if "put" in e else e)} for e in json.loads(row["effects"])]


def settle(store: TaskStore, rows: list, more: Callable[[object], list[dict]] = lambda row: []) -> None:
    """Commit a batch's outcome rows, their effects and learned memos as one version."""
    learned = {k: v for r in rows for k, v in json.loads(r["learned"]).items()}
    store.settle_with([(r["id"], r["token"], r["outcome"], r["error"]) for r in rows], [e for r in rows for e in [*effects_of(r), *more(r)]], learned)


def run_worker(store: TaskStore, queue: str, handler, batch: int = 64, rounds: int = 1_000, concurrency: int = 16, on_result=None, state: dict | None = None, more: Callable[[object], list[dict]] = lambda row: []) -> int:
    """Claim, process and settle until the queue has nothing pending; returns how many jobs were processed.

    Due jobs are promoted and expired leases reaped between batches. A batch is at most ``batch`` rows,
    so its outcomes may come to the driver. ``more`` gives further effects of an outcome row.
    """
    done = 0
    for _ in range(rounds):
        store.reap()
        store.promote()
        claimed = store.claim(queue, batch)
        if len(inspect.signature(handler).parameters) > 3:
            claimed = with_memos(store, claimed)
        rows = process(claimed, handler, concurrency, state).collect()
        if not rows:
            break
        done += len(rows)
        if on_result is not None:
            on_result(rows)
        settle(store, rows, more)
    return done


@dataclass
class BulkReport:
    """``outputs``: rows (run_id, status, output, error) of all items, succeeded, failed or NULL while under way."""

    total: int
    succeeded: int
    failed: int
    outputs: DataFrame

    @property
    def results(self) -> dict:
        return {r["run_id"]: json.loads(r["output"]) for r in self.outputs.where("status = 'succeeded'").collect()}

    @property
    def failed_run_ids(self) -> list[str]:
        return [r["run_id"] for r in self.outputs.where("status = 'failed'").orderBy("run_id").select("run_id").collect()]

    def exceeds(self, percent: float) -> bool:
        """Whether the share of failures is strictly above a threshold."""
        return self.total > 0 and self.failed / self.total * 100 > percent


def run_bulk(store: TaskStore, items: DataFrame | Iterable, pipeline: Callable, queue: str = "bulk", key: Callable[[object], str] | None = None, batch: int = 256, headers: dict | None = None, sink=None, state: dict | None = None, concurrency: int = 16) -> BulkReport:
    """Submit each item once by its run id, run the pipeline over all, and report.

    ``items``: rows ``(run_id, item)`` with JSON items, or values, whose run ids are ``item-<place>`` or
    ``key(item)``. An item whose run id is known already is not submitted again. The pipeline is called with an item
    and, if it takes a second argument, a ``Context``. An output is stored in the version that acknowledges its
    job; a ``sink`` gets the outputs of every batch too.
    """
    spark = store.spark
    if not isinstance(items, DataFrame):
        rows = [(key(x) if key else f"item-{n}", json.dumps(x)) for n, x in enumerate(items)]
        items = spark.createDataFrame(rows, "run_id STRING, item STRING")
    head = F.map_from_arrays(F.array(*[F.lit(k) for k in headers]), F.array(*[F.lit(v) for v in headers.values()])) if headers else F.lit(None)
    own = store._stage(items.select(F.col("run_id").alias("id"), F.lit(queue).alias("queue"), F.col("item").cast("binary").alias("payload"), head.cast("map<string,string>").alias("headers")))
    known = store.table("kv").where(F.col("key").startswith(RESULT)).select(F.expr(f"substr(key, {len(RESULT) + 1})").alias("id"))
    total = store.enqueue(own.join(known, "id", "left_anti")).where("outcome = 'New'").count()

    if len(inspect.signature(pipeline).parameters) > 1:
        def handler(payload: bytes, headers: dict, attempt: int, ctx):
            return pipeline(json.loads(payload), ctx)
    else:
        def handler(payload: bytes, headers: dict, attempt: int):
            return pipeline(json.loads(payload))

    def store_output(row) -> list[dict]:
        return [{"id": row["id"], "put": (RESULT + row["id"], row["result"])}] if row["outcome"] == "ack" else []

    emit = None
    if sink is not None:
        def emit(rows):
            ended = [(r["id"], "succeeded", r["result"], None) for r in rows if r["outcome"] == "ack"]
            sink.write(spark.createDataFrame(ended, "run_id STRING, status STRING, output STRING, error STRING"))

    run_worker(store, queue, handler, batch, concurrency=concurrency, on_result=emit, state=state, more=store_output)
    good = store.table("kv").where(F.col("key").startswith(RESULT)).select(F.expr(f"substr(key, {len(RESULT) + 1})").alias("run_id"), F.col("value").alias("output"))
    dead = store.table("jobs").where((F.col("queue") == queue) & (F.col("status") == "Dead")).select(F.col("id").alias("run_id"), F.col("last_error").alias("error"), F.lit(True).alias("_dead"))
    out = own.select(F.col("id").alias("run_id")).distinct().join(good, "run_id", "left").join(dead, "run_id", "left")
    out = store._stage(out.select("run_id", F.when(F.col("output").isNotNull(), "succeeded").when(F.col("_dead"), "failed").alias("status"), "output", F.when(F.col("output").isNull(), F.col("error")).alias("error")))
    if sink is not None:
        sink.write(out.where("status = 'failed'"))
        sink.flush()
    tally = {r["status"]: r["n"] for r in out.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return BulkReport(total, tally.get("succeeded", 0), tally.get("failed", 0), out)
