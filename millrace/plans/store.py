"""A task store as versions of tables in a folder.

One driver writes; every call applies one batch of commands as set-based transitions and commits all that
follows from them (jobs, history, payloads, key-value entries, counters, new jobs) as one version, or none of
it (``versions``). A version adds the rows that changed; a table is read as its base with the latest changed
row of each key, and merged into a new base after ``MERGE_AT`` changes, so the cost of a call follows what it
changes. ``StoreReader`` opens the current version in any process and keeps a stable snapshot until ``refresh``.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import scalars as S
from millrace.operators import inspect as I
from millrace.operators import transitions as Z
from millrace.operators.kv import fold
from millrace.plans.versions import Versions
from millrace.schemas import ATTEMPT, KV, QueueConfig
from millrace.shipping import ship

JOBS = """id STRING, queue STRING, payload BINARY, payload_ref STRING, headers MAP<STRING, STRING>, status STRING, attempts BIGINT,
max_attempts BIGINT, enqueued_at BIGINT, claimed_at BIGINT, run_at BIGINT, woken_at BIGINT, wake_payload BINARY, priority BIGINT,
last_error STRING, dedup_key STRING, completed_at BIGINT, failed_at BIGINT, cancel_requested BOOLEAN, claim_token BIGINT,
lease_expires_at BIGINT"""
COUNTERS = "queue STRING, metric STRING, delta BIGINT"
TABLES = {"jobs": JOBS, "attempts": ATTEMPT, "kv": KV, "counters": COUNTERS, "payloads": "id STRING, payload BINARY"}
# key of a table whose last row wins, and the column that is NULL in a row that deletes
KEYED = {"jobs": ("id", "status"), "kv": ("key", "value"), "payloads": ("id", "payload")}
COMMANDS = "n BIGINT, owner STRING, id STRING, queue STRING, payload BINARY, headers MAP<STRING, STRING>, max_attempts BIGINT, run_at BIGINT, priority BIGINT, dedup_key STRING, kv MAP<STRING, STRING>"
OUTCOMES = "id STRING, token BIGINT, action STRING, error STRING"
MERGE_AT = 12
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@functools.cache
def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _write(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance").write.parquet(path)  # few rows make one file, many make files of a good size


class _Tables:
    """Reads over one version."""

    spark: SparkSession
    meta: dict

    def _columns(self, name: str) -> list[str]:
        return _schema(TABLES[name]).names

    def _typed(self, name: str) -> list:
        return [F.col(f.name).cast(f.dataType) for f in _schema(TABLES[name]).fields]

    def table(self, name: str) -> DataFrame:
        parts, schema = self.meta["tables"].get(name, []), _schema(f"{TABLES[name]}, _v BIGINT")
        if not parts:
            return self.spark.createDataFrame([], _schema(TABLES[name]))
        read = lambda paths: self.spark.read.schema(schema).parquet(*paths)
        if name == "counters":
            return read(parts).drop("_v")
        if name == "attempts":  # a row without an outcome deletes a job's history up to its version
            rows = read(parts)
            gone = rows.where("outcome IS NULL").groupBy("id").agg(F.max("_v").alias("_gone"))
            return rows.where("outcome IS NOT NULL").join(gone, "id", "left").where("_gone IS NULL OR _v > _gone").select(*self._columns(name))
        key, alive = KEYED[name]
        base = read(parts[:1]).drop("_v")
        if len(parts) > 1:
            last = read(parts[1:]).groupBy(key).agg(F.max_by(F.struct(*self._columns(name)), "_v").alias("r")).select("r.*")
            base = base.join(last.select(key), key, "left_anti").unionByName(last)
        return base.where(F.col(alive).isNotNull())

    # ------------------------------------------------------------ reads

    def get_job(self, job_id: str):
        return self.table("jobs").where(F.col("id") == job_id).first()

    def list_jobs(self, queue: str, status: str, limit: int, cursor: tuple | None = None) -> DataFrame:
        return I.list_jobs(self.table("jobs"), queue, status, limit, cursor)

    def stats(self, queue: str) -> dict[str, int]:
        """Five counters; zeros for a queue that never had a job."""
        got = {r["metric"]: r["n"] for r in self.table("counters").where(F.col("queue") == queue).groupBy("metric").agg(F.sum("delta").alias("n")).collect()}
        return {m: got.get(m, 0) for m in ("pending", "claimed", "done", "dead", "scheduled")}

    def list_queues(self) -> list[str]:
        return [r["queue"] for r in I.list_queues(self.table("counters")).orderBy("queue_bytes", "queue").collect()]

    def attempt_history(self, job_id: str) -> list:
        return self.table("attempts").where(F.col("id") == job_id).orderBy("recorded_at", "attempt").collect()

    def kv_get(self, key: str) -> str | None:
        r = self.table("kv").where(F.col("key") == key).first()
        return r and r["value"]

    def kv_many(self, keys: Iterable[str]) -> dict[str, str]:
        """Values of the keys that are there."""
        own = self.spark.createDataFrame([(k,) for k in set(keys)], "key STRING")
        return {r["key"]: r["value"] for r in self.table("kv").join(F.broadcast(own), "key", "left_semi").collect()}

    def kv_scan(self, prefix: str = "", limit: int = 100, after: str | None = None) -> DataFrame:
        """A page (key, value) of keys with a prefix in the order of their bytes, beyond ``after``."""
        at = F.col("key").cast("binary")
        rows = self.table("kv").where(F.col("key").startswith(prefix))
        if after is not None:
            rows = rows.where(at > F.lit(after).cast("binary"))
        return rows.orderBy(at).limit(limit)

    def payload_of(self, jobs: DataFrame) -> DataFrame:
        """``jobs`` with their payloads in place, and ``payload_missing`` where one that is kept apart is gone."""
        far = self.table("payloads").select(F.col("id").alias("payload_ref"), F.col("payload").alias("_far"))
        out = jobs.join(far, "payload_ref", "left").withColumn("payload_missing", F.col("payload_ref").isNotNull() & F.col("_far").isNull())
        return out.withColumn("payload", F.coalesce("payload", "_far")).select(*jobs.columns, "payload_missing")


class StoreReader(_Tables):
    """A read-only view; ``follow`` moves to the current version before each read, else ``refresh`` does when it is called."""

    def __init__(self, spark: SparkSession, path: str, follow: bool = False):
        self.spark, self.log, self.follow = spark, Versions(spark, path), follow
        self.refresh()

    def refresh(self) -> int:
        found = self.log.latest()
        if found is None:
            raise FileNotFoundError(f"no store at {self.log.path}")
        self.meta = found
        return found["version"]

    def table(self, name: str) -> DataFrame:
        if self.follow:
            self.refresh()
        return super().table(name)


class TaskStore(_Tables):
    """The writer. ``clock`` gives epoch milliseconds; payloads of more than ``offload_bytes`` are kept apart (None: never).

    Opening takes the folder over: an earlier writer's next call raises ``StaleWriter``. With ``recover`` claims
    that no one settled go back to their queues.
    """

    def __init__(self, spark: SparkSession, path: str, configs: dict[str, QueueConfig] | None = None, clock: Callable[[], int] | None = None, default: QueueConfig = QueueConfig(), recover: bool = True, offload_bytes: int | None = 262_144):
        self.spark, self.path, self.default, self.offload_bytes = spark, path.rstrip("/"), default, offload_bytes
        self.configs, self.clock = dict(configs or {}), clock or (lambda: int(time.time() * 1000))
        ship(spark)
        self.log, self.closed = Versions(spark, self.path), False
        before = self.log.latest()
        self.meta = (before or {"version": -1, "epoch": 0, "next_id": 0, "last_ms": 0, "next_token": 1, "tables": {}}) | {"closed_at": None}
        self.meta = self.meta | {"version": self.meta["version"] + 1, "epoch": self.meta["epoch"] + 1}
        self.log.publish(self.meta, before)
        if recover:
            self._requeue_interrupted()

    # ------------------------------------------------------------ versions

    def _publish(self, meta: dict | None = None, **frames: DataFrame | None) -> None:
        """Commit rows that changed: of keyed tables whole rows (deleting ones too), of the others rows to add."""
        if self.closed:
            raise RuntimeError("the store is closed")
        version, tables = self.meta["version"] + 1, dict(self.meta["tables"])
        folder = self.log.folder(version)
        rows = {n: df.select(*self._typed(n), F.lit(version).cast("bigint").alias("_v")) for n, df in frames.items() if df is not None}
        with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables of a version are written side by side
            list(pool.map(lambda n: _write(rows[n], f"{folder}/{n}"), rows))
        for name in rows:
            tables[name] = [*tables.get(name, []), f"{folder}/{name}"]
        new = self.meta | (meta or {}) | {"version": version, "tables": tables}
        self.log.publish(new, self.meta)
        self.meta = new
        self._merge([n for n in tables if len(tables[n]) > MERGE_AT])

    def _merge(self, names: list[str]) -> None:
        """One version that rewrites tables of many parts as one."""
        if not names:
            return
        version, tables = self.meta["version"] + 1, dict(self.meta["tables"])
        folder = self.log.folder(version)
        for name in names:
            rows = self.table(name)
            if name == "counters":
                rows = rows.groupBy("queue", "metric").agg(F.sum("delta").alias("delta"))
            _write(rows.select(*self._typed(name), F.lit(version).cast("bigint").alias("_v")), f"{folder}/{name}")
            tables[name] = [f"{folder}/{name}"]
        new = self.meta | {"version": version, "tables": tables}
        self.log.publish(new, self.meta)
        self.meta = new

    def vacuum(self, keep: int = 16) -> None:
        self.log.vacuum(keep)

    def close(self) -> None:
        """Record a clean end; the store takes no more calls."""
        self._publish({"closed_at": self.clock()})
        self.closed = True

    def _stage(self, df: DataFrame) -> DataFrame:
        """Rows written once beside the versions, that are read more than once."""
        at = f"{self.path}/stage/{uuid.uuid4().hex}"
        _write(df, at)
        return self.spark.read.schema(df.schema).parquet(at)

    def config(self) -> DataFrame:
        rows = [(q, c.max_attempts, c.lease_ms, c.default_priority, c.backoff_base_ms, c.backoff_max_ms, c.keep_done_ms, c.dead_retention_ms) for q, c in self.configs.items()]
        return self.spark.createDataFrame(rows, "queue STRING, cfg_max_attempts BIGINT, lease_ms BIGINT, default_priority BIGINT, base_ms BIGINT, max_ms BIGINT, keep_done_ms BIGINT, dead_retention_ms BIGINT")

    def _configured(self, jobs: DataFrame) -> DataFrame:
        return I.effective_config(jobs, self.config(), self.default)

    def _moved(self, after: DataFrame) -> DataFrame:
        """Counter deltas of rows ``(queue, was, status)``; done only ever grows, and an acknowledged job is done in any case."""
        delta = lambda df, metric, n: df.select("queue", F.lower(metric).alias("metric"), F.lit(n).cast("bigint").alias("delta")).where("metric IS NOT NULL")
        return delta(after.where("was <> 'Done'"), F.col("was"), -1).unionByName(delta(after, F.col("status"), 1))

    def _gone(self, ids: DataFrame) -> dict[str, DataFrame]:
        """Rows that delete jobs, their history and their payloads."""
        none = lambda names: [F.lit(None).alias(c) for c in names]
        rest = lambda name: none(c for c in self._columns(name) if c not in ("id", "queue"))
        queue = F.lit(None).cast("string").alias("queue")
        return {"attempts": ids.select("id", queue, *rest("attempts")), "payloads": ids.where("payload_ref IS NOT NULL").select("id", *rest("payloads"))}

    # ------------------------------------------------------------ enqueue

    def _commands(self, commands: DataFrame | Iterable[dict]) -> DataFrame:
        """Commands as rows with ids and defaults. Ids are ULIDs: the time, which never goes back, then a number that only grows."""
        if isinstance(commands, DataFrame):
            have = set(commands.columns)
            kind = {f.name: f.dataType for f in _schema(COMMANDS).fields}
            cmds = commands.select(*[F.col(c).cast(kind[c]).alias(c) if c in have else F.lit(None).cast(kind[c]).alias(c) for c in kind if c != "n"], F.monotonically_increasing_id().alias("n"))
        else:
            rows = []
            for c in commands:
                payload = c.get("payload", b"")
                rows.append((len(rows), c.get("owner"), c.get("id"), c["queue"], payload.encode() if isinstance(payload, str) else payload, c.get("headers") or {}, c.get("max_attempts"), c.get("run_at"), c.get("priority"), c.get("dedup_key"), c.get("kv")))
            cmds = self.spark.createDataFrame(rows, COMMANDS)
        cmds = self._stage(cmds)
        bad = cmds.where(~F.coalesce(S.valid_queue_name("queue"), F.lit(False)) | ~S.valid_id(F.coalesce("id", F.lit("x"))))
        if (row := bad.select("queue", "id").first()) is not None:
            raise ValueError(f"queue {row['queue']!r} needs 1 to 255 bytes, id {row['id']!r} 1 to 128 letters, digits, - or _")
        own = self._configured(cmds.withColumnRenamed("max_attempts", "_most"))
        ms = max(self.clock(), self.meta["last_ms"])
        head = "".join(_BASE32[(ms >> s) & 31] for s in range(45, -1, -5))
        tail = F.translate(F.conv((F.col("n") + self.meta["next_id"]).cast("string"), 10, 32), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)
        return own.withColumns({"id": F.coalesce("id", F.concat(F.lit(head), F.lpad(tail, 16, "0"))), "max_attempts": F.coalesce("_most", "cfg_max_attempts"), "priority": F.coalesce("priority", "default_priority"), "headers": F.coalesce("headers", F.expr("CAST(map() AS MAP<STRING, STRING>)"))}).select(*_schema(COMMANDS).names)

    def _counted(self, cmds: DataFrame) -> dict:
        """What the ids of these commands use up."""
        top = cmds.agg(F.max("n")).first()[0]
        return {"next_id": self.meta["next_id"] + (0 if top is None else top + 1), "last_ms": max(self.clock(), self.meta["last_ms"])}

    def _admit(self, cmds: DataFrame) -> DataFrame:
        """Commands with ``outcome`` and ``existing``. A dedup key is checked before an id in use; of equal keys
        in one call, among commands whose ids are free, the first wins, and so of equal ids."""
        out = Z.dedup_against(self.table("jobs"), cmds)
        new = out.where("outcome = 'New'")
        key = new.where("dedup_key IS NOT NULL").groupBy("queue", "dedup_key").agg(F.min(F.struct("n", "id")).alias("_first"))
        out = out.join(key, ["queue", "dedup_key"], "left")
        again = (F.col("outcome") == "New") & (F.col("_first.n") < F.col("n"))
        out = out.withColumn("existing", F.when(again, F.col("_first.id")).otherwise(F.col("existing"))).withColumn("outcome", F.when(again, "AlreadyEnqueued").otherwise(F.col("outcome"))).drop("_first")
        used = out.where("outcome = 'New'").groupBy("id").agg(F.min("n").alias("_n"))
        out = out.join(used, "id", "left")
        out = out.withColumn("outcome", F.when((F.col("outcome") == "New") & (F.col("_n") < F.col("n")), "DuplicateJobId").otherwise(F.col("outcome"))).drop("_n")
        return self._stage(out)

    def _frames_of_new(self, admitted: DataFrame) -> dict[str, DataFrame]:
        """Rows of the jobs that admitted commands make, their payloads, counters and key-value writes."""
        now = self.clock()
        new = Z.prepared(admitted.where("outcome = 'New'").withColumn("now", F.lit(now)))
        far = F.lit(False) if self.offload_bytes is None else F.length("payload") > self.offload_bytes
        new = new.withColumns({"attempts": F.lit(0).cast("bigint"), "enqueued_at": F.lit(now).cast("bigint"), "cancel_requested": F.lit(False), "payload_ref": F.when(far, F.col("id"))})
        have = set(new.columns)
        jobs = new.withColumn("payload", F.when(~F.coalesce(far, F.lit(False)), F.col("payload"))).select(*[c if c in have else F.lit(None).alias(c) for c in self._columns("jobs")])
        kv = new.where("kv IS NOT NULL").select("n", F.explode("kv").alias("key", "value")).groupBy("key").agg(F.max_by("value", "n").alias("value"))
        return {
            "jobs": jobs, "payloads": new.where("payload_ref IS NOT NULL").select("id", "payload"), "kv": kv,
            "counters": new.select("queue", F.lower("status").alias("metric"), F.lit(1).cast("bigint").alias("delta")),
        }

    def enqueue(self, commands: DataFrame | Iterable[dict]) -> DataFrame:
        """``{queue, payload, priority?, max_attempts?, run_at?, dedup_key?, headers?, id?, kv?}`` each, as dicts or rows.

        Rows (n, id, outcome, existing) come back. ``kv`` (key to value) commits with the job, and only with it.
        """
        cmds = self._commands(commands)
        admitted = self._admit(cmds)
        self._publish(self._counted(cmds), **self._frames_of_new(admitted))
        return admitted.select("n", "id", "outcome", "existing").orderBy("n")

    # ------------------------------------------------------------ claims

    def claim(self, queue: str, n: int) -> DataFrame:
        """The first ``n`` pending jobs of a queue with tokens and payloads; their leases start now."""
        now = self.clock()
        rows = self.table("jobs").where((F.col("queue") == queue) & (F.col("status") == "Pending")).orderBy("priority", "id").limit(n)
        got = rows.collect()  # at most n
        if not got:
            return self.payload_of(self.table("jobs").limit(0))
        tokens = self.spark.createDataFrame([(r["id"], self.meta["next_token"] + k) for k, r in enumerate(got)], "id STRING, claim_token BIGINT")
        own = self._configured(self.spark.createDataFrame(got, _schema(JOBS)))
        won = own.drop("claim_token").join(tokens, "id").withColumns({"was": F.col("status"), "status": F.lit("Claimed"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now).cast("bigint"), "dedup_key": F.lit(None).cast("string"), "lease_expires_at": F.lit(now) + F.col("lease_ms")})
        won = self._stage(won)
        self._publish({"next_token": self.meta["next_token"] + len(got)}, jobs=won, counters=self._moved(won))
        return self.payload_of(won.select(*self._columns("jobs"))).orderBy("priority", "id")

    def claim_wait(self, queue: str, n: int, timeout_ms: int, pause: Callable[[int], None] | None = None, poll_ms: int = 200) -> DataFrame:
        """``claim`` as soon as the queue has a pending job; no rows after ``timeout_ms``. Due jobs are promoted at each look."""
        until = self.clock() + timeout_ms
        pause = pause or (lambda ms: time.sleep(ms / 1000))
        while True:
            self.promote()
            got = self.claim(queue, n)
            if self.clock() >= until or not got.isEmpty():
                return got
            pause(max(0, min(poll_ms, until - self.clock())))

    def _pairs(self, settlements) -> DataFrame:
        return settlements.select("id", "token") if isinstance(settlements, DataFrame) else self.spark.createDataFrame(list(settlements), "id STRING, token BIGINT")

    def _effects(self, effects) -> tuple[DataFrame, list[dict]]:
        """Key-value rows (owner, n, key, value) and enqueue commands of effects ``{id?, put | delete | enqueue}``, or of a
        plain mapping from keys to values (None deletes)."""
        if isinstance(effects, dict):
            effects = [{"put": (k, v)} if v is not None else {"delete": k} for k, v in effects.items()]
        kv, cmds = [], []
        for e in effects or ():
            if "enqueue" in e:
                cmds.append(e["enqueue"] | {"owner": e.get("id")})
            else:
                key, value = e["put"] if "put" in e else (e["delete"], None)
                kv.append((e.get("id"), len(kv), key, value))
        return self.spark.createDataFrame(kv, "owner STRING, n BIGINT, key STRING, value STRING"), cmds

    def _with_effects(self, effects, owners: DataFrame, all_owned: bool, frames: dict[str, DataFrame], always: dict[str, str | None] | None = None) -> tuple[dict, DataFrame | None]:
        """Add to ``frames`` what effects write: those of an owner in ``owners(id)``, and those without one if ``all_owned``.

        Enqueues come first, then writes, then deletes, so a key in both is deleted. Returns changes of the counters of ids and
        the verdicts of the enqueues.
        """
        rows, commands = self._effects(effects)
        mine = lambda df: df.join(owners.select(F.col("id").alias("owner")), "owner", "left_semi").unionByName(df.where(F.lit(all_owned) & F.col("owner").isNull()))
        meta, admitted, kv = {}, None, mine(rows).select("n", "key", "value")
        if commands:
            cmds = self._commands(commands)
            meta, admitted = self._counted(cmds), self._admit(mine(cmds))
            new = self._frames_of_new(admitted)
            kv = kv.unionByName(new.pop("kv").select(F.lit(-1).cast("bigint").alias("n"), "key", "value"))
            for name, df in new.items():
                frames[name] = frames[name].unionByName(df, allowMissingColumns=True) if name in frames else df
        if always:
            kv = kv.unionByName(self.spark.createDataFrame([(-2, k, v) for k, v in always.items()], "n BIGINT, key STRING, value STRING"))
        # a delete wins, then the last write; one row for each key
        frames["kv"] = kv.groupBy("key").agg(F.when(F.max(F.col("value").isNull()), F.lit(None).cast("string")).otherwise(F.max_by("value", "n")).alias("value"))
        return meta, admitted

    def settle_with(self, outcomes, effects=None, always: dict[str, str | None] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Settle claimed jobs by rows ``(id, token, action, error)``, action ack, nack or dead_letter, as one version.

        ``effects``: dicts ``{"id": job, "put": (key, value)}``, ``{"id": job, "delete": key}`` or ``{"id": job, "enqueue": command}``.
        Those of a job commit if its token is current and, for a nack, only if it dies; those without an id if every
        settlement is current; key-value writes in ``always`` do in any case. Rows (id, token, action, fence, outcome) and
        the enqueues' verdicts come back.
        """
        now = self.clock()
        o = outcomes.select("id", "token", "action", "error") if isinstance(outcomes, DataFrame) else self.spark.createDataFrame(list(outcomes), OUTCOMES)
        said = self._stage(Z.fenced(self.table("jobs"), o).select("id", "token", "action", "error", "fence"))
        held = self._configured(self.table("jobs").join(said.where("fence = 'Current'").select("id", "action", "error"), "id"))
        held = held.withColumns({"was": F.col("status"), "_claimed": F.col("claimed_at")})
        error = F.col("error")
        ways = {"ack": Z.ack(held.where("action = 'ack'"), now), "nack": Z.nack(held.where("action = 'nack'"), now, error), "dead_letter": Z.dead_letter(held.where("action = 'dead_letter'"), now, error)}
        names = [*self._columns("jobs"), "action", "was", "_claimed", "history"]
        after = self._stage(ways["ack"].select(*names).unionByName(ways["nack"].select(*names)).unionByName(ways["dead_letter"].select(*names)))
        hist = after.where("history IS NOT NULL").select("id", "queue", F.col("attempts").alias("attempt"), F.col("_claimed").alias("claimed_at"), F.lit(now).cast("bigint").alias("recorded_at"), F.col("history").alias("outcome"), F.when(F.col("history") != "Completed", F.col("last_error")).alias("error"))
        gone = self._gone(after.where("status IS NULL"))
        free = {c: F.lit(None).cast("bigint") for c in ("claim_token", "lease_expires_at")}
        done = after.where("status IS NULL").select("queue", F.lit("done").alias("metric"), F.lit(1).cast("bigint").alias("delta"))
        frames = {"jobs": after.withColumns(free).select(*self._columns("jobs")), "attempts": hist.unionByName(gone["attempts"]), "payloads": gone["payloads"], "counters": self._moved(after).unionByName(done)}
        meta, admitted = {}, None
        if effects or always:
            whole = said.where("fence <> 'Current'").limit(1).count() == 0
            meta, admitted = self._with_effects(effects, after.where("action <> 'nack' OR status = 'Dead' OR status IS NULL"), whole, frames, always)
        self._publish(meta, **frames)
        status = after.select("id", F.coalesce(F.when(F.col("history") == "Retried", "Retried"), F.when(F.col("status") == "Dead", "DeadLettered"), F.lit("Completed")).alias("outcome"))
        return said.join(status, "id", "left").select("id", "token", "action", "fence", F.when(F.col("fence") == "Current", F.col("outcome")).alias("outcome")), admitted and admitted.select("n", "owner", "id", "outcome", "existing")

    def _settle(self, settlements, action: str, error: str | None, effects) -> DataFrame:
        rows = self._pairs(settlements).withColumns({"action": F.lit(action), "error": F.lit(error).cast("string")})
        return self.settle_with(rows, effects)[0]

    def ack(self, settlements, effects=None) -> DataFrame:
        """(id, token) pairs; effects commit with them (see ``settle_with``)."""
        return self._settle(settlements, "ack", None, effects)

    def nack(self, settlements, error: str, effects=None) -> DataFrame:
        return self._settle(settlements, "nack", error, effects)

    def dead_letter(self, settlements, reason: str, effects=None) -> DataFrame:
        return self._settle(settlements, "dead_letter", reason, effects)

    def _lease(self, settlements, until) -> DataFrame:
        said = self._stage(Z.fenced(self.table("jobs"), self._pairs(settlements)).select("id", "token", "fence"))
        held = self.table("jobs").join(said.where("fence = 'Current'").select("id"), "id", "left_semi")
        after = self._stage(held.withColumn("lease_expires_at", F.when(F.col("cancel_requested"), F.col("lease_expires_at")).otherwise(until)))
        self._publish(jobs=after)
        now = after.select("id", "lease_expires_at", "cancel_requested")
        return said.join(now, "id", "left").select("id", "token", F.when(F.col("cancel_requested"), "CancelRequested").otherwise(F.col("fence")).alias("fence"), "lease_expires_at")

    def renew(self, settlements, extension_ms: int) -> DataFrame:
        """Leases of (id, token) pairs end ``extension_ms`` from now; a lost claim or one to be cancelled stays. Rows (id, token, fence, lease_expires_at)."""
        return self._lease(settlements, F.lit(self.clock() + extension_ms).cast("bigint"))

    def extend(self, settlements, extension_ms: int) -> DataFrame:
        """As ``renew``, but no lease becomes shorter."""
        return self._lease(settlements, F.greatest("lease_expires_at", F.lit(self.clock() + extension_ms)).cast("bigint"))

    # ------------------------------------------------------------ other transitions

    def _change(self, rows: DataFrame, how: Callable[[DataFrame, int], DataFrame]) -> int:
        """Rewrite rows that a filter chose; returns how many."""
        now = self.clock()
        before = self._configured(rows).withColumns({"was": F.col("status"), "_a": F.col("attempts"), "_c": F.col("claimed_at")})
        after = how(before, now)
        if "history" not in after.columns:
            after = after.withColumn("history", F.lit(None).cast("string"))
        after = self._stage(after.withColumns({c: F.when(F.col("status") == "Claimed", F.col(c)) for c in ("claim_token", "lease_expires_at")}).select(*self._columns("jobs"), "was", "_a", "_c", "history"))
        n = after.count()
        if n:
            again = F.col("history") == "Requeued"
            hist = after.where("history IS NOT NULL").select("id", "queue", F.when(again, 0).otherwise(F.col("_a")).cast("bigint").alias("attempt"), F.when(~again, F.col("_c")).alias("claimed_at"), F.lit(now).cast("bigint").alias("recorded_at"), F.col("history").alias("outcome"), F.when(F.col("history") == "DeadLettered", F.col("last_error")).alias("error"))
            self._publish(jobs=after, attempts=hist, counters=self._moved(after))
        return n

    def promote(self) -> int:
        due = self.table("jobs").where((F.col("status") == "Scheduled") & (F.col("run_at") <= self.clock()))
        return self._change(due, lambda j, now: Z.promote(j, now))

    def reap(self) -> int:
        due = self.table("jobs").where((F.col("status") == "Claimed") & (F.col("lease_expires_at") <= self.clock()))
        return self._change(due, lambda j, now: Z.reap(j, now))

    def _requeue_interrupted(self) -> int:
        return self._change(self.table("jobs").where("status = 'Claimed'"), lambda j, now: Z.reap(j, now, "claim interrupted by process exit", "Interrupted"))

    def requeue_dead(self, ids: Iterable[str]) -> int:
        own = self.spark.createDataFrame([(i,) for i in ids], "id STRING")
        return self._change(self.table("jobs").where("status = 'Dead'").join(own, "id", "left_semi"), lambda j, now: Z.requeue_dead(j).withColumn("cancel_requested", F.lit(False)))

    def sweep(self) -> int:
        """Delete done and dead jobs beyond their retention with their history and payloads; the done counter stays."""
        gone = self._stage(Z.expired(self._configured(self.table("jobs")), self.clock()).select(*self._columns("jobs"), F.col("status").alias("was")).withColumn("status", F.lit(None).cast("string")))
        n = gone.count()
        if n:
            self._publish(jobs=gone, counters=self._moved(gone), **self._gone(gone))
        return n

    def cancel(self, ids: Iterable[str], effects=None) -> dict[str, str]:
        """Removed while waiting, with history, payload and dedup key, Requested while claimed, else NotFound; effects of a job that is removed commit with it."""
        own = self.spark.createDataFrame([(i,) for i in ids], "id STRING")
        said = self._stage(Z.cancel(self.table("jobs"), own).select("id", "outcome"))
        out = {r["id"]: r["outcome"] for r in said.collect()}  # one for each id given
        if set(out.values()) & {"Removed", "Requested"}:
            hit = self.table("jobs").join(said.where("outcome <> 'NotFound'"), "id").withColumns({"was": F.col("status"), "cancel_requested": F.lit(True)})
            hit = self._stage(hit.withColumn("status", F.when(F.col("outcome") == "Requested", F.col("status"))))
            lost = hit.where("status IS NULL")
            frames = {"jobs": hit, "counters": self._moved(lost), **self._gone(lost)}
            meta = self._with_effects(effects, lost, set(out.values()) == {"Removed"}, frames)[0] if effects else {}
            self._publish(meta, **frames)
        return out

    def wake(self, ids: Iterable[str], payload: bytes | None = None, kv: dict[str, str | None] | None = None) -> dict[str, str]:
        """Scheduled jobs become Pending with a wake payload; key-value writes commit with them if all were woken."""
        own = self.spark.createDataFrame([(i,) for i in ids], "id STRING")
        out = {r["id"]: r["outcome"] for r in Z.wake(self.table("jobs"), own).collect()}
        up = self.spark.createDataFrame([(i,) for i, o in out.items() if o == "Woken"], "id STRING")
        now = self.clock()
        hit = self.table("jobs").join(up, "id", "left_semi").withColumns({"was": F.col("status"), "status": F.lit("Pending"), "run_at": F.lit(None).cast("bigint"), "woken_at": F.lit(now).cast("bigint"), "wake_payload": F.lit(None if payload is None else bytearray(payload)).cast("binary")})
        if "Woken" in out.values():
            frames = {"jobs": self._stage(hit)}
            frames["counters"] = self._moved(frames["jobs"])
            if kv and set(out.values()) == {"Woken"}:
                frames["kv"] = self.spark.createDataFrame(list(kv.items()), KV)
            self._publish(**frames)
        return out

    def wait_for_completion(self, job_id: str, timeout_ms: int, pause: Callable[[int], None] | None = None, poll_ms: int = 200) -> tuple[str, object]:
        """(Completed, record or None), (TimedOut, None) or (NotFound, None). A job that was there and is gone is completed without a record."""
        until, first = self.clock() + timeout_ms, True
        pause = pause or (lambda ms: time.sleep(ms / 1000))
        while True:
            job = self.get_job(job_id)
            if job is None:
                return ("NotFound" if first else "Completed"), None
            if job["status"] in ("Done", "Dead"):
                return "Completed", job
            first = False
            if self.clock() >= until:
                return "TimedOut", None
            pause(min(poll_ms, until - self.clock()))

    # ------------------------------------------------------------ key-value

    def kv_put(self, values: dict[str, str | None]) -> None:
        """Write values, delete where one is None, as one version."""
        self._publish(kv=self.spark.createDataFrame(list(values.items()), KV))

    def kv_apply(self, commands: Iterable[dict]) -> DataFrame:
        """``{key, op, value?, expected?}`` in order; put, delete, cas, cad. Rows (key, value, applied, refused)."""
        rows = [(c["key"], n, c["op"], c.get("expected"), c.get("value")) for n, c in enumerate(commands)]
        cmds = self.spark.createDataFrame(rows, "key STRING, seq BIGINT, op STRING, expected STRING, value STRING")
        seed = self.table("kv").join(cmds.select("key").distinct(), "key", "left_semi").select("key", F.lit(-1).cast("bigint").alias("seq"), F.lit("put").alias("op"), F.lit(None).cast("string").alias("expected"), "value")
        out = fold(cmds.unionByName(seed)).join(seed.select("key", F.lit(1).alias("_s")), "key", "left")
        out = self._stage(out.select("key", "value", (F.col("applied") - F.coalesce("_s", F.lit(0))).alias("applied"), "refused"))
        self._publish(kv=out)
        return out
