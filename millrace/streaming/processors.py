"""Stateful processors. Rows of one batch are put in log order before they change the state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class KvFold(StatefulProcessor):
    """``(key, seq, op, expected, value)``: put, delete, compare-and-put, compare-and-delete; emits the value after each batch."""

    SCHEMA = "key STRING, value STRING, applied BIGINT, refused BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kv", "value STRING, applied BIGINT, refused BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        value, applied, refused = self.state.get() if self.state.exists() else (None, 0, 0)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["op"] in ("cas", "cad") and value != r["expected"]:
                refused += 1
                continue
            applied += 1
            value = r["value"] if r["op"] in ("put", "cas") else None
        self.state.update((value, applied, refused))
        yield Row(key=key[0], value=value, applied=applied, refused=refused)

    def close(self) -> None:
        pass


class DedupWithRelease(StatefulProcessor):
    """``(dkey, at_ms, id, until_ms)``: an enqueue is a hit while the accepted job of its key waits for its claim."""

    SCHEMA = "id STRING, outcome STRING, existing STRING"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "held_by STRING, until_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, until = self.state.get() if self.state.exists() else (None, -1)
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["id"])):
            if r["at_ms"] < until:
                yield Row(id=r["id"], outcome="AlreadyEnqueued", existing=held)
            else:
                held, until = r["id"], r["until_ms"]
                yield Row(id=r["id"], outcome="New", existing=None)
        self.state.update((held, until))

    def close(self) -> None:
        pass


class LeaseTimer(StatefulProcessor):
    """``(id, at, kind, token, expires_ms)``: a claim sets a timer; a settlement with the claim's token
    clears it and is accepted even past the lease while nobody reaped it; a stale one is ClaimLost."""

    SCHEMA = "id STRING, token BIGINT, event STRING"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "token BIGINT, expires_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"])):
            now = self.state.get() if self.state.exists() else None
            if r["kind"] == "claim":
                if now is not None:
                    self.handle.deleteTimer(now[1])
                self.state.update((r["token"], r["expires_ms"]))
                self.handle.registerTimer(r["expires_ms"])
            elif now is not None and now[0] == r["token"]:
                self.handle.deleteTimer(now[1])
                self.state.clear()
                yield Row(id=key[0], token=r["token"], event="settled")
            else:
                yield Row(id=key[0], token=r["token"], event="ClaimLost")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            token, _ = self.state.get()
            self.state.clear()
            yield Row(id=key[0], token=token, event="expired")

    def close(self) -> None:
        pass


class CronNoBackfill(StatefulProcessor):
    """``(name, expression, at)`` ticks: after a gap exactly the one recorded firing is emitted, the rest is dropped."""

    SCHEMA = "name STRING, fire_at BIGINT, dedup_key STRING"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("next", "fire_at BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        from millrace.operators.cron import next_after

        due = self.state.get()[0] if self.state.exists() else None
        for r in sorted(rows, key=lambda r: r["at"]):
            if due is not None and r["at"] >= due:
                yield Row(name=key[0], fire_at=due, dedup_key=f"cron:{key[0]}:{due}")
                due = None
            if due is None:
                due = next_after(r["expression"], r["at"])
        self.state.update((due,))

    def close(self) -> None:
        pass


class SignalWait(StatefulProcessor):
    """``(ckey, at, kind, id, timeout_ms)``: a signal goes to the run that waits on its key, else it is
    kept (the latest only) for the next that does; a second waiter conflicts; a timer ends a wait."""

    SCHEMA = "waiter STRING, event STRING, signal STRING"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "id STRING, until_ms BIGINT")
        self.kept = handle.getValueState("kept", "id STRING")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"], r["id"])):
            now = self.waits.get() if self.waits.exists() else None
            if now is not None and r["at"] > now[1]:  # its timer has not fired yet
                self.handle.deleteTimer(now[1])
                self.waits.clear()
                yield Row(waiter=now[0], event="timed_out", signal=None)
                now = None
            if r["kind"] == "signal":
                if now is None:
                    self.kept.update((r["id"],))
                else:
                    self.handle.deleteTimer(now[1])
                    self.waits.clear()
                    yield Row(waiter=now[0], event="matched", signal=r["id"])
            elif now is not None:
                yield Row(waiter=r["id"], event="conflict", signal=None)
            elif self.kept.exists():
                signal = self.kept.get()[0]
                self.kept.clear()
                yield Row(waiter=r["id"], event="matched", signal=signal)
            else:
                self.waits.update((r["id"], r["at"] + r["timeout_ms"]))
                self.handle.registerTimer(r["at"] + r["timeout_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waits.exists():
            waiter, _ = self.waits.get()
            self.waits.clear()
            yield Row(waiter=waiter, event="timed_out", signal=None)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: type[StatefulProcessor], time_mode: str = "None", mode: str = "Update") -> DataFrame:
    """A keyed stream through a processor; timers need a watermark on the stream."""
    own = stream.groupBy(key)
    return own.transformWithState(statefulProcessor=processor(), outputStructType=processor.SCHEMA, outputMode=mode, timeMode=time_mode)


def depth(stream: DataFrame) -> DataFrame:
    """Jobs by queue, kept up to date."""
    return stream.groupBy("queue").agg(F.count("*").alias("enqueued"), F.min("enqueued_at").alias("first_at"), F.max("enqueued_at").alias("last_at"))


def windowed(stream: DataFrame, at: str = "ts", size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events by queue and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), "queue").agg(F.count("*").alias("n"))
